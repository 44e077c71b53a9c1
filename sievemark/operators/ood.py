"""Out-of-distribution scores (higher = more foreign), their fit, choice and report."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.arrays import energy, quadratic_scores, softmax, to_matrix
from sievemark.operators.metrics import auroc
from sievemark.operators.ordered import quantiles
from sievemark.session import broadcast_if_small, freeze

# Order of preference among scorers whose mean area is within TIE of the best.
PREFERENCE = ("knn", "mahalanobis", "energy", "msp")
TIE = 0.001


def msp(logits: Column | str, temperature: float = 1.0) -> Column:
    return 1 - F.array_max(softmax(logits, temperature))


SCORERS: dict[str, Callable[..., Column]] = {"msp": msp, "energy": energy, "mahalanobis": quadratic_scores}


def scorer(name: str) -> Callable[..., Column]:
    """Column function of a scorer by name; ``knn`` is a join (vector_pairs.kth_cosine)."""
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; known: {', '.join(SCORERS)} and knn")
    return SCORERS[name]


def class_means(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean vector per class: one running-mean buffer per class and task, then a merge."""
    summed = df.groupBy(label).agg(
        Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("m"), F.count("*").alias("n")
    )
    return summed.select(label, vector_to_array("m").alias("mean"), "n")


def means_matrix(df: DataFrame, vector: str, label: str, classes: Sequence[int]) -> np.ndarray:
    """Class means as a (classes, dims) array; its size is fixed by the class list."""
    rows = {r[label]: r["mean"] for r in class_means(df, vector, label).collect()}
    return np.array([rows[c] for c in classes], dtype=np.float64)


def shrunk_precision(df: DataFrame, vector: str, label: str, means: np.ndarray, classes: Sequence[int]) -> np.ndarray:
    """Inverse of :func:`shrunk_covariance`, taken on the driver: dims × dims numbers."""
    return np.linalg.inv(shrunk_covariance(df, vector, label, means, classes))


def shrunk_covariance(df: DataFrame, vector: str, label: str, means: np.ndarray, classes: Sequence[int]) -> np.ndarray:
    """Ledoit-Wolf (2004) covariance of residuals to the class means; tasks return partial Gram matrices."""
    position = {c: i for i, c in enumerate(classes)}
    dims = means.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total, fourth, n = np.zeros((dims, dims)), np.zeros(dims), 0.0, 0
        for batch in batches:
            x, present = to_matrix(batch.column(0))
            if not len(x):
                continue
            y = [position[v] for v, known in zip(batch.column(1).to_pylist(), present, strict=True) if known]
            x = x - means[y]
            gram += x.T @ x
            total += x.sum(axis=0)
            fourth += float(((x**2).sum(axis=1) ** 2).sum())
            n += len(x)
        flat = np.concatenate([gram.ravel(), total, [fourth, float(n)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    known = df.where(F.col(label).isin(*classes)).select(vector, label)
    sums = known.mapInArrow(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.zeros(dims * dims + dims + 2)
    for r in sums.collect():  # dims² + dims + 2 numbers
        flat[r["i"]] = r["v"]
    n = flat[-1]
    second = flat[: dims * dims].reshape(dims, dims)
    mean = flat[dims * dims : dims * dims + dims] / n
    cov = second / n - np.outer(mean, mean)
    mu = np.trace(cov) / dims
    spread = (cov**2).sum()
    noise = max((flat[-2] / n - spread) / (n * dims), 0.0)
    gap = (spread - 2 * mu * np.trace(cov) + dims * mu**2) / dims
    shrink = 0.0 if gap == 0 else min(noise, gap) / gap
    return (1 - shrink) * cov + shrink * mu * np.eye(dims)


def scorer_comparison(scores: DataFrame) -> DataFrame:
    """Area per scorer and kind of foreign data, from rows (scorer, kind in {id, near, far}, score)."""
    paired = scores.where("kind <> 'id'").unionByName(
        scores.where("kind = 'id'").withColumn("kind", F.explode(F.array(F.lit("near"), F.lit("far")))).withColumn("_id", F.lit(True)),
        allowMissingColumns=True,
    )
    return auroc(paired, "score", F.coalesce(~F.col("_id"), F.lit(True)), ["scorer", "kind"])


def choose_scorer(areas: DataFrame) -> DataFrame:
    """The preferred scorer among those within TIE of the best mean area."""
    order = F.array_position(F.array(*[F.lit(p) for p in PREFERENCE]), F.col("scorer"))
    means = areas.groupBy("scorer").agg(F.avg("auroc").alias("mean_auroc"))  # one row per scorer
    means = freeze(means)
    top = means.agg(F.max("mean_auroc")).scalar()
    return means.where(F.col("mean_auroc") >= top - TIE).orderBy(order).limit(1)


def test_report(scores: DataFrame, accept: float = 0.95) -> DataFrame:
    """Per scorer and kind in {near, far, all}: area, share of foreign rows under the threshold that
    accepts ``accept`` of val, and the share of test rows it accepts.

    Input rows: (scorer, split in {val, test}, kind in {id, near, far}, score).
    """
    val = scores.where("split = 'val' and kind = 'id'")
    tau = quantiles(val, "score", {"tau": accept}, ["scorer"])
    test = scores.where("split = 'test'").join(broadcast_if_small(tau), "scorer")
    kept = F.avg((F.col("score") <= F.col("tau")).cast("double"))
    accepted = test.where("kind = 'id'").groupBy("scorer").agg(kept.alias("id_acceptance"))
    foreign = test.where("kind <> 'id'").withColumn(
        "kind", F.explode(F.array(F.col("kind"), F.lit("all")))
    )
    passing = foreign.groupBy("scorer", "kind").agg(kept.alias("fpr"))
    own = test.where("kind = 'id'").withColumn(
        "kind", F.explode(F.array(F.lit("near"), F.lit("far"), F.lit("all")))
    )
    paired = foreign.withColumn("_f", F.lit(True)).unionByName(own.withColumn("_f", F.lit(False)))
    areas = auroc(paired, "score", F.col("_f"), ["scorer", "kind"])
    return areas.join(passing, ["scorer", "kind"]).join(accepted, "scorer").select(
        "scorer", "kind", "auroc", "fpr", "id_acceptance"
    )


def acceptance_by(scores: DataFrame, source: str, tau: float) -> DataFrame:
    return scores.groupBy(source).agg(
        F.count("*").alias("n"), F.avg((F.col("score") <= tau).cast("double")).alias("accepted")
    )
