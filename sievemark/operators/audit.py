"""Embedding jobs, linear probe, out-of-fold probabilities and label issues."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.functions.arrays import argmax, from_matrix, spread_out, to_matrix, unit
from sievemark.operators.joins import new_keys
from sievemark.operators.metrics import cells, core_metrics
from sievemark.operators.ordered import with_position
from sievemark.session import freeze


def embed_new(
    rows: DataFrame,
    store: DataFrame,
    key: str,
    content: str,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    batch_size: int = 32,
) -> DataFrame:
    """Vectors for keys the store lacks, one per distinct key; append the result to the store.

    ``make_predict`` is run once per Python worker and returns a batch function.
    """
    predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    todo = new_keys(rows.select(key, content), store, key)
    return todo.select(key, predict(content).alias("emb"))


def score_rows(
    rows: DataFrame, inputs: str, make_predict: Callable, return_type: T.DataType = T.ArrayType(T.DoubleType()), batch_size: int = 32
) -> Column:
    """Output column of a user model run in batches; ``return_type`` may be a struct of several outputs."""
    return predict_batch_udf(make_predict, return_type=return_type, batch_size=batch_size)(F.col(inputs))


class Probe:
    """Standardised, L2-regularised multinomial logistic regression on unit vectors."""

    def __init__(self, strength: float = 0.5, max_iter: int = 3000, tol: float = 1e-4):
        self.strength, self.max_iter, self.tol = strength, max_iter, tol

    def _features(self, df: DataFrame, vector: str) -> DataFrame:
        return df.withColumn("_raw", array_to_vector(unit(vector)))

    def fit(self, df: DataFrame, vector: str, y: str) -> Probe:
        train = self._features(df, vector)
        self.scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(train)
        scaled = freeze(self.scaler.transform(train).select("_x", F.col(y).cast("double").alias("_y")))
        n = scaled.count()
        self.model: LogisticRegressionModel = LogisticRegression(
            featuresCol="_x",
            labelCol="_y",
            family="multinomial",
            regParam=1.0 / (self.strength * n),
            standardization=False,
            maxIter=self.max_iter,
            tol=self.tol,
        ).fit(scaled)
        return self

    def predict(self, df: DataFrame, vector: str) -> DataFrame:
        """Adds ``probs`` and ``pred``."""
        self.model.setProbabilityCol("_p").setPredictionCol("_d").setRawPredictionCol("_r")
        out = self.model.transform(self.scaler.transform(self._features(df, vector)))
        return out.withColumn("probs", vector_to_array("_p")).withColumn("pred", argmax("probs")).select(
            *df.columns, "probs", "pred"
        )


def out_of_fold(df: DataFrame, vector: str, y: str, fold: str, folds: int, probe: Callable[[], Probe] = Probe) -> DataFrame:
    """Every row once, scored by a probe fitted on the other folds."""
    parts = []
    for k in range(folds):
        fitted = probe().fit(df.where(F.col(fold) != k), vector, y)
        parts.append(fitted.predict(df.where(F.col(fold) == k), vector))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def out_of_fold_centroids(df: DataFrame, vector: str, y: str, fold: str, classes: Sequence[int], scale: float = 1.0) -> DataFrame:
    """Every row once with ``logits`` from class centroids of the other folds; all folds come from one pass.

    The pass returns a mean and a count per (fold, class); the centroid without a fold is the total less that fold's
    share. A class that lies in one fold only has probability zero there. Rows of other labels fit nothing but
    are scored; a row without a vector gets NULL. ``fold`` is a whole number and never NULL.
    """
    place = {c: i for i, c in enumerate(classes)}
    known = df.where(F.col(y).isin(*classes) & F.col(vector).isNotNull())
    parts = known.groupBy(fold, y).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))).alias("m"), F.count("*").alias("n")
    ).collect()  # folds x classes rows
    sums = {(r[fold], place[r[y]]): (r["n"], r["n"] * np.array(r["m"])) for r in parts}
    weights, unseen = {}, {}
    for k in {r[fold] for r in df.select(fold).distinct().collect()}:
        rows, gaps = [], []
        for c in range(len(classes)):
            others = [v for (f, cls), v in sums.items() if cls == c and f != k]
            gaps.append(-1e9 if not others else 0.0)
            width = len(parts[0]["m"]) if parts else 0
            rows.append(sum(v[1] for v in others) / sum(v[0] for v in others) if others else np.zeros(width))
        weights[k], unseen[k] = scale * np.array(rows), np.array(gaps)

    @F.arrow_udf("array<double>")
    def scores(v: pa.Array, k: pa.Array) -> pa.Array:
        x, present = to_matrix(v)
        if not len(x):
            return pa.nulls(len(v), pa.list_(pa.float64()))
        which = k.to_numpy(zero_copy_only=False)[present]
        out = np.empty((len(x), len(classes)))
        for f in np.unique(which):
            at = which == f
            out[at] = x[at] @ weights[f].T + unseen[f]
        return spread_out(from_matrix(out), present)

    return df.withColumn("logits", scores(F.col(vector), F.col(fold)))


def _keep_sum(values: np.ndarray) -> np.ndarray:
    """Whole numbers with the same (rounded) sum: the largest remainders are rounded up."""
    low = np.floor(values + 1e-9)
    short = int(round(values.sum() - low.sum()))
    order = np.argsort(-(values - low), kind="stable")
    low[order[:short]] += 1
    return low


def prune_counts(joint: np.ndarray, label_counts: np.ndarray) -> np.ndarray:
    """How many rows labelled j to drop as class k, from the counted joint (label × guess)."""
    joint = joint.astype(float).copy()
    np.fill_diagonal(joint, np.maximum(joint.diagonal(), 1))
    rows = np.maximum(joint.sum(axis=1, keepdims=True), 1e-12)
    scaled = joint / rows * label_counts[:, None]
    scaled = scaled / scaled.sum() * label_counts.sum()
    joint = np.array([_keep_sum(r) for r in scaled])
    by_guess = joint.T.copy()
    lift = np.maximum(by_guess.diagonal(), 1)
    gain = lift - by_guess.diagonal()
    noisy = np.maximum((by_guess > 0).sum(axis=0) - 1, 1)
    by_guess = np.maximum(by_guess - gain / noisy, 0)
    np.fill_diagonal(by_guess, lift)
    return np.array([_keep_sum(r) for r in by_guess])


def self_confidence(df: DataFrame, probs: str, y: str) -> DataFrame:
    """Mean probability of the given class, per class."""
    return df.groupBy(F.col(y).alias("cls")).agg(
        F.avg(F.get(probs, F.col(y))).alias("threshold"), F.count("*").alias("n")
    )


def confident_guess(df: DataFrame, probs: str, thresholds: Sequence[float]) -> Column:
    """The class a row confidently belongs to: the only one at its threshold, or the top class
    when several are; NULL when none is."""
    limits = F.array(*[F.lit(float(t)) for t in thresholds])
    above = F.filter(
        F.sequence(F.lit(0), F.lit(len(thresholds) - 1)),
        lambda i: F.get(probs, i) >= F.get(limits, i) - 1e-6,
    )
    return F.when(F.size(above) > 1, argmax(probs)).otherwise(F.get(above, F.lit(0)))


def label_issues(df: DataFrame, key: str, probs: str, y: str, classes: int) -> DataFrame:
    """Rows whose label is doubtful (confident learning, Northcutt et al. 2021, pruned by noise rate).

    Class thresholds and the joint are classes and classes² numbers; the rows to prune are found by
    the exact n-th largest margin per (label, class), read off distributed positions. Rows whose
    top class is their label are never issues. Columns: key, y, pred, given_prob, pred_prob.
    """
    base = freeze(df.select(F.col(key), F.col(y).alias("y"), F.col(probs).alias("p")))
    stats = {r["cls"]: r for r in self_confidence(base, "p", "y").collect()}
    limits = [stats[k]["threshold"] if k in stats else 2.0 for k in range(classes)]
    counts = np.array([stats[k]["n"] if k in stats else 0 for k in range(classes)])
    joint = np.zeros((classes, classes))
    guessed = base.withColumn("g", confident_guess(base, "p", limits)).where("g is not null")
    for r in guessed.groupBy("y", "g").count().collect():
        joint[r["y"], r["g"]] = r["count"]
    drop = prune_counts(joint, counts)
    wanted = [(j, k, int(drop[k][j])) for k in range(classes) for j in range(classes) if j != k and drop[k][j] > 0]
    if not wanted:
        return _issue_columns(base.limit(0), key)
    spark = df.sparkSession
    plan = F.broadcast(spark.createDataFrame(wanted, "y int, k int, n_drop long"))  # ≤ classes² rows
    margins = base.select(
        key, F.col("y").cast("int").alias("y"), F.posexplode("p").alias("k", "pk"), "p"
    ).select(key, "y", "k", (F.col("pk") - F.get("p", F.col("y"))).alias("margin"))
    asked = margins.join(plan, ["y", "k"])
    placed = freeze(with_position(asked, [F.col("margin").desc(), F.col(key)], by=["y", "k"]))
    cuts = placed.where("position = n_drop").select("y", "k", F.col("margin").alias("cut"))
    hit = placed.join(F.broadcast(cuts), ["y", "k"]).where("margin >= cut").select(key).distinct()
    return _issue_columns(base.join(hit, key, "left_semi"), key)


def _issue_columns(rows: DataFrame, key: str) -> DataFrame:
    return (
        rows.withColumn("pred", argmax("p"))
        .where("pred <> y")
        .select(
            key, "y", "pred", F.get("p", F.col("y")).alias("given_prob"), F.array_max("p").alias("pred_prob")
        )
    )


def ranked_issues(issues: DataFrame, key: str) -> DataFrame:
    """Issues with their ``rank``, the least self-confident label first (ties by key)."""
    return with_position(issues, ["given_prob", key], name="rank")


def audit_report(issues: DataFrame, predictions: DataFrame, y: str, pred: str = "pred") -> DataFrame:
    """:func:`audit_summary` with accuracy and macro F1 of the out-of-fold predictions."""
    core = freeze(core_metrics(cells(predictions, y, pred)))
    facts = core.select(
        F.lit("model").alias("section"),
        F.inline(
            F.array(
                F.struct(F.lit("oof_accuracy").alias("key"), "n", F.col("accuracy").alias("rate")),
                F.struct(F.lit("oof_macro_f1").alias("key"), "n", F.col("macro_f1").alias("rate")),
            )
        ),
    )
    total = core.first()["n"] or 0
    return audit_summary(issues, total).unionByName(facts)


def audit_summary(issues: DataFrame, total: int) -> DataFrame:
    """Issue count and rate, and counts by label and by (label, predicted)."""
    overall = issues.agg(F.count("*").alias("n")).select(
        F.lit("all").alias("section"), F.lit("issues").alias("key"), "n", (F.col("n") / F.lit(total)).alias("rate")
    )
    by_label = issues.groupBy("y").agg(F.count("*").alias("n")).select(
        F.lit("label").alias("section"), F.col("y").cast("string").alias("key"), "n", F.lit(None).cast("double").alias("rate")
    )
    by_pair = issues.groupBy("y", "pred").agg(F.count("*").alias("n")).select(
        F.lit("pair").alias("section"), F.concat_ws(">", F.col("y").cast("string"), F.col("pred").cast("string")).alias("key"),
        "n", F.lit(None).cast("double").alias("rate"),
    )
    return overall.unionByName(by_label).unionByName(by_pair)
