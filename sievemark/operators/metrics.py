"""Classification metrics from confusion cells, rank metrics from distinct scores.

Everything but the rank metrics needs only the (y, pred) cells: one pass with map-side combine
shrinks any table to at most classes² rows per group.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate
from math import exp, factorial
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.functions.arrays import argmax
from sievemark.operators.ordered import quantile_bin, quantiles, with_position, with_running_sums
from sievemark.session import stored


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, or ``empty`` when b is 0."""
    return F.when(b == 0, F.lit(empty).cast("double")).otherwise(a.cast("double") / b.cast("double"))


def cells(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    n = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(n.alias("n"))


def class_counts(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``tp``, ``support`` and ``predicted`` per class that occurs in y or pred."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(F.col("n") * 0)
    ends = F.array(
        F.struct(F.col("y").alias("cls"), hit.alias("tp"), F.col("n").alias("support"), (F.col("n") * 0).alias("predicted")),
        F.struct(F.col("pred").alias("cls"), (F.col("n") * 0).alias("tp"), (F.col("n") * 0).alias("support"), F.col("n").alias("predicted")),
    )
    return (
        confusion.select(*by, F.inline(ends))
        .groupBy(*by, "cls")
        .agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("tp", "support", "predicted")])
    )


def with_scores(counts: DataFrame) -> DataFrame:
    p = ratio(F.col("tp"), F.col("predicted"))
    r = ratio(F.col("tp"), F.col("support"))
    f1 = ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))
    return counts.withColumns({"precision": p, "recall": r, "f1": f1})


def core_metrics(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro scores; the macro mean runs over classes present in y or pred."""
    scored = with_scores(class_counts(confusion, by)).where("support + predicted > 0")
    return scored.groupBy(*by).agg(
        F.sum("support").alias("n"),
        (F.sum("support") - F.sum("tp")).alias("errors"),
        (F.sum("tp").cast("double") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
    )


def class_report(confusion: DataFrame, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Scores for every listed class (absent ones are 0), then macro and weighted averages."""
    counts = class_counts(confusion, by)
    listed = F.explode(F.array(*[F.lit(c) for c in classes])).alias("cls")
    frame = counts.select(*by).distinct() if by else counts.sparkSession.range(1)
    full = frame.select(*by, listed).join(counts, [*by, "cls"], "left").na.fill(0, ["tp", "support", "predicted"])
    scored = with_scores(full)
    per_class = scored.select(
        *by, F.col("cls").cast("string").alias("row"), "precision", "recall", "f1", F.col("support").cast("long")
    )
    averages = scored.groupBy(*by).agg(
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"w_{m}") for m in ("precision", "recall", "f1")],
        F.sum("support").cast("long").alias("support"),
    )
    stacked = averages.select(
        *by,
        F.expr(
            "stack(2, 'macro avg', macro_precision, macro_recall, macro_f1, support,"
            " 'weighted avg', w_precision, w_recall, w_f1, support) as (row, precision, recall, f1, support)"
        ),
    )
    return per_class.unionByName(stacked)


def confusion_matrix(confusion: DataFrame, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Every (y, pred) cell with its count and its share of the row (divisor at least 1)."""
    ids = F.array(*[F.lit(c) for c in classes])
    frame = confusion.select(*by).distinct() if by else confusion.sparkSession.range(1)
    grid = frame.select(*by, F.explode(ids).alias("y")).withColumn("pred", F.explode(ids))
    full = grid.join(confusion, [*by, "y", "pred"], "left").na.fill(0, ["n"])
    rows = full.groupBy(*by, "y").agg(F.sum("n").alias("_row"))
    return full.join(rows, [*by, "y"]).select(
        *by, "y", "pred", "n", (F.col("n") / F.greatest("_row", F.lit(1))).alias("share")
    )


def auroc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with ties counted half; NULL when one side is empty.

    Rows are first reduced to distinct scores; then only running sums of those are needed.
    """
    steps = (
        df.where(F.col(score).isNotNull())
        .select(*by, F.col(score).alias("_s"), positive.cast("long").alias("_p"))
        .groupBy(*by, "_s")
        .agg(F.sum("_p").alias("pos"), F.sum(1 - F.col("_p")).alias("neg"))
    )
    run = with_running_sums(steps, ["_s"], ["neg"], by)
    return run.groupBy(*by).agg(
        F.when(
            (F.sum("pos") > 0) & (F.max("neg_total") > 0),
            F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
            / (F.sum("pos").cast("double") * F.max("neg_total")),
        ).alias("auroc")
    )


def one_vs_rest(df: DataFrame, y: str, probs: str) -> DataFrame:
    """Long form (cls, score, is_cls) of a probability column for per-class rank metrics."""
    return df.select(
        y, F.posexplode(probs).alias("cls", "score")
    ).select("cls", "score", (F.col(y) == F.col("cls")).alias("is_cls"))


def macro_auroc(df: DataFrame, y: str, probs: str) -> DataFrame:
    """Mean of the per-class areas; NULL when a class never occurs."""
    per_class = auroc(one_vs_rest(df, y, probs), "score", F.col("is_cls"), ["cls"])
    return per_class.agg(
        F.when(F.count("auroc") == F.count("*"), F.avg("auroc")).alias("macro_auroc")
    )


def _cell_scores(counts: np.ndarray, y: np.ndarray, pred: np.ndarray) -> tuple[float, float]:
    total = counts.sum()
    accuracy = counts[y == pred].sum() / total
    f1 = []
    for c in np.union1d(y, pred):
        support, predicted = counts[y == c].sum(), counts[pred == c].sum()
        if support + predicted:
            f1.append(2 * counts[(y == c) & (pred == c)].sum() / (support + predicted))
    return float(accuracy), float(np.mean(f1))


def _replicates(confusion: DataFrame, columns: Sequence[str], n_boot: int, seed: int, score, schema: str) -> DataFrame:
    """One row per bootstrap replicate: a multinomial draw over the cells is a resample of the rows."""
    table = confusion.select(*columns, "n").orderBy(*columns).toPandas()  # at most classes³ rows
    counts = table["n"].to_numpy(dtype=np.int64)
    labels = [table[c].to_numpy() for c in columns]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for b in batch["id"]:
                rng = np.random.default_rng([seed, int(b)])
                drawn = rng.multinomial(counts.sum(), counts / counts.sum())
                out.append((int(b), *score(drawn, *labels)))
            yield pd.DataFrame(out, columns=[s.split()[0] for s in schema.split(", ")])

    return confusion.sparkSession.range(n_boot).mapInPandas(draw, schema)


def bootstrap_ci(confusion: DataFrame, n_boot: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Percentile intervals of accuracy and macro F1; replicates cost cells, not rows."""
    reps = _replicates(
        confusion, ["y", "pred"], n_boot, seed, _cell_scores, "b long, accuracy double, macro_f1 double"
    )
    lo, hi = (1 - level) / 2, (1 + level) / 2
    return reps.select(F.expr("stack(2, 'accuracy', accuracy, 'macro_f1', macro_f1) as (metric, v)")).groupBy(
        "metric"
    ).agg(F.percentile("v", lo).alias("lo"), F.percentile("v", hi).alias("hi"))


def paired_bootstrap(triples: DataFrame, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Macro-F1 of A minus B on the same resamples, from cells (y, a, b, n)."""

    def score(drawn: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[float]:
        return (_cell_scores(drawn, y, a)[1] - _cell_scores(drawn, y, b)[1],)

    reps = _replicates(triples, ["y", "a", "b"], n_boot, seed, score, "rep long, diff double")
    whole = core_metrics(triples.select("y", F.col("a").alias("pred"), "n").groupBy("y", "pred").agg(F.sum("n").alias("n")))
    other = core_metrics(triples.select("y", F.col("b").alias("pred"), "n").groupBy("y", "pred").agg(F.sum("n").alias("n")))
    gap = whole.first()["macro_f1"] - other.first()["macro_f1"]
    return reps.agg(
        F.lit(float(gap)).alias("diff"),
        F.percentile("diff", 0.025).alias("lo"),
        F.percentile("diff", 0.975).alias("hi"),
        F.avg((F.col("diff") <= 0).cast("double")).alias("share_not_better"),
    )


# Cumulative Poisson(1) probabilities of 0, 1, … events, as long as a uniform number of 32 bits can tell them from 1.
POISSON_STEPS = tuple(accumulate(exp(-1) / factorial(k) for k in range(13)))


def poisson_cells(df: DataFrame, key: str, columns: Sequence[str], replicates: int, seed: str = "boot") -> DataFrame:
    """Confusion cells of every replicate in one pass over the rows: ``(*columns, rep, n)``.

    Each row gets a Poisson(1) weight per replicate from its hash (four per digest): the number of
    cumulative steps its uniform number has reached. A task sums the weights of its rows cell by cell,
    so only cells leave it, whatever the number of rows or replicates.
    """
    rows = df.select(*columns, F.col(key).cast("string").alias("_key"))
    schema = T.StructType([*rows.drop("_key").schema, T.StructField("rep", T.IntegerType()), T.StructField("n", T.LongType())])
    steps = np.array(POISSON_STEPS)
    heads = [f"{seed}{d}:" for d in range(-(-replicates // 4))]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple, np.ndarray] = {}
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in columns]
            *labels, keys = (batch.column(c).to_pylist() for c in [*columns, "_key"])
            for k, *cell in zip(keys, *labels, strict=True):
                if k is None:  # as in SQL: no hash, no weight
                    continue
                digests = b"".join(hashlib.md5((head + k).encode()).digest() for head in heads)
                u = np.frombuffer(digests, ">u4")[:replicates] / 2**32
                sums = cells.setdefault(tuple(cell), np.zeros(replicates, np.int64))
                sums += np.searchsorted(steps, u, side="right")
        for cell, sums in cells.items():
            drawn = np.flatnonzero(sums)
            arrays = [pa.array([v] * len(drawn), kind) for v, kind in zip(cell, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(drawn, pa.int32()), pa.array(sums[drawn])], schema.names)

    parts = rows.mapInArrow(draw, schema)
    return parts.groupBy(*columns, "rep").agg(F.sum("n").alias("n"))


def compare_models(predictions: DataFrame, main: str, key: str = "id", replicates: int = 2000) -> DataFrame:
    """One row per model: scores with intervals, and what ``main``, fixed in advance, has over it.

    Input (model, key, y, pred); rows are compared on the keys that ``main`` answered. Every replicate weighs a row
    alike for all models, so differences are paired: equal predictions give exactly zero. Differences of
    ``main`` to itself are NULL. Work per row is the weights, work after that replicates x cells.
    """
    own = predictions.where(F.col("model") == main).select(key, F.col("pred").alias("main"))
    rows = stored(predictions.join(own, key), "compared")
    drawn = stored(poisson_cells(rows, key, ["model", "y", "main", "pred"], replicates), "cells")
    whole = rows.groupBy("model", "y", "main", "pred").agg(F.count("*").alias("n"))

    def scores(source: DataFrame, column: str, by: list[str]) -> DataFrame:
        one = source.groupBy(*by, "y", F.col(column).alias("pred")).agg(F.sum("n").alias("n"))
        return core_metrics(one, by)

    point = scores(whole, "pred", ["model"]).join(
        scores(whole, "main", ["model"]).select("model", F.col("macro_f1").alias("main_f1")), "model"
    )
    reps = scores(drawn, "pred", ["model", "rep"]).select("model", "rep", "accuracy", "macro_f1").join(
        scores(drawn, "main", ["model", "rep"]).select("model", "rep", F.col("macro_f1").alias("main_f1")), ["model", "rep"]
    )
    gap = F.when(F.col("model") != main, F.round(F.col("main_f1") - F.col("macro_f1"), 12))  # sums may differ in the last digit
    spans = reps.withColumn("gap", gap).groupBy("model").agg(
        *[F.percentile(c, q).alias(f"{n}_{side}") for c, n in (("accuracy", "accuracy"), ("macro_f1", "f1"), ("gap", "diff")) for side, q in (("lo", 0.025), ("hi", 0.975))],
        F.avg((F.col("gap") <= 0).cast("double")).alias("share_not_better"),
    )
    return point.withColumn("diff", gap).select("model", "n", "errors", "accuracy", "macro_f1", "diff").join(spans, "model")


def confidence_buckets(df: DataFrame, conf: str, correct: str, edges: Sequence[float]) -> DataFrame:
    """Left-closed buckets: count, accuracy (NULL if empty), share of all errors; none left out."""
    bucket = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        bucket = F.when((F.col(conf) >= edges[i]) & (F.col(conf) < edges[i + 1]), i).otherwise(bucket)
    counts = (
        df.groupBy(bucket.alias("bucket"))
        .agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("right"))
    )
    errors = counts.agg(F.sum(F.col("n") - F.col("right")).alias("errors"))
    frame = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bucket"))
    share = F.coalesce(F.col("n") - F.col("right"), F.lit(0))
    whole = F.coalesce(F.lit(errors.first()["errors"]), F.lit(0)).cast("long")
    return frame.join(counts, "bucket", "left").select(
        "bucket",
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.col("right") / F.col("n")).alias("accuracy"),
        (share / F.greatest(whole, F.lit(1))).alias("share_of_errors"),
    )


def selective_curve(df: DataFrame, conf: str, correct: str, key: str) -> DataFrame:
    """Accuracy of the most confident rows at every coverage (ties in key order)."""
    rows = df.select(key, conf, F.col(correct).cast("long").alias("hit"), F.lit(1).cast("long").alias("one"))
    run = with_running_sums(rows, [F.col(conf).desc(), F.col(key)], ["hit", "one"])
    kept = F.col("one_before") + 1
    return run.select(
        key,
        (kept / F.col("one_total")).alias("coverage"),
        ((F.col("hit_before") + F.col("hit")) / kept).alias("accuracy"),
        F.col(conf).alias("threshold"),
    )


def binned_counts(df: DataFrame, value: str, edges: Sequence[float], by: str, groups: Sequence[str]) -> DataFrame:
    """Counts per right-closed bin and group with zeros; values outside the edges are left out."""
    inside = right_closed_bin(F.col(value), edges)
    counts = df.groupBy(inside.alias("bin"), F.col(by).alias(by)).agg(F.count("*").alias("n")).where("bin is not null")
    frame = df.sparkSession.range(len(edges) - 1).select(
        F.col("id").cast("int").alias("bin"), F.explode(F.array(*[F.lit(g) for g in groups])).alias(by)
    )
    return frame.join(counts, ["bin", by], "left").na.fill(0, ["n"])


def right_closed_bin(value: Column, edges: Sequence[float], include_lowest: bool = False) -> Column:
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        low = value >= edges[i] if include_lowest and i == 0 else value > edges[i]
        out = F.when(low & (value <= edges[i + 1]), i).otherwise(out)
    return out


def error_rate_by_quartile(long_rows: DataFrame, measure: str, value: str, wrong: Column, key: str, bins: int = 4) -> DataFrame:
    """Error rate per rank quantile of each measure (rows with a NULL measure are skipped)."""
    rows = long_rows.where(F.col(value).isNotNull()).select(
        measure, value, key, wrong.cast("double").alias("_wrong")
    )
    placed = with_position(rows, [value, key], by=[measure], name="_rank", total="_n")
    return (
        placed.groupBy(measure, quantile_bin(F.col("_rank"), F.col("_n"), bins).alias("bin"))
        .agg(F.count("*").alias("n"), F.avg("_wrong").alias("error_rate"))
    )


def median_confidence(df: DataFrame, conf: str, correct: str) -> DataFrame:
    """Rows, accuracy, and the median confidence of right and of wrong rows."""
    medians = quantiles(df, conf, {"median": 0.5}, [correct])
    facts = df.groupBy(correct).agg(F.count("*").alias("n")).join(medians, correct)  # at most two rows
    right = F.col(correct)
    return facts.agg(
        F.sum("n").alias("n"),
        (F.coalesce(F.sum(F.when(right, F.col("n"))), F.lit(0)) / F.sum("n")).alias("accuracy"),
        F.max(F.when(right, F.col("median"))).alias("median_right"),
        F.max(F.when(~right, F.col("median"))).alias("median_wrong"),
    )


def predicted(df: DataFrame, probs: str = "probs", y: str = "y") -> DataFrame:
    """Adds pred, conf and correct from a probability column."""
    return df.withColumns(
        {"pred": argmax(probs), "conf": F.array_max(probs)}
    ).withColumn("correct", F.col("pred") == F.col(y))
