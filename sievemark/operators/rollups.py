"""Robustness, explanation, severity and comparison tables over per-record results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.arrays import trapezoid
from sievemark.operators.calibration import ece
from sievemark.operators.metrics import cells, core_metrics
from sievemark.operators.ordered import quantile_bin, with_position
from sievemark.session import broadcast_if_small


def score_block(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Core metrics, mean confidence and ECE per group; needs y, pred, conf and correct."""
    core = core_metrics(cells(df, by=by), by)
    means = df.groupBy(*by).agg(F.avg("conf").alias("mean_confidence"))
    return core.join(means, list(by)).join(ece(df, "conf", "correct", by=by), list(by))


def prediction_counts(df: DataFrame, classes: Sequence[int], by: Sequence[str]) -> DataFrame:
    """Predictions and wrong predictions of every listed class per group."""
    confusion = cells(df, by=by)
    frame = confusion.select(*by).distinct().withColumn("pred", F.explode(F.array(*[F.lit(c) for c in classes])))
    wrong = F.when(F.col("y") != F.col("pred"), F.col("n")).otherwise(0)
    counts = confusion.groupBy(*by, "pred").agg(F.sum("n").alias("predicted"), F.sum(wrong).alias("errors_to"))
    return frame.join(counts, [*by, "pred"], "left").na.fill(0, ["predicted", "errors_to"])


def relative_robustness(scores: DataFrame, model: str, severities: Sequence[int] = (3, 5)) -> DataFrame:
    """Mean macro F1 over corrupted cells up to each severity, divided by the clean one.

    ``scores`` has (model, corruption, severity, macro_f1) with severity 0 for the clean row.
    """
    clean = F.max(F.when(F.col("severity") == 0, F.col("macro_f1")))
    return scores.groupBy(model).agg(
        clean.alias("clean_macro_f1"),
        *[
            (F.avg(F.when(F.col("severity").between(1, s), F.col("macro_f1"))) / clean).alias(f"relative_1_{s}")
            for s in severities
        ],
    )


def sweep_summary(scores: DataFrame, model: str, corruptions: Sequence[str], severity: int = 3) -> DataFrame:
    """One row per model with the macro F1 of every corruption at one severity."""
    at = scores.where(F.col("severity") == severity)
    wide = at.groupBy(model).pivot("corruption", list(corruptions)).agg(F.max("macro_f1"))
    return wide.select(model, *[F.col(f"`{c}`").alias(f"{c}_sev{severity}_f1") for c in corruptions])


def degradation_curve(scores: DataFrame, corruptions: Sequence[str]) -> DataFrame:
    """Each corruption's curve with the clean row repeated at severity 0."""
    names = F.array(*[F.lit(c) for c in corruptions])
    clean = scores.where("severity = 0").withColumn("corruption", F.explode(names))
    return clean.unionByName(scores.where("severity > 0"))


def shortcut_groups(df: DataFrame, mask: str, limit: float = 0.8) -> DataFrame:
    """Kept and excluded rows per class by mask share."""
    return df.groupBy("y").agg(
        F.count_if(F.col(mask) <= limit).alias("kept"), F.count_if(F.col(mask) > limit).alias("excluded")
    )


def majority_rate(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg((F.max("n") / F.sum("n")).alias("majority_rate"))


def focus_summary(df: DataFrame, focus: str, mask: str, limit: float = 0.8) -> DataFrame:
    """Mean focus over usable rows: overall, by outcome (NULL when none) and the mean mask share."""
    used = df.where(F.col(mask) <= limit)
    return used.agg(
        F.count("*").alias("n_used"),
        F.avg(focus).alias("mean_focus"),
        F.avg(mask).alias("mean_mask"),
        F.avg(F.when(F.col("y") == F.col("pred"), F.col(focus))).alias("focus_right"),
        F.avg(F.when(F.col("y") != F.col("pred"), F.col(focus))).alias("focus_wrong"),
    )


def focus_by_class(df: DataFrame, focus: str, mask: str, limit: float = 0.8) -> DataFrame:
    return df.where(F.col(mask) <= limit).groupBy("y").agg(F.avg(focus).alias("mean_focus"))


def mean_curves(df: DataFrame, curves: Sequence[str]) -> DataFrame:
    """Element-wise mean of array columns: (curve, step, mean)."""
    out = None
    for c in curves:
        one = (
            df.select(F.posexplode(c).alias("step", "v"))
            .groupBy("step")
            .agg(F.avg("v").alias("mean"))
            .select(F.lit(c).alias("curve"), "step", "mean")
        )
        out = one if out is None else out.unionByName(one)
    return out


def deletion_summary(df: DataFrame, guided: str, random: str, fractions: Sequence[float]) -> DataFrame:
    """Mean areas of both deletion orders and the share of records where the guided one is smaller."""
    a, b = trapezoid(guided, fractions), trapezoid(random, fractions)
    areas = df.select(a.alias("a"), b.alias("b"))
    return areas.agg(
        F.avg("a").alias("area_guided"),
        F.avg("b").alias("area_random"),
        F.avg((F.col("a") < F.col("b")).cast("double")).alias("share_guided_smaller"),
    )


def severity_terciles(df: DataFrame, key: str, label: str, value: str, healthy: str, bins: int = 3) -> DataFrame:
    """Outcome rates per class and rank tercile; needs status, pred and confidence (may be NULL)."""
    placed = with_position(df, [value, key], by=[label], name="_rank", total="_n")
    binned = placed.withColumn("tercile", quantile_bin(F.col("_rank"), F.col("_n"), bins))
    differs = F.coalesce(F.col("pred") != F.col(label), F.lit(False))
    # status = 'accepted' with no pred counts as wrong in the reference comparison
    answered = (F.col("status") == "accepted") & F.coalesce(F.col("pred") != F.col(label), F.lit(True))

    def rate(cond: Column) -> Column:
        return F.avg(cond.cast("double"))

    rates = binned.groupBy(label, "tercile").agg(
        F.count("*").alias("n"),
        *[rate(F.col("status") == s).alias(s) for s in ("accepted", "uncertain", "rejected")],
        rate(differs).alias("wrong_top_class"),
        rate(F.coalesce(F.col("pred") == healthy, F.lit(False))).alias("called_healthy"),
        rate(answered).alias("answered_wrong"),
        F.avg("confidence").alias("mean_confidence"),
    )
    # a tercile is a run of ranks, missing values first: its median lies at one or two known ranks
    spans = binned.groupBy(label, "tercile").agg(F.max("_rank").alias("_last"), F.count(value).alias("_k"))
    middle = broadcast_if_small(
        spans.where("_k > 0").select(
            F.col(label).alias("_l"), F.col("tercile").alias("_t"),
            (F.col("_last") - F.floor(F.col("_k") / 2)).alias("_low"), (F.col("_last") - F.floor((F.col("_k") - 1) / 2)).alias("_high"),
        )
    )
    at = F.col(label).eqNullSafe(F.col("_l")) & (F.col("tercile") == F.col("_t")) & F.col("_rank").between(F.col("_low"), F.col("_high"))
    medians = binned.join(middle, at).groupBy(F.col(label).alias("_l"), F.col("tercile").alias("_t")).agg(F.avg(value).alias("median"))
    same = F.col(label).eqNullSafe(F.col("_l")) & (F.col("tercile") == F.col("_t"))
    return rates.join(broadcast_if_small(medians), same, "left").drop("_l", "_t")


def cv_table(folds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and range of metrics over folds."""
    long_rows = folds.unpivot(["fold"], list(metrics), "metric", "v")
    return long_rows.groupBy("metric").agg(
        F.count("*").alias("k"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
    )


def flat_predictions(df: DataFrame, classes: Sequence[str], keep: Sequence[str], digits: int = 5) -> DataFrame:
    """Prediction export: one ``p_<class>`` column per class, numbers rounded."""
    probs = [F.round(F.get("probs", F.lit(i)), digits).alias(f"p_{c}") for i, c in enumerate(classes)]
    rounded = [
        F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in df.select(*keep).dtypes
    ]
    return df.select(*rounded, *probs)


