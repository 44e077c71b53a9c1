"""Quality, foreignness and confidence gates: fitting thresholds and deciding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions.arrays import argmax, prediction_set
from sievemark.functions.rules import all_issues
from sievemark.operators.ordered import bracketed_quantiles, quantiles, with_running_sums

LADDER = (0.95, 0.96, 0.97, 0.98, 0.99, 0.995)


def quality_issues(
    brightness: Column,
    contrast: Column,
    sharpness: Column,
    green: Column,
    bounds: dict[str, float],
) -> Column:
    """Issues in fixed order; all comparisons are strict."""
    return all_issues(
        [
            ("too_dark", brightness < bounds["min_brightness"]),
            ("too_bright", brightness > bounds["max_brightness"]),
            ("too_blurry", sharpness < bounds["min_sharpness"]),
            ("low_contrast", contrast < bounds["min_contrast"]),
            ("no_leaf", green < bounds["min_green_frac"]),
        ]
    )


def percentile_bounds(long_rows: DataFrame, measure: str, value: str, percent: float = 0.5) -> DataFrame:
    """Lower and upper percentile of every measure."""
    return bracketed_quantiles(long_rows, value, {"low": percent / 100, "high": 1 - percent / 100}, [measure])


def degradation_thresholds(steps: DataFrame, percentiles: DataFrame, target: float = 0.9) -> DataFrame:
    """Threshold per measure from (measure, severity, accuracy, median_measure) rows.

    Midpoint of the first failing severity's median and the one before it (the percentile when the
    first severity fails); the last median when none fails; never above the percentile.
    """
    per_measure = Window.partitionBy("measure").orderBy("severity")  # a handful of severities
    marked = steps.withColumn("before", F.lag("median_measure").over(per_measure))
    bad = F.when(F.col("accuracy") < target, F.col("severity"))
    facts = marked.groupBy("measure").agg(
        F.min_by(F.struct("median_measure", "before"), bad).alias("fail"),
        F.count(bad).alias("fails"),
        F.max_by("median_measure", "severity").alias("last"),
    )
    joined = facts.join(percentiles, "measure")
    fitted = F.when(
        F.col("fails") > 0,
        (F.coalesce("fail.before", "percentile") + F.col("fail.median_measure")) / 2,
    ).otherwise(F.col("last"))
    return joined.select("measure", "percentile", F.least(fitted, F.col("percentile")).alias("threshold"))


def foreign_threshold(val: DataFrame, foreign: DataFrame, score: str = "score", max_accept: float = 0.01) -> DataFrame:
    """Last ladder level of val at which at most ``max_accept`` of the foreign rows pass.

    One row ``(level, tau)``; the first level when none qualifies. Six thresholds, one pass each.
    """
    names = {f"q{i}": q for i, q in enumerate(LADDER)}
    taus = quantiles(val, score, names).first()
    shares = foreign.agg(
        *[F.avg((F.col(score) <= taus[n]).cast("double")).alias(n) for n in names]
    ).first()
    good = [n for n in names if shares[n] is not None and shares[n] <= max_accept]
    pick = good[-1] if good else "q0"
    return val.sparkSession.range(1).select(
        F.lit(names[pick]).alias("level"), F.lit(float(taus[pick])).alias("tau")
    )


def confidence_threshold(passed: DataFrame, conf: str, correct: str, target: float = 0.99, default: float = 0.5) -> DataFrame:
    """Lowest confidence t with accuracy(conf ≥ t) ≥ target among rows past the gates."""
    steps = passed.groupBy(conf).agg(
        F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("hit")
    )
    run = with_running_sums(steps, [conf], ["n", "hit"])
    at_least = (F.col("hit_total") - F.col("hit_before")) / (F.col("n_total") - F.col("n_before"))
    return run.agg(
        F.coalesce(F.min(F.when(at_least >= target, F.col(conf))), F.lit(default)).alias("tau_conf")
    )


def decide(
    probs: Column | str,
    score: Column | str,
    issues: Column,
    classes: Sequence[str],
    tau: float | Column,
    qhat: float | Column,
    tau_conf: float | Column,
    advice: dict[str, str],
) -> Column:
    """Decision struct: quality gate, then foreignness, then set size and confidence.

    ``advice`` holds a text for each issue and for the reasons ``ood`` and ``low_confidence``.
    """
    p = F.col(probs) if isinstance(probs, str) else probs
    s = F.col(score) if isinstance(score, str) else score
    names = F.array(*[F.lit(c) for c in classes])
    texts = F.create_map(*[F.lit(v) for item in advice.items() for v in item])
    members = prediction_set(p, qhat)
    top = argmax(p)
    conf = F.array_max(p)
    low_quality = F.size(issues) > 0
    foreign = s > (tau if isinstance(tau, Column) else F.lit(float(tau)))
    sure = (F.size(members) == 1) & (conf >= (tau_conf if isinstance(tau_conf, Column) else F.lit(float(tau_conf))))
    rejected = low_quality | foreign
    nothing = F.array().cast("array<string>")
    reason = F.when(low_quality, "low_quality").when(foreign, "ood").when(~sure, "low_confidence")
    return F.struct(
        F.when(rejected, "rejected").when(sure, "accepted").otherwise("uncertain").alias("status"),
        reason.alias("reason"),
        F.when(~rejected, F.get(names, top)).alias("label"),
        F.when(~rejected, conf).alias("confidence"),
        F.when(rejected, nothing).otherwise(F.transform(members, lambda i: F.get(names, i))).alias("prediction_set"),
        F.when(low_quality, issues).otherwise(nothing).alias("issues"),
        F.when(low_quality, F.transform(issues, lambda i: texts[i]))
        .when(reason.isNotNull(), F.array(texts[reason]))
        .otherwise(nothing)
        .alias("advice"),
    )


def outcome(decision: str = "decision") -> Column:
    """``status:reason`` with ``None`` for no reason."""
    return F.concat(F.col(f"{decision}.status"), F.lit(":"), F.coalesce(f"{decision}.reason", F.lit("None")))


def decision_summary(df: DataFrame, true_label: str, decision: str = "decision", by: Sequence[str] = ()) -> DataFrame:
    """Accepted share and accuracy of accepted rows (NULL when none is accepted)."""
    accepted = F.col(f"{decision}.status") == "accepted"
    right = F.coalesce(F.col(f"{decision}.label") == F.col(true_label), F.lit(False))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(accepted.cast("double")).alias("accepted_share"),
        F.avg(F.when(accepted, right.cast("double"))).alias("accepted_accuracy"),
    )


def outcome_shares(df: DataFrame, by: Sequence[str] = (), decision: str = "decision") -> DataFrame:
    """Share of each outcome; a rejected row counts under its reason."""
    name = F.when(F.col(f"{decision}.status") == "rejected", F.col(f"{decision}.reason")).otherwise(
        F.col(f"{decision}.status")
    )
    counts = df.groupBy(*by, name.alias("outcome")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # at most four outcomes per group
    return counts.withColumn("share", F.col("n") / F.sum("n").over(whole))
