"""Per-run histories: stage starts, best steps and areas.

A run may be as long as the table (one busy user), so rows are put in global order once and every
lag or running maximum works on range partitions with a carried value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.operators.ordered import numbered, previous, running_max, scan, unscan


def stage_starts(rows: DataFrame, run: str, order: str, stage: str) -> DataFrame:
    """Continuous step number of each run and whether the stage differs from the step before."""
    steps = numbered(scan(rows.select(run, order, stage), [run], [order]), [run], "step")
    seen = previous(steps, [run], ["step", stage])
    changed = F.col("previous_step").isNull() | ~F.col(stage).eqNullSafe(F.col(f"previous_{stage}"))
    return unscan(seen.withColumn("starts", changed)).drop("previous_step", f"previous_{stage}")


def best_step(rows: DataFrame, run: str, order: str, value: Column) -> DataFrame:
    """First step with the highest value, as an aggregate (no window)."""
    scored = rows.where(value.isNotNull()).select(run, order, value.alias("_v"))
    best = scored.groupBy(run).agg(
        F.max(F.struct("_v", (-F.col(order)).alias("_o"))).alias("_b"), F.count("*").alias("steps")
    )
    return best.select(run, "steps", (-F.col("_b._o")).alias("best_step"), F.col("_b._v").alias("best_value"))


def running_best(rows: DataFrame, run: str, order: str, value: str) -> DataFrame:
    """Best value so far and steps since it last improved (patience)."""
    steps = numbered(scan(rows.select(run, order, value), [run], [order]), [run], "step")
    seen = running_max(steps, [run], value, "_before")
    improved = F.col("_before").isNull() | (F.col(value) > F.col("_before"))
    seen = seen.withColumn("_hit", F.when(improved, F.col("step")))
    seen = running_max(seen, [run], "_hit", "_last")
    out = seen.withColumn("best", F.greatest("_before", value)).withColumn(
        "patience", F.col("step") - F.greatest("_last", "_hit")
    )
    return unscan(out).drop("_before", "_hit", "_last")


def area_under(rows: DataFrame, run: str, x: str, y: str) -> DataFrame:
    """Trapezoid area per run, divided by its last x."""
    seen = previous(scan(rows.select(run, x, y), [run], [x]), [run], [x, y])
    piece = (F.col(x) - F.col(f"previous_{x}")) * (F.col(y) + F.col(f"previous_{y}")) / 2
    return seen.withColumn("_piece", piece).groupBy(run).agg((F.sum("_piece") / F.max(x)).alias("area"))
