"""Counts, cross tables, descriptions and histograms of a collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.operators.ordered import bracketed_quantiles, quantiles
from sievemark.session import broadcast_if_small


def value_counts(df: DataFrame, column: str | Column, name: str = "value") -> DataFrame:
    c = F.col(column) if isinstance(column, str) else column
    return df.groupBy(c.alias(name)).agg(F.count("*").alias("n"))


def zero_filled_counts(df: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    """One row per listed class, in list order, also for classes without rows."""
    frame = df.sparkSession.range(len(classes)).select(
        F.col("id").cast("int").alias("position"),
        F.get(F.array(*[F.lit(c) for c in classes]), F.col("id").cast("int")).alias(column),
    )
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return frame.join(counts, column, "left").select("position", column, F.coalesce("n", F.lit(0)).alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str], min_total: int = 0) -> DataFrame:
    """Wide counts; ``min_total`` drops rows with fewer records over all columns."""
    wide = df.groupBy(row).pivot(column, list(values)).count().na.fill(0)
    if min_total:
        total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
        wide = wide.where(total >= min_total)
    return wide


def long_measures(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Wide measure columns as (keys, measure, value) rows without NULL values."""
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot(
        list(keys), list(measures), "measure", "value"
    ).where("value is not null")


def describe(long_rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and five percentiles per group; exact at any size."""
    probs = {"p01": 0.01, "p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99}
    return bracketed_quantiles(long_rows, "value", probs, by, [F.avg("value").alias("mean")])


def describe_spread(long_rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per group, rounded to 4 digits."""
    moments = [
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]
    joined = bracketed_quantiles(long_rows, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, by, moments)
    return joined.select(
        *by, "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]
    )


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """Largest class over the smallest one (taken as at least 1)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg((F.max("n") / F.greatest(F.min("n"), F.lit(1))).alias("imbalance_ratio"))


def reason_histogram(df: DataFrame, issues: str) -> DataFrame:
    """Rows per issue kind: the part before a colon."""
    return (
        df.select(F.explode(issues).alias("issue"))
        .groupBy(F.substring_index("issue", ":", 1).alias("reason"))
        .agg(F.count("*").alias("n"))
    )


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """How many groups have each size."""
    return df.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def equal_width_histogram(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """Zero-filled bins over [low, high]; the last bin includes its upper edge."""
    width = (high - low) / bins
    index = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).between(low, high)).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").na.fill(0, ["n"])


def boxplot(long_rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Quartiles and whiskers: the extreme values within 1.5 IQR of the box."""
    box = broadcast_if_small(bracketed_quantiles(long_rows, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by))
    fence = (F.col("q3") - F.col("q1")) * 1.5
    inside = long_rows.join(box, list(by)).where(
        (F.col("value") >= F.col("q1") - fence) & (F.col("value") <= F.col("q3") + fence)
    )
    return inside.groupBy(*by, "q1", "median", "q3").agg(
        F.min("value").alias("low_whisker"), F.max("value").alias("high_whisker")
    )


def latency(df: DataFrame, value: str, by: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """p50 and p95; ``approximate`` keeps one bounded sketch per group instead of sorting."""
    if approximate:
        return df.groupBy(*by).agg(
            F.percentile_approx(value, 0.5, 10000).alias("p50"), F.percentile_approx(value, 0.95, 10000).alias("p95")
        )
    return quantiles(df, value, {"p50": 0.5, "p95": 0.95}, by)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes · count) per class, from the class counts only."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    rows_per_class = counts.agg(F.sum("n") / F.count("*")).scalar()
    return counts.select(label, "n", (rows_per_class / F.col("n")).alias("weight"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Counts and their share of all rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.select(column, "n", (F.col("n") / counts.agg(F.sum("n")).scalar()).alias("share"))


def labels_differ(df: DataFrame, key: str, label: str) -> DataFrame:
    """Copies of each content and whether their labels differ (min against max, no distinct)."""
    return df.groupBy(key).agg(
        F.count("*").alias("copies"), (F.min(label) != F.max(label)).alias("differs")
    )


def profile(manifest: DataFrame, label: str, measures: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """The data profile as one long table (section, key, stat, value).

    ``manifest`` has is_valid, status, the given label, text columns to count and measures.
    """
    def rows(df: DataFrame, section: str, key: Column, value: Column, stat: Column) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"), key.cast("string").alias("key"), stat.alias("stat"), value.cast("double").alias("value")
        )

    count = F.lit("count")
    totals = manifest.agg(F.count("*").alias("files"), F.count_if("is_valid").alias("valid"))
    out = rows(
        totals.selectExpr("stack(2, 'files', files, 'valid', valid) as (key, v)"), "totals", F.col("key"), F.col("v"), count
    )
    out = out.unionByName(rows(value_counts(manifest, "status"), "status", F.col("value"), F.col("n"), count))
    for c in texts:
        out = out.unionByName(rows(value_counts(manifest.where("is_valid"), c), c, F.col("value"), F.col("n"), count))
    ok = manifest.where("status = 'ok'")
    out = out.unionByName(rows(value_counts(ok, label), "clean_" + label, F.col("value"), F.col("n"), count))
    out = out.unionByName(rows(imbalance(ok, label), "imbalance", F.lit("all"), F.col("imbalance_ratio"), F.lit("ratio")))
    described = describe(long_measures(ok, [label], measures), [label, "measure"])
    stats = ["mean", "p01", "p25", "median", "p75", "p99"]
    for_each = described.unpivot([label, "measure"], stats, "stat", "v")
    return out.unionByName(
        rows(for_each, "describe", F.concat_ws("/", label, "measure"), F.col("v"), F.col("stat"))
    )


def profile_sections(
    manifest: DataFrame,
    label: str,
    split: str,
    pattern: str,
    classes: Sequence[str],
    splits: Sequence[str],
    sides: tuple[str, str],
    group: str,
    min_pattern: int = 5,
    common: int = 10,
) -> DataFrame:
    """The tables beside :func:`profile` as one long table (section, key, stat, value).

    Class by given split over all rows (a missing class is ``?``), name pattern by class over kept rows (patterns of
    at least ``min_pattern`` rows), the most common sizes, warnings and described sides of valid rows, how many
    groups of kept rows have each size, and per class the longer side and the size in KiB. Pairs that do not occur
    are 0. The first two are pivots over given values, so they need no scan for the columns.
    """
    valid, ok = manifest.where("is_valid"), manifest.where("status = 'ok'")

    def rows(df: DataFrame, section: str, key: str | Column, stat: str | Column, value: str | Column) -> DataFrame:
        cells = {"key": (key, "string"), "stat": (stat, "string"), "value": (value, "double")}
        return df.select(
            F.lit(section).alias("section"),
            *[(F.col(c) if isinstance(c, str) else c).cast(t).alias(n) for n, (c, t) in cells.items()],
        )

    def crossed(df: DataFrame, section: str, row: str, column: str, values: Sequence[str], least: int) -> DataFrame:
        wide = crosstab(df.select(F.col(row).alias("key"), F.col(column).alias("c")), "key", "c", values, least)
        return rows(wide.unpivot("key", list(values), "stat", "value"), section, "key", "stat", "value")

    def described(df: DataFrame, section: str, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
        table = describe(long_measures(df, keys, measures), [*keys, "measure"])
        long = table.unpivot([*keys, "measure"], ["mean", "p01", "p25", "median", "p75", "p99"], "stat", "value")
        return rows(long, section, F.concat_ws("/", *keys, "measure"), "stat", "value")

    count = F.lit("count")
    size = F.concat_ws("x", *[F.col(c).cast("long") for c in sides])
    sizes = value_counts(valid.where(F.col(sides[0]).isNotNull() & F.col(sides[1]).isNotNull()), size)
    shape = ok.select(label, F.greatest(*sides).alias("long_side"), (F.col("bytes") / 1024).alias("kb"))
    parts = [
        crossed(manifest.withColumn(label, F.coalesce(label, F.lit("?"))), f"{split}_by_class", label, split, splits, 0),
        crossed(ok.where(F.col(pattern).isNotNull()), "pattern_by_class", pattern, label, classes, min_pattern),
        rows(sizes.orderBy(F.col("n").desc(), "value").limit(common), "common_size", "value", count, "n"),
        rows(reason_histogram(valid, "warnings"), "warning", "reason", count, "n"),
        rows(group_sizes(ok, group), "group_size", "size", F.lit("groups"), "groups"),
        described(valid, "sides", [], list(sides)),
        described(shape.where(F.col(label).isNotNull()), "resolution_by_class", [label], ["long_side", "kb"]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
