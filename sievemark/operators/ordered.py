"""Global order without a single-task window: positions, running sums, exact order statistics.

A window without PARTITION BY (or with a handful of class labels) puts an unbounded group into one
task. Here rows are range-partitioned by the full sort key, written once, and each partition's
totals (one row per partition and group) are summed to give the offsets of the next partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sievemark.session import BROADCAST_ROWS, broadcast_if_small, freeze, stored

KLL_ITEMS = 800  # of a sketch; its ranks are off by less than half of KLL_REACH, nearly always
KLL_REACH = 0.01
_SLOT_BITS = 33  # layout of monotonically_increasing_id: partition above, row below


def _ranged(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    ordered = df.sort(*by, *order).withColumn("_slot", F.monotonically_increasing_id())
    return freeze(ordered).withColumn("_part", F.shiftright("_slot", _SLOT_BITS))


def _attach(ranged: DataFrame, starts: DataFrame, by: Sequence[str], extra: Sequence[str]) -> DataFrame:
    keys = [*by, "_part"]
    right = broadcast_if_small(starts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *extra))
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return ranged.join(right, cond).drop(*[f"_k_{k}" for k in keys])


def with_position(
    df: DataFrame,
    order: Sequence[Column | str],
    by: Sequence[str] = (),
    name: str = "position",
    total: str | None = None,
) -> DataFrame:
    """1-based row number in ``order`` (which must end in a unique key) within each ``by`` group,
    and the group's row count under the name ``total``.

    For groups that may be huge (classes, statuses, one busy user).
    """
    return unscan(numbered(scan(df, by, order), by, name, total))


def scan(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows in global order for :func:`numbered`, :func:`previous` and :func:`running_max`; end with :func:`unscan`.

    One sort, written once, serves every function that follows.
    """
    return _ranged(df, by, order)


def numbered(scanned: DataFrame, by: Sequence[str], name: str = "position", total: str | None = None) -> DataFrame:
    """1-based row number within ``by``, as :func:`with_position`, of rows that are in order already."""
    offset = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    parts = scanned.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min(offset).alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn(
        "_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    ).withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))
    placed = _attach(scanned, starts, by, ["_base", "_total"])
    placed = placed.withColumn(name, offset + F.col("_base") + 1)
    if total:
        placed = placed.withColumn(total, F.col("_total"))
    return placed.drop("_base", "_total")


def unscan(scanned: DataFrame) -> DataFrame:
    return scanned.drop("_slot", "_part")


def _carry(scanned: DataFrame, by: Sequence[str], tail: Column, over: Callable[[Column, WindowSpec], Column]) -> DataFrame:
    """One value per (group, partition), combined over the group's earlier partitions."""
    parts = scanned.groupBy(*by, "_part").agg(tail.alias("_tail"))
    earlier = Window.partitionBy(*by).orderBy("_part")
    return parts.withColumn("_carry", over(F.col("_tail"), earlier))


def previous(scanned: DataFrame, by: Sequence[str], columns: Sequence[str], prefix: str = "previous_") -> DataFrame:
    """The columns of the row before, within ``by``: a lag that never gathers a group in one task."""
    local = Window.partitionBy(*by, "_part").orderBy("_slot")
    starts = _carry(scanned, by, F.max_by(F.struct(*columns), "_slot"), lambda v, w: F.lag(v).over(w))
    out = _attach(scanned.withColumn("_local", F.lag(F.struct(*columns)).over(local)), starts, by, ["_carry"])
    before = F.coalesce("_local", "_carry")
    return out.withColumns({f"{prefix}{c}": before[c] for c in columns}).drop("_local", "_carry")


def running_max(scanned: DataFrame, by: Sequence[str], column: str, name: str) -> DataFrame:
    """Largest value over the earlier rows of the group (NULL on the first)."""
    local = Window.partitionBy(*by, "_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = _carry(
        scanned,
        by,
        F.max(column),
        lambda v, w: F.max(v).over(w.rowsBetween(Window.unboundedPreceding, -1)),
    )
    out = _attach(scanned.withColumn("_local", F.max(column).over(local)), starts, by, ["_carry"])
    return out.withColumn(name, F.greatest("_local", "_carry")).drop("_local", "_carry")


def with_running_sums(
    df: DataFrame,
    order: Sequence[Column | str],
    sums: Sequence[str],
    by: Sequence[str] = (),
    keep: Column | None = None,
) -> DataFrame:
    """Adds ``<c>_before`` (sum over earlier rows) and ``<c>_total`` for every column in ``sums``.

    ``keep`` is a condition on partition facts (``_base_<c>``, ``_part_<c>``, ``<c>_total``): only
    partitions that satisfy it are looked at further.
    """
    ranged = _ranged(df, by, order)
    parts = ranged.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_part_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    starts = parts.select(
        *by,
        "_part",
        *[F.col(f"_part_{c}") for c in sums],
        *[F.coalesce(F.sum(f"_part_{c}").over(earlier), F.lit(0)).alias(f"_base_{c}") for c in sums],
        *[F.sum(f"_part_{c}").over(whole).alias(f"{c}_total") for c in sums],
    )
    if keep is not None:
        starts = starts.where(keep)
    extra = [f"_base_{c}" for c in sums] + [f"{c}_total" for c in sums]
    placed = _attach(ranged, starts, by, extra)
    inside = (
        Window.partitionBy(*by, "_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    )
    for c in sums:
        local = F.coalesce(F.sum(c).over(inside), F.lit(0))
        placed = placed.withColumn(f"{c}_before", local + F.col(f"_base_{c}"))
    return placed.drop("_slot", "_part", *[f"_base_{c}" for c in sums])


def ranked_values(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    ranks: Callable[[Column], Sequence[Column]] | None = None,
) -> DataFrame:
    """Distinct values with ``n`` (copies), ``n_before`` (smaller rows) and ``n_total`` (rows).

    Equal values are counted before anything is sorted, so one hot value is a single row here. With
    ``ranks`` (0-based, from the total), partitions that hold none of them are skipped.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    keep = None
    if ranks:
        base, size = F.col("_base_n"), F.col("_part_n")
        keep = reduce(
            lambda a, b: a | b, [(r >= base) & (r < base + size) for r in ranks(F.col("n_total"))]
        )
    return with_running_sums(counts, [value], ["n"], by, keep)


def _holds(rank: Column) -> Column:
    return (rank >= F.col("n_before")) & (rank < F.col("n_before") + F.col("n"))


def _spot(p: float, total: Column) -> Column:
    return F.lit(float(p)) * (total - 1)


def _interpolated(value: str, p: float) -> Column:
    spot = _spot(p, F.col("n_total"))
    a = F.max(F.when(_holds(F.floor(spot)), F.col(value).cast("double")))
    b = F.max(F.when(_holds(F.ceil(spot)), F.col(value).cast("double")))
    return a + (b - a) * F.max(spot - F.floor(spot))


def quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per group, one column per entry."""

    def ranks(total: Column) -> list[Column]:
        return [f(_spot(p, total)) for p in probs.values() for f in (F.floor, F.ceil)]

    ranked = ranked_values(df, value, by, ranks)
    return ranked.groupBy(*by).agg(*[_interpolated(value, p).alias(n) for n, p in probs.items()])


def bracketed_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str], extra: Sequence[Column] = ()
) -> DataFrame:
    """:func:`quantiles` without sorting all values, and ``extra`` aggregates of the same scan.

    A first scan leaves one mergeable KLL sketch for each group, which brackets every wanted rank. The second
    counts: a value inside a bracket by itself, all others by the gap they lie in. Only these counts are put
    in order. A sketch may err; a rank that falls into a gap shows it, and then all values are sorted.
    NULL values are left out, and so are groups of nothing else; NaN is the largest value.
    """
    x = F.col(value).cast("double")
    marks = sorted(set(probs.values()))
    seen = F.count_if(~F.isnan(x))
    facts = df.groupBy(*by).agg(
        F.count(value).alias("_n"), seen.alias("_seen"), F.kll_sketch_agg_double(F.when(~F.isnan(x), x), F.lit(KLL_ITEMS)).alias("_s"), *extra
    )
    extras = [c for c in facts.columns if c not in (*by, "_n", "_seen", "_s")]
    bounds = {}
    for i, p in enumerate(marks):
        for side, rank in (("low", max(p - KLL_REACH, 0.0)), ("high", min(p + KLL_REACH, 1.0))):
            bounds[f"_{side}{i}"] = F.when(F.col("_seen") > 0, F.kll_sketch_get_quantile_double("_s", F.lit(rank)))
    facts = stored(facts.where("_n > 0").select(*by, *extras, *[c.alias(n) for n, c in bounds.items()]), "brackets")
    brackets = broadcast_if_small(facts.select(*[F.col(b).alias(f"_k_{b}") for b in by], *bounds))
    cond = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by])
    rows = df.where(F.col(value).isNotNull()).select(*by, x.alias("_x")).join(brackets, cond)
    above = reduce(lambda a, b: a + b, [F.coalesce((F.col("_x") > F.col(f"_high{i}")).cast("int"), F.lit(0)) for i in range(len(marks))])
    inside = reduce(lambda a, b: a | b, [F.col("_x").between(F.col(f"_low{i}"), F.col(f"_high{i}")) for i in range(len(marks))])
    counts = stored(rows.groupBy(*by, above.alias("_gap"), F.when(inside, F.col("_x")).alias("_x")).agg(F.count("*").alias("n")), "counts")
    order = ["_gap", F.col("_x").asc_nulls_first()]  # what lies outside a bracket lies before its values
    if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        w = Window.partitionBy(*by)
        earlier = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        ranked = counts.withColumns({"n_before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "n_total": F.sum("n").over(w)})
    else:
        ranked = with_running_sums(counts, order, ["n"], by)
    found = stored(ranked.groupBy(*by).agg(*[_interpolated("_x", p).alias(n) for n, p in probs.items()]), "quantiles")
    if not found.where(reduce(lambda a, b: a | b, [F.col(n).isNull() for n in probs])).isEmpty():
        found = quantiles(df, value, probs, by)
    if not extras:
        return found
    right = facts.select(*[F.col(b).alias(f"_k_{b}") for b in by], *extras)
    return found.join(right, cond).select(*found.columns, *extras)


def value_at_rank(
    df: DataFrame, value: str, rank: Callable[[Column], Column], by: Sequence[str] = (), name: str = "value"
) -> DataFrame:
    """The value at the 0-based rank that ``rank`` derives from the number of rows."""
    ranked = ranked_values(df, value, by, lambda total: [rank(total)])
    return ranked.where(_holds(rank(F.col("n_total")))).groupBy(*by).agg(F.max(value).alias(name))


def quantile_bin(position: Column, total: Column, bins: int) -> Column:
    """Bin 1..q of rank r among n, cut at equally spaced quantiles of the ranks (edges go down)."""
    return F.greatest(
        F.lit(1), F.ceil(((position - 1) * bins) / F.greatest(total - 1, F.lit(1)))
    ).cast("int")
