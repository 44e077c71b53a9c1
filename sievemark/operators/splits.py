"""Leakage-safe splits, cross-validation folds, reproducible samples and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions.hashing import hash_order
from sievemark.operators.ordered import with_position


def group_folds(
    rows: DataFrame, group: str, label: str, folds: int, seed: int = 42
) -> DataFrame:
    """``(group, fold)``: groups dealt over folds so that sizes and label shares stay even.

    Groups are taken label after label, largest first (ties in hash order), and dealt in one go over
    all labels, so a label starts where the one before it stopped. One row per group is ordered,
    never the records; a group stays whole. Rows without a group count as one group.
    """
    cells = rows.groupBy(group, label).agg(F.count("*").alias("n"))
    sized = cells.groupBy(group).agg(
        F.sum("n").alias("_size"),
        F.min_by(F.col(label), F.struct(-F.col("n"), F.col(label))).alias("_main"),
    )
    return deal(sized, group, "_main", "_size", folds, seed)


def deal(
    groups: DataFrame, group: str, main: str, size: str, folds: int, seed: int = 42
) -> DataFrame:
    """Deals sized groups to folds in turn, label after label.

    Neighbouring turns go to folds a stride apart. The folds that later become test and validation
    have low numbers, so two groups in a row never both land there: a label with few groups has
    training rows.
    """
    keyed = groups.withColumn("_shuffle", hash_order(seed, group))
    placed = with_position(
        keyed, [F.col(main), F.col(size).desc(), F.col("_shuffle"), F.col(group)], name="_rank"
    )
    fold = F.pmod((F.col("_rank") - 1) * stride(folds) + folds - 1, F.lit(folds))
    return placed.select(group, fold.cast("int").alias("fold"))


def stride(folds: int) -> int:
    """The smallest step of at least a third of the folds that visits all of them."""
    return next(s for s in range(max(1, -(-folds // 3)), folds + 2) if gcd(s, folds) == 1)


def check_fractions(val: float, test: float, folds: int, train: float | None = None) -> tuple[int, int]:
    """Numbers of validation and test folds; raises when the fractions do not fit the folds."""
    if train is not None and abs(train + val + test - 1.0) > 1e-6:
        raise ValueError("train, val and test must sum to 1")
    for share in (val, test):
        if abs(share * folds - round(share * folds)) > 1e-6:
            raise ValueError("val and test must be whole numbers of folds")
    return round(val * folds), round(test * folds)


def split_of_fold(fold: Column | str, n_val: int, n_test: int) -> Column:
    f = F.col(fold) if isinstance(fold, str) else fold
    return F.when(f < n_test, "test").when(f < n_test + n_val, "val").otherwise("train")


def assign_splits(
    rows: DataFrame,
    group: str,
    label: str,
    val: float = 0.15,
    test: float = 0.15,
    folds: int = 20,
    seed: int = 42,
) -> DataFrame:
    """Adds ``split``; every row of a group lands in the same one."""
    n_val, n_test = check_fractions(val, test, folds)
    dealt = group_folds(rows, group, label, folds, seed)
    return _with_fold(rows, dealt, group).withColumn("split", split_of_fold("fold", n_val, n_test)).drop("fold")


def _with_fold(rows: DataFrame, dealt: DataFrame, group: str) -> DataFrame:
    """Every row with the fold of its group, rows without a group too."""
    known = dealt.select(F.col(group).alias("_group"), "fold")
    return rows.join(known, rows[group].eqNullSafe(known["_group"])).drop("_group")


def cv_folds(rows: DataFrame, group: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Long table with one row per (fold, record) and its ``role``; test rows stay sealed."""
    open_rows = rows.where("split in ('train', 'val')").drop("split")
    own = _with_fold(open_rows, group_folds(open_rows, group, label, folds, seed), group).withColumnRenamed("fold", "_own")
    return (
        own.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
        .withColumn("role", F.when(F.col("fold") == F.col("_own"), "val").otherwise("train"))
        .drop("_own")
    )


def leaks(rows: DataFrame, keys: Sequence[str], split: str = "split") -> DataFrame:
    """Values of ``keys`` found in more than one split; empty means no leak.

    One aggregation per key, with min and max instead of a distinct count.
    """
    out = None
    for key in keys:
        found = (
            rows.groupBy(F.col(key).cast("string").alias("value"))
            .agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"))
            .where("first_split <> last_split")
            .select(F.lit(key).alias("key"), "value", "first_split", "last_split")
        )
        out = found if out is None else out.unionByName(found)
    return out


def require_no_leaks(rows: DataFrame, keys: Sequence[str], split: str = "split") -> None:
    worst = leaks(rows, keys, split).limit(1).collect()
    if worst:
        r = worst[0]
        raise ValueError(f"{r['key']}={r['value']} is in {r['first_split']} and {r['last_split']}")


def balance(rows: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Counts per label and split with both margins (``total``)."""
    cube = rows.groupBy(label, split).count().cube(label, split).agg(F.sum("count").alias("n"))
    return cube.select(
        F.coalesce(F.col(label), F.lit("total")).alias(label),
        F.coalesce(F.col(split), F.lit("total")).alias(split),
        "n",
    )


def sample_first(rows: DataFrame, key: str, n: int, seed: int | str = 0) -> DataFrame:
    """n rows in a reproducible shuffle order (a distributed top-n, no full sort)."""
    return rows.orderBy(hash_order(seed, key), F.col(key)).limit(n)


def sample_per_group(rows: DataFrame, key: str, by: str, n: int, seed: int | str = 0) -> DataFrame:
    """Up to n rows of each group in shuffle order.

    Spark prunes ``row_number() <= n`` before and after the shuffle, so a hot group sends each
    task's first n rows only.
    """
    order = Window.partitionBy(by).orderBy(hash_order(seed, key), F.col(key))
    return rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def fingerprint(rows: DataFrame, fields: Sequence[str], classes: Sequence[str], depth: int = 6) -> DataFrame:
    """Order-independent content hash of the lines ``a:b:c`` and the class list (16 hex digits).

    A hash tree: equal lines are first folded into one line with a count, lines are then grouped by
    hash prefix and hashed, two hex digits shorter at a time, so no task sees more than one small
    bucket. The value depends only on the multiset of lines.
    """
    line = F.concat_ws(":", *[F.col(f).cast("string") for f in fields])
    level = (
        rows.select(line.alias("line"))
        .groupBy("line")
        .agg(F.count("*").alias("n"))
        .select(F.sha2(F.concat_ws("#", "line", F.col("n").cast("string")), 256).alias("h"))
        .select(F.substring("h", 1, depth).alias("p"), "h")
    )
    for width in [*range(depth - 2, 0, -2), 0]:
        level = (
            level.groupBy("p")
            .agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"))
            .select(F.substring("p", 1, width).alias("p"), "h")
        )
    top = level.agg(F.array_join(F.array_sort(F.collect_list("h")), "\n").alias("h"))
    head = "classes:" + "|".join(classes)
    return top.select(
        F.substring(F.sha2(F.concat(F.lit(head + "\n"), F.coalesce("h", F.lit(""))), 256), 1, 16).alias("fingerprint")
    )
