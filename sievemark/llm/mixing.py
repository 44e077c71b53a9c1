"""Operator 7: mixing sources to target weights with hash-threshold histograms.

Every source gets a target: sources in code point order (null last) take the weights 3, 1, 2 in turn and
share 150 % of all words; a target stops at twice the source's words and the excess goes to the others by
weight. Whole passes over a source are taken as often as they fit; the rest is a hash threshold. Words
are summed by source and by the first bits of a row hash, the bucket in which the budget ends is refined
by the next bits, and only its rows are read again. The final filter compares each row's hash with its
source's threshold: no row is sorted, and a smaller budget takes a subset of what a larger one takes.

The document at the boundary is taken if that ends closer to the target. Rows that agree in id and text
share their hash and so their fate.

Cases: a null text has size 0; a null source is a source of its own, the last one; sources without a word
have target 0; ids may be null or repeated. An empty table gives an empty table. Columns of the input
that have the name of an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.operators.ordered import with_position, with_running_sums
from sievemark.session import broadcast_if_small, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words
LIMIT = 2  # passes over one source
HASH_BITS = 60
STEP_BITS = 12  # 4,096 buckets a source and level


def size_column(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_column(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits of a digest of id and text."""
    both = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` from rows of ``(source, size)``."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_position(sources, [F.col("source").asc_nulls_last()], name="_rank")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.col("_rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = ranked.withColumn("_w", turn).withColumn("_cap", F.col("source_size") * F.lit(float(LIMIT)))
    weighed = weighed.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    summed = with_running_sums(weighed, ["_ratio", "_rank"], ["_cap", "_w"])
    # sources below the level that the remaining budget gives are capped; the first one above it sets the level
    budget = F.col("_cap_total") / LIMIT * SHARE - F.col("_cap_before")
    level = budget / (F.col("_w_total") - F.col("_w_before"))
    above = F.col("_cap") * (F.col("_w_total") - F.col("_w_before")) > F.col("_w") * budget
    summed = stored(summed.withColumns({"_level": level, "_above": above}), "shares")
    first = summed.where("_above").agg(F.min_by("_level", F.struct("_ratio", "_rank"))).first()[0]
    fair = F.col("_cap") if first is None else F.least("_cap", F.col("_w") * F.lit(first))
    return summed.select("source", "source_size", fair.alias("target"))


def thresholds(rows: DataFrame) -> DataFrame:
    """``(source, source_size, target, passes, threshold)`` from a stored table of ``(source, size, hash)``.

    A row is taken ``passes`` times, and once more if its hash is below the threshold.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = stored(targets(rows).withColumn("passes", passes), "targets")
    # the budget that is left, and the hash prefix at which it ends so far
    ends = goals.select(
        F.col("source").alias("_s"), (F.col("target") - F.col("passes") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix")
    )
    inside, shift = rows, HASH_BITS
    while shift:
        shift -= STEP_BITS
        if shift + STEP_BITS < HASH_BITS:  # only rows in the bucket where the budget of their source ends
            at = F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("hash", shift + STEP_BITS) == F.col("prefix"))
            inside = stored(inside.join(broadcast_if_small(ends), at, "left_semi"), "boundary")
        buckets = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        w = Window.partitionBy("source").orderBy("bucket")
        summed = buckets.withColumn("upto", F.sum("n").over(w))
        at = F.col("source").eqNullSafe(F.col("_s")) & (F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left"))
        found = summed.join(broadcast_if_small(ends), at)
        over, under = F.col("upto") - F.col("left"), F.col("left") - (F.col("upto") - F.col("n"))
        ends = stored(
            found.select(
                "_s", under.alias("left"), F.col("bucket").alias("prefix"),
                F.when(F.lit(shift == 0) & (over < under), 1).otherwise(0).alias("also"),
            ),
            "ends",
        )
    cut = ends.select("_s", (F.col("prefix") + F.col("also")).alias("threshold"))
    joined = goals.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return stored(joined.withColumn("threshold", F.coalesce("threshold", F.lit(0).cast("long"))), "thresholds")


def _measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.withColumns({"size": size_column(text), "hash": hash_column(doc_id, text)})


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words)."""
    given = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    docs = docs.select(*given)
    plain = docs.select(F.col(doc_id), F.col(text), F.col(source).alias("source"))
    rows = stored(_measured(plain, doc_id, text).select("source", "size", "hash"), "sizes")
    cuts = thresholds(rows).withColumnRenamed("source", "_s")
    marked = docs.withColumns({"_size": size_column(text), "_hash": hash_column(doc_id, text)})
    joined = marked.join(broadcast_if_small(cuts), F.col(source).eqNullSafe(F.col("_s")))
    copies = F.col("passes") + F.when(F.col("_hash") < F.col("threshold"), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long")).select(
        *given, F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("_size") * F.col("copies")).alias("taken")
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix: ``docs`` as often as it takes each."""
    columns = docs.columns
    taken = mix(docs, doc_id, text, source).where("copies > 0")
    return taken.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*columns)


def oracle() -> str:
    """The same mix as DuckDB SQL, with a sort in place of the histograms."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, {HASH_BITS // 4}))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, {float(LIMIT)}::DOUBLE * sum(size)::DOUBLE AS cap,
         [{', '.join(f'{w}.0' for w in WEIGHTS)}]::DOUBLE[] AS ws, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, ws[((r - 1) % {len(WEIGHTS)} + 1)::INT] AS wt FROM s),
c AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / wt, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         coalesce(sum(wt) OVER (ORDER BY cap / wt, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before,
         sum(cap) OVER () AS cap_total, sum(wt) OVER () AS w_total FROM w),
lv AS (
  SELECT *, cap_total / {LIMIT} * {SHARE}::DOUBLE - cap_before AS budget, w_total - w_before AS w_left FROM c),
lam AS (
  SELECT min_by(budget / w_left, (cap / wt, r)) AS l FROM lv WHERE cap * w_left > wt * budget),
t AS (
  SELECT source, source_size, CASE WHEN l IS NULL THEN cap ELSE least(cap, wt * l) END AS target FROM lv, lam),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
hs AS (SELECT source, h, sum(size)::DOUBLE AS n FROM d GROUP BY source, h),
cum AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM hs),
thr AS (
  SELECT p.source, h + CASE WHEN upto - (target - passes * source_size) < (target - passes * source_size) - (upto - n) THEN 1 ELSE 0 END AS cut
  FROM p JOIN cum ON p.source IS NOT DISTINCT FROM cum.source
  WHERE upto > target - passes * source_size AND upto - n <= target - passes * source_size)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN h < coalesce(cut, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN thr ON thr.source IS NOT DISTINCT FROM p.source
"""
