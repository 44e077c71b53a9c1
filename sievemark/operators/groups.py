"""Duplicate statuses, near-duplicate conflicts and leakage groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.text import matches_any
from sievemark.operators.components import connected_components
from sievemark.operators.near_groups import LINK, MIXED, SUMS, near_facts
from sievemark.operators.ordered import with_position
from sievemark.operators.pairs import variant_pairs
from sievemark.session import freeze, stored


SMALL_GRAPH = 200_000  # links that one task may join


def base_status(
    valid: Column, path: Column | str, patterns: Sequence[str] = (), excluded: Column | None = None
) -> Column:
    """invalid → excluded_pattern → excluded → ok, the first that applies."""
    status = F.when(~valid, "invalid")
    if patterns:
        status = status.when(matches_any(path, patterns), "excluded_pattern")
    if excluded is not None:
        status = status.when(F.coalesce(excluded, F.lit(False)), "excluded")
    return status.otherwise("ok")


def mark_exact(df: DataFrame, path: str, digest: str, label: str) -> DataFrame:
    """Adds ``duplicate_of`` and refines ``status`` of rows that are still ok.

    Equal content with one label keeps its first path; with several labels every copy is a conflict.
    Per-content facts come from an aggregate with map-side combine rather than a window, so a group
    that holds a third of the rows is never gathered in one task. The facts are stored before they
    are joined back: only then does a plain shuffle lie on both sides, which AQE splits at a hot key.
    A missing label is not a label of its own.
    """
    ok = df.where("status = 'ok'")
    facts = stored(
        ok.groupBy(digest)
        .agg(
            F.count("*").alias("_copies"),
            F.min(path).alias("_keeper"),
            F.min(label).alias("_low"),
            F.max(label).alias("_high"),
        )
        .where("_copies > 1"),
        "contents",
    )
    joined = df.join(facts, digest, "left")
    mine = (F.col("status") == "ok") & F.col("_copies").isNotNull()
    conflict = mine & F.coalesce(F.col("_low") != F.col("_high"), F.lit(False))
    copy = mine & ~conflict & (F.col(path) != F.col("_keeper"))
    return (
        joined.withColumn("duplicate_of", F.when(copy, F.col("_keeper")))
        .withColumn(
            "status", F.when(conflict, "conflict").when(copy, "duplicate").otherwise(F.col("status"))
        )
        .drop("_copies", "_keeper", "_low", "_high")
        .select(*df.columns, "duplicate_of")
    )


def content_nodes(ok: DataFrame, path: str, signature: str, label: str) -> DataFrame:
    """One node per (signature, label) with its first path and size: copies are collapsed here.

    Records without a signature resemble nothing and have no node.
    """
    return ok.where(F.col(signature).isNotNull()).groupBy(F.col(signature).alias("signature"), F.col(label).alias("label")).agg(
        F.min(path).alias("node"), F.count("*").alias("n")
    )


def near_conflicts(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes with a differently labelled node at the same or a near signature."""
    span = stored(nodes.groupBy("signature").agg(F.min("label").alias("low"), F.max("label").alias("high")), "spans")
    reached = pairs.select("a", "b").unionByName(
        pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    ).unionByName(span.where("low <> high").select(F.col("signature").alias("a"), F.col("signature").alias("b")))
    seen = stored(
        reached.join(span, F.col("b") == F.col("signature"))
        .groupBy("a")
        .agg(F.min("low").alias("low"), F.max("high").alias("high")),
        "seen",
    )
    return (
        nodes.join(seen, F.col("signature") == F.col("a"))
        .where((F.col("low") != F.col("label")) | (F.col("high") != F.col("label")))
        .select("node")
    )


def near_links(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links between nodes of one label at near signatures."""
    left, right = nodes.alias("na"), nodes.alias("nb")
    return (
        pairs.join(left, F.col("a") == F.col("na.signature"))
        .join(right, (F.col("b") == F.col("nb.signature")) & (F.col("na.label") == F.col("nb.label")))
        .select(F.col("na.node").alias("a"), F.col("nb.node").alias("b"))
    )


def near_pair_counts(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Record pairs within reach and how many of them cross labels, from node sizes alone."""
    totals = nodes.groupBy("signature").agg(
        F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) div 2")).alias("same")
    )
    ta, tb = totals.alias("ta"), totals.alias("tb")
    across = (
        pairs.join(ta, F.col("a") == F.col("ta.signature"))
        .join(tb, F.col("b") == F.col("tb.signature"))
        .agg(F.coalesce(F.sum(F.col("ta.n") * F.col("tb.n")), F.lit(0)).alias("pairs"))
    )
    left, right = nodes.alias("na"), nodes.alias("nb")
    across_same = (
        pairs.join(left, F.col("a") == F.col("na.signature"))
        .join(right, (F.col("b") == F.col("nb.signature")) & (F.col("na.label") == F.col("nb.label")))
        .agg(F.coalesce(F.sum(F.col("na.n") * F.col("nb.n")), F.lit(0)).alias("same"))
    )
    inside = totals.agg(
        F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum("same"), F.lit(0)).alias("same"),
    )
    parts = (
        across.select("pairs", F.lit(0).cast("long").alias("same"))
        .unionByName(across_same.select(F.lit(0).cast("long").alias("pairs"), "same"))
        .unionByName(inside)
    )
    return parts.agg(
        F.sum("pairs").cast("long").alias("near_pairs"),
        (F.sum("pairs") - F.sum("same")).cast("long").alias("cross_label_pairs"),
    )


def met_counts(nodes: DataFrame, met: DataFrame) -> DataFrame:
    """The counts of :func:`near_pair_counts` from the sums of :func:`near_facts` and the copies in each node."""
    copies = F.expr("n * (n - 1) div 2")
    inside = nodes.select(copies.alias("pairs"), copies.alias("same"))
    both = met.where(F.col("kind") == SUMS).select("pairs", "same").unionByName(inside)
    return both.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("near_pairs"),
        F.coalesce(F.sum(F.col("pairs") - F.col("same")), F.lit(0)).cast("long").alias("cross_label_pairs"),
    )


def number_groups(members: DataFrame, group: str, first_seen: str) -> DataFrame:
    """``(group, group_id)`` numbered 0, 1, … by the smallest ``first_seen`` of each group."""
    firsts = members.groupBy(group).agg(F.min(first_seen).alias("_first"))
    placed = with_position(firsts, ["_first"], name="_position")
    return placed.select(group, (F.col("_position") - 1).alias("group_id"))


def near_counts(
    manifest: DataFrame, path: str = "path", digest: str = "sha256", label: str = "label", signature: str = "signature", max_distance: int = 5
) -> DataFrame:
    """The near-pair counts of :func:`assign_groups` over plain signatures, without its components and group numbers."""
    ok = mark_exact(manifest, path, digest, label).where("status = 'ok'").select(path, signature, label)
    nodes = freeze(content_nodes(ok, path, signature, label))
    return met_counts(nodes, stored(near_facts(nodes, max_distance), "met"))


def assign_groups(
    manifest: DataFrame,
    path: str = "path",
    digest: str = "sha256",
    label: str = "label",
    signature: str = "signature",
    max_distance: int = 5,
    similar: DataFrame | None = None,
    variants: DataFrame | None = None,
    variant_list: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Final ``status``, ``duplicate_of`` and ``group_id`` per row, and the near-pair counts.

    ``manifest`` carries ``status`` from :func:`base_status`. ``similar`` holds further links
    (a, b) between paths of one label, for example from cosine pairs. ``variants`` replaces the
    plain signature pairs by pairs (a, b) of signatures found over turned and mirrored variants.
    ``variant_list`` names a column with all signatures of a row, its own first: they are used if no row that
    is still ok lacks them, else the plain signatures are.
    Rows in near conflict leave their group but still connect the rows around them. A row without a
    signature is a group of its own unless ``similar`` links it.
    """
    marked = freeze(mark_exact(manifest, path, digest, label))
    ok = marked.where("status = 'ok'").select(path, signature, label)
    nodes = freeze(content_nodes(ok, path, signature, label))
    if variants is None and variant_list:
        lists = marked.where("status = 'ok'").select(F.col(signature).alias("signature"), F.col(variant_list).alias("v"))
        if lists.where("v is null").isEmpty():
            variants = variant_pairs(lists.distinct(), "signature", "v", max_distance)
    if variants is not None:
        pairs = freeze(variants.select("a", "b"))
        bad = freeze(near_conflicts(nodes, pairs))
        links, counts = near_links(nodes, pairs), near_pair_counts(nodes, pairs)
    else:
        met = stored(near_facts(nodes, max_distance), "met")
        bad = met.where(F.col("kind") == MIXED).select(F.col("a").alias("node")).distinct()
        links, counts = met.where(F.col("kind") == LINK).select("a", "b"), met_counts(nodes, met)
    known = nodes.select(F.col("signature").alias("_s"), F.col("label").alias("_l"), "node")
    member = (
        ok.join(known, (ok[signature] == known["_s"]) & ok[label].eqNullSafe(known["_l"]))
        .select(path, "node")
        .unionByName(ok.where(F.col(signature).isNull()).select(path, F.col(path).alias("node")))
    )
    if similar is not None:
        ends = similar.join(member.select(F.col(path).alias("a"), F.col("node").alias("na")), "a").join(
            member.select(F.col(path).alias("b"), F.col("node").alias("nb")), "b"
        )
        links = links.unionByName(ends.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    parts = connected_components(links, in_task=SMALL_GRAPH)
    placed = (
        member.join(parts, "node", "left")
        .join(bad.withColumn("_bad", F.lit(True)), "node", "left")
        .select(path, F.coalesce("component", "node").alias("_group"), F.coalesce("_bad", F.lit(False)).alias("_bad"))
    )
    placed = freeze(placed)
    numbers = number_groups(placed.where("not _bad"), "_group", path)
    result = (
        marked.join(placed, path, "left")
        .join(numbers, "_group", "left")
        .withColumn("status", F.when(F.col("_bad"), "conflict").otherwise(F.col("status")))
        .withColumn("group_id", F.when(~F.col("_bad"), F.col("group_id")))
    )
    return result.select(*marked.columns, "group_id"), counts


def group_summary(grouped: DataFrame) -> DataFrame:
    """``(section, key, n)``: status counts, group count, largest group and group-size histogram."""
    status = grouped.groupBy("status").count().select(
        F.lit("status").alias("section"), F.col("status").alias("key"), F.col("count").alias("n")
    )
    sizes = grouped.where("group_id is not null").groupBy("group_id").agg(F.count("*").alias("size"))
    by_size = freeze(sizes.groupBy("size").agg(F.count("*").alias("n")))
    histogram = by_size.select(F.lit("groups_of_size").alias("section"), F.col("size").cast("string").alias("key"), "n")
    overall = by_size.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("groups"), F.coalesce(F.max("size"), F.lit(0)).alias("largest")
    )
    totals = overall.selectExpr("stack(2, 'groups', groups, 'largest_group', largest) as (key, n)").select(
        F.lit("total").alias("section"), "key", "n"
    )
    return status.unionByName(histogram).unionByName(totals)
