from __future__ import annotations


import pytest
from pyspark.sql import functions as F

from sievemark.operators import groups, splits
from sievemark.session import freeze


def manifest(spark, rows):
    """rows: (path, sha, label, signature)"""
    return spark.createDataFrame(rows, "path string, sha256 string, label string, signature long").withColumn("status", F.lit("ok"))


def test_precedence_copies_conflicts_and_bridges(spark):
    rows = [
        ("a1", "s1", "x", 0b0),
        ("a2", "s1", "x", 0b0),  # copy
        ("b1", "s2", "x", 0xF0),
        ("b2", "s2", "y", 0xF0),  # same content, two labels: both go
        ("c1", "s3", "x", 0b1),  # near a1
        ("c2", "s4", "x", 0b1111111 << 40),
        ("c3", "s5", "y", 0b1111110 << 40),  # near c2 under another label: both conflict
        ("c4", "s6", "x", (0b1111111 << 40) ^ (0b11 << 8)),  # near c2, too far from c3
        ("d1", "s7", "x", -1),
        ("e1", "s8", "y", 0b1111 << 20),
        ("e2", "s9", "y", 1 << 50 | 1 << 55 | 1 << 60),
    ]
    out, counts = groups.assign_groups(
        manifest(spark, rows), max_distance=2, similar=spark.createDataFrame([("e1", "e2")], "a string, b string")
    )
    got = {r.path: r for r in out.collect()}
    status = {p: r.status for p, r in got.items()}
    assert status == {
        "a1": "ok", "a2": "duplicate", "b1": "conflict", "b2": "conflict", "c1": "ok", "c2": "conflict",
        "c3": "conflict", "c4": "ok", "d1": "ok", "e1": "ok", "e2": "ok",
    }
    assert got["a2"].duplicate_of == "a1"
    g = {p: r.group_id for p, r in got.items() if r.group_id is not None}
    assert g == {"a1": 0, "c1": 0, "c4": 1, "d1": 2, "e1": 3, "e2": 3}
    c = counts.first()
    assert (c.near_pairs, c.cross_label_pairs) == (3, 1)


def test_conflicting_row_still_connects_its_neighbours(spark):
    # p - q - r are near in a row; q is also near a row of another label
    rows = [("p", "1", "x", 0b0000), ("q", "2", "x", 0b0011), ("r", "3", "x", 0b1111), ("z", "4", "y", 0b0011 | 1 << 40 | 1 << 41)]
    out, _ = groups.assign_groups(manifest(spark, rows), max_distance=2)
    got = {r.path: (r.status, r.group_id) for r in out.collect()}
    assert got["q"][0] == got["z"][0] == "conflict"
    assert got["p"] == ("ok", 0) and got["r"] == ("ok", 0)


def test_hot_copies_and_base_status(spark):
    rows = [(f"p{i:04d}", "hot" if i < 400 else f"s{i}", "x", 1 if i < 400 else i * 7919) for i in range(600)]
    df = manifest(spark, rows)
    df = df.withColumn("status", groups.base_status(F.col("path") != "p0000", "path", ["^p0001$"], F.col("path") == "p0002"))
    marked = groups.mark_exact(df, "path", "sha256", "label")
    got = {r.status: r.n for r in marked.groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert got == {"invalid": 1, "excluded_pattern": 1, "excluded": 1, "duplicate": 396, "ok": 201}
    assert {r.duplicate_of for r in marked.where("status = 'duplicate'").collect()} == {"p0003"}


@pytest.fixture(scope="module")
def grouped(spark):
    """Groups with mixed labels, one giant group, and labels with 1 to 5 groups of their own."""
    rows = []
    for g in range(900):
        for j in range(1 + g % 6):
            rows.append((f"g{g:03d}", "abc"[(g + (j == 4)) % 3]))
    rows += [("giant", "a")] * 250
    for n in range(1, 6):
        for g in range(n):
            rows += [(f"rare{n}.{g}", f"r{n}")] * 3
    rows = [(f"p{i}", g, c, f"s{i}") for i, (g, c) in enumerate(rows)]
    return freeze(spark.createDataFrame(rows, "path string, group_id string, class_id string, sha256 string"))


def test_groups_stay_whole_and_shares_are_near(grouped):
    out = splits.assign_splits(grouped, "group_id", "class_id").toPandas()
    assert len(out) == grouped.count() and (out.groupby("group_id")["split"].nunique() == 1).all()
    usual = out[(out["group_id"] != "giant") & out["class_id"].isin(list("abc"))]
    for _, part in usual.groupby("class_id"):
        share = part["split"].value_counts(normalize=True)
        assert abs(share["train"] - 0.7) < 0.04 and abs(share["val"] - 0.15) < 0.04 and abs(share["test"] - 0.15) < 0.04


def test_rare_labels_have_training_rows(grouped):
    out = splits.assign_splits(grouped, "group_id", "class_id").toPandas()
    for n in range(2, 6):
        assert "train" in set(out.loc[out["class_id"] == f"r{n}", "split"]), n


@pytest.mark.parametrize("folds", [5, 10, 20])
def test_turns_visit_all_folds_and_part_low_ones(folds):
    order = [(i * splits.stride(folds) + folds - 1) % folds for i in range(folds)]
    assert sorted(order) == list(range(folds))
    low = [f < 0.3 * folds for f in order + order[:1]]
    assert not any(a and b for a, b in zip(low, low[1:]))


def test_rows_without_a_group_are_kept(grouped):
    gaps = grouped.withColumn("group_id", F.when(F.length("path") > 3, F.col("group_id")))
    out = splits.assign_splits(gaps, "group_id", "class_id")
    assert out.count() == grouped.count() and out.where("group_id is null").select("split").distinct().count() == 1
    folds = splits.cv_folds(out, "group_id", "class_id", 4)
    assert folds.count() == 4 * out.where("split <> 'test'").count()


def test_leaks_are_found(spark, grouped):
    out = splits.assign_splits(grouped, "group_id", "class_id")
    splits.require_no_leaks(out, ["sha256", "group_id"])
    bad = spark.createDataFrame([(1, "train"), (1, "test")], "group_id int, split string")
    with pytest.raises(ValueError, match="group_id=1"):
        splits.require_no_leaks(bad, ["group_id"])


def test_fractions_must_fit(spark):
    assert splits.check_fractions(0.15, 0.15, 20, 0.7) == (3, 3)
    with pytest.raises(ValueError):
        splits.check_fractions(0.15, 0.15, 20, 0.5)
    with pytest.raises(ValueError):
        splits.check_fractions(0.15, 0.15, 10)


def test_folds_seal_the_test_rows(grouped):
    out = splits.assign_splits(grouped, "group_id", "class_id")
    cv = splits.cv_folds(out, "group_id", "class_id", 5).toPandas()
    open_rows = out.where("split <> 'test'").count()
    assert (cv.groupby("fold").size() == open_rows).all()
    val = cv[cv["role"] == "val"]
    assert len(val) == open_rows and val["path"].is_unique
    assert (val.groupby("group_id")["fold"].nunique() == 1).all()


def test_fingerprints(spark):
    lines = [("train", f"s{i % 40}", i % 3) for i in range(100)]
    make = lambda rows: spark.createDataFrame(rows, "split string, sha string, c int").repartition(4)
    value = lambda rows, classes=("a", "b"): splits.fingerprint(make(rows), ["split", "sha", "c"], classes).first()[0]
    base = value(lines)
    assert len(base) == 16 and value(lines[::-1]) == base
    assert value(lines[:-1]) != base and value(lines, ("b", "a")) != base and value(lines + lines[:1]) != base


def test_samples_do_not_depend_on_partitions(spark):
    a, b = spark.range(500).repartition(2), spark.range(500).repartition(11)
    pick = lambda d: [r.id for r in splits.sample_first(d, "id", 20, 5).collect()]
    assert pick(a) == pick(b) and len(set(pick(a))) == 20
    per = splits.sample_per_group(a.withColumn("g", F.col("id") % 3), "id", "g", 7).groupBy("g").count().collect()
    assert {r["count"] for r in per} == {7}
