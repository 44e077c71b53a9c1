from __future__ import annotations

from sievemark.operators.aggregates import profile_sections

SCHEMA = (
    "is_valid boolean, status string, kind string, given string, pattern string, width long, height long, bytes long, "
    "warnings array<string>, batch string"
)


def sections(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = profile_sections(df, "kind", "given", "pattern", ["x", "y"], ["training", "validation"], ("width", "height"), "batch", min_pattern=2, common=2)
    found = [(r.section, r.key, r.stat) for r in out.select("section", "key", "stat").collect()]
    assert len(found) == len(set(found))
    return {(r.section, r.key, r.stat): r.value for r in out.collect()}


def test_sections_of_a_small_manifest(spark):
    rows = [
        (True, "ok", "x", "training", "img-#", 100, 80, 2048, ["aspect:1.2"], "b1"),
        (True, "ok", "x", "training", "img-#", 100, 80, 1024, [], "b1"),
        (True, "ok", "y", "validation", "img-#", 60, 90, 1024, [], "b2"),
        (True, "duplicate", "y", "validation", "scan", 60, 90, 1024, ["aspect"], "b2"),
        (True, "ok", "y", "training", None, 50, 50, 512, None, "b3"),
        (True, "ok", "y", "training", "lone", 40, 40, None, [], None),
        (False, "invalid", None, None, "img-#", None, None, 0, ["aspect"], None),
    ]
    got = sections(spark, rows)
    assert got["given_by_class", "x", "training"] == 2 and got["given_by_class", "x", "validation"] == 0
    assert got["given_by_class", "y", "training"] == 2 and got["given_by_class", "?", "training"] == 0
    assert {k[1:]: v for k, v in got.items() if k[0] == "pattern_by_class"} == {("img-#", "x"): 2, ("img-#", "y"): 1}
    assert {k[1]: v for k, v in got.items() if k[0] == "common_size"} == {"100x80": 2, "60x90": 2}
    assert {k[1]: v for k, v in got.items() if k[0] == "warning"} == {"aspect": 2}
    assert got["group_size", "2", "groups"] == 1 and got["sides", "width", "median"] == 60.0
    assert got["resolution_by_class", "x/long_side", "mean"] == 100.0 and got["resolution_by_class", "x/kb", "mean"] == 1.5
    assert got["resolution_by_class", "y/long_side", "median"] == 50.0


def test_an_empty_manifest_has_no_sections(spark):
    assert sections(spark, []) == {}
