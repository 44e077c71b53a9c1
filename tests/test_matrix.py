from __future__ import annotations

import json

from sievemark.operators.matrix import FIELDS, result_matrix
from sievemark.sources.tables import read_variants

EVAL = {"model": "wave", "val": {"macro_f1": 0.5}, "test": {"macro_f1": 0.25, "errors": 3, "bootstrap_95ci": {"macro_f1": {"lo": 0.125, "hi": 0.5}}}}
OOD = {
    "scorer": "knn", "test": {"knn": {"near": {"auroc": 0.75}, "far": {"auroc": 1}}, "msp": {"near": {"auroc": 0}}},
    "decisions": {"test": {"accepted_share": 0.5}, "ood_test": {"counts": {"accepted:None": 4, "rejected:x": 1}}},
}


def test_documents_of_differing_shape(spark, tmp_path):
    files = {
        "eval/a/metrics.json": EVAL,
        "eval/b/metrics.json": {"model": 7, "test": {"macro_f1": "high", "errors": 1.5}, "more": [1, {"x": None}]},
        "eval/c d+e/metrics.json": {"test": {"macro_f1": 1}},
        "ood/a/ood.json": OOD,
        "ood/b/ood.json": {"scorer": "absent", "test": {"knn": {"near": {"auroc": 1}}}},
        "benchmark/a.json": {"onnx_mb": 1.5, "model_only": {"p50_ms": 2}},
        "metrics/paired.json": {"main": "a", "comparisons": {"b": {"diff": -0.5, "lo": -1, "hi": 0}}},
        "notes/a.json": {"model": "other"},
    }
    for name, doc in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(doc, indent=1))
    (tmp_path / "robustness" / "a").mkdir(parents=True)
    (tmp_path / "robustness" / "a" / "robustness.json").write_text('{"relative_robustness": ')  # cut off
    docs = read_variants(spark, str(tmp_path))
    assert docs.count() == 8 and docs.where("doc is null").count() == 1
    bundles = spark.createDataFrame([("a",), ("b",), ("c d+e",), ("none",)], "bundle string")
    rows = {r.bundle: r.asDict() for r in result_matrix(bundles, docs).collect()}
    a = rows["a"]
    assert (a["model"], a["val_macro_f1"], a["test_macro_f1"], a["test_ci_low"], a["test_errors"]) == ("wave", 0.5, 0.25, 0.125, 3)
    assert (a["ood_scorer"], a["ood_auroc_near"], a["ood_auroc_far"], a["ood_test_accepted"]) == ("knn", 0.75, 1.0, 4)
    assert a["is_main"] and a["onnx_mb"] == 1.5 and a["latency_model_p50_ms"] == 2.0 and a["relative_robustness_sev1_3"] is None
    b = rows["b"]
    assert b["test_macro_f1"] is None and b["ood_scorer"] == "absent" and b["ood_auroc_near"] is None
    assert (b["diff_main_minus_this"], b["paired_ci_low"], b["paired_ci_high"], b["is_main"]) == (-0.5, -1.0, 0.0, False)
    assert rows["c d+e"]["test_macro_f1"] == 1.0
    assert all(v is None for k, v in rows["none"].items() if k not in ("bundle", "is_main"))


def test_no_documents(spark):
    docs = spark.createDataFrame([], "bundle string, kind string, value string").selectExpr("bundle", "kind", "try_parse_json(value) as doc")
    (row,) = result_matrix(spark.createDataFrame([("a",)], "bundle string"), docs).collect()
    assert len(row) == len(FIELDS) + 5 and row.test_macro_f1 is None and row.is_main is False
