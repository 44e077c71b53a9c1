"""One row per model from result documents of differing shape, held as VARIANT.

Documents need no schema: a field that a document lacks, or holds in another type, is NULL, and fields that nothing
asks for are not parsed into columns. All fields come from one aggregation by model, without a join per kind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (column, kind of document, path in it, type). Paths under "chosen" start at the scorer that the document names.
FIELDS = (
    ("model", "eval", "$.model", "string"),
    ("val_macro_f1", "eval", "$.val.macro_f1", "double"),
    ("test_macro_f1", "eval", "$.test.macro_f1", "double"),
    ("test_ci_low", "eval", "$.test.bootstrap_95ci.macro_f1.lo", "double"),
    ("test_ci_high", "eval", "$.test.bootstrap_95ci.macro_f1.hi", "double"),
    ("test_errors", "eval", "$.test.errors", "long"),
    ("ece_after", "eval", "$.test.calibration.ece_after", "double"),
    ("relative_robustness_sev1_3", "robustness", "$.relative_robustness.severity_1_3", "double"),
    ("relative_robustness_sev1_5", "robustness", "$.relative_robustness.severity_1_5", "double"),
    ("background_only_acc", "robustness", "$.shortcut.background_only.accuracy", "double"),
    ("leaf_only_acc", "robustness", "$.shortcut.leaf_only.accuracy", "double"),
    ("ood_scorer", "ood", "$.scorer", "string"),
    ("ood_auroc_near", "chosen", "$.near.auroc", "double"),
    ("ood_auroc_far", "chosen", "$.far.auroc", "double"),
    ("accepted_share", "ood", "$.decisions.test.accepted_share", "double"),
    ("accepted_accuracy", "ood", "$.decisions.test.accepted_accuracy", "double"),
    ("ood_test_accepted", "ood", "$.decisions.ood_test.counts['accepted:None']", "long"),
    ("external_auroc", "external", "$.auroc", "double"),
    ("external_accuracy", "external", "$.accuracy", "double"),
    ("onnx_mb", "benchmark", "$.onnx_mb", "double"),
    ("params_m", "benchmark", "$.params_m", "double"),
    ("latency_model_p50_ms", "benchmark", "$.model_only.p50_ms", "double"),
    ("latency_model_p95_ms", "benchmark", "$.model_only.p95_ms", "double"),
    ("latency_end_to_end_p50_ms", "benchmark", "$.end_to_end.p50_ms", "double"),
)


def result_matrix(bundles: DataFrame, documents: DataFrame, fields: Sequence[tuple[str, str, str, str]] = FIELDS) -> DataFrame:
    """The fields of every row of ``bundles`` (bundle), from ``documents`` (bundle, kind, doc VARIANT), one of a kind for a bundle.

    A document of kind ``paired`` compares a main bundle with others: the main one gets ``is_main``, the others the
    difference and its interval. A name that ``fields`` moves to another path is read from there.
    """
    ood = documents.where("kind = 'ood'")
    scorers = F.try_variant_get("doc", "$.test", "map<string,variant>")
    chosen = ood.select("bundle", F.lit("chosen").alias("kind"), F.try_element_at(scorers, F.try_variant_get("doc", "$.scorer", "string")).alias("doc"))
    pairs = documents.where("kind = 'paired'").select("doc")
    main = pairs.select(F.try_variant_get("doc", "$.main", "string").alias("bundle"), F.lit("main").alias("kind"), "doc")
    others = pairs.select(F.explode(F.try_variant_get("doc", "$.comparisons", "map<string,variant>")).alias("bundle", "doc"))
    others = others.select("bundle", F.lit("compared").alias("kind"), "doc")
    rows = documents.where("kind <> 'paired'").select("bundle", "kind", "doc")
    for more in (chosen, main, others):
        rows = rows.unionByName(more)
    compared = [("diff_main_minus_this", "$.diff"), ("paired_ci_low", "$.lo"), ("paired_ci_high", "$.hi")]
    wanted = [*fields, *[(name, "compared", path, "double") for name, path in compared]]
    values = [
        F.max(F.when(F.col("kind") == kind, F.try_variant_get("doc", path, kept))).alias(name) for name, kind, path, kept in wanted
    ]
    is_main = F.coalesce(F.bool_or(F.col("kind") == "main"), F.lit(False)).alias("is_main")
    table = rows.where(F.col("bundle").isNotNull()).groupBy("bundle").agg(*values, is_main)
    return bundles.select("bundle").join(table, "bundle", "left").withColumn("is_main", F.coalesce("is_main", F.lit(False)))
