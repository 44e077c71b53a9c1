"""Queries on robustness, explanations, severity, comparisons and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.functions import arrays, rules
from sievemark.functions.hashing import hash_uniform
from sievemark.operators import aggregates, joins, matrix, rollups
from sievemark.operators.metrics import cells, core_metrics, predicted
from sievemark.plans.datasets import CLASSES, LANGS, MANIFEST, SCORED, frozen_scored, manifest, scored
from sievemark.plans.duplicates import _PRECEDENCE, _precedence
from sievemark.plans.evaluation import _TWO, _sql_bins, _sql_metrics
from sievemark.plans.registry import Tables, query, rounded
from sievemark.session import freeze, scratch_path
from sievemark.sources import tables

CORRUPTIONS = ("blur", "noise")
FRACTIONS = tuple(i / 31 for i in range(32))  # half of an embedding's positions for each curve


# ---------------------------------------------------------------- corruption sweep


def _shaken(s: DataFrame) -> DataFrame:
    """Scored rows again under every (corruption, severity), severity 0 being the clean row.

    Logits get reproducible noise that grows with the severity.
    """
    steps = [("clean", 0, 0.0)] + [
        (c, v, v * (0.5 + 0.3 * i)) for i, c in enumerate(CORRUPTIONS) for v in range(1, 6)
    ]
    cells_ = F.array(
        *[F.struct(F.lit(c).alias("corruption"), F.lit(v).alias("severity"), F.lit(a).alias("size")) for c, v, a in steps]
    )
    rows = s.select("id", "model", "y", "logits", F.inline(cells_))
    seed = F.concat_ws(":", "corruption", F.col("severity").cast("string"), F.col("id").cast("string"))
    noise = F.transform(
        "logits",
        lambda z, k: z
        + F.col("size")
        * (F.conv(F.substring(F.md5(F.concat(seed, F.lit(":"), k.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0 - 0.5),
    )
    return predicted(rows.withColumn("logits", noise).withColumn("probs", arrays.softmax("logits"))).drop("logits", "probs")


_SHAKEN = _TWO + """, base AS (SELECT 'dot' AS model, id, y, logits FROM scored UNION ALL SELECT 'distance', id, y, logits FROM other),
step AS (SELECT 'clean' AS corruption, 0 AS severity, 0.0::DOUBLE AS size UNION ALL SELECT 'blur', v, v * 0.5::DOUBLE FROM range(1, 6) r(v) UNION ALL SELECT 'noise', v, v * 0.8::DOUBLE FROM range(1, 6) r(v)),
zn AS (SELECT model, id, y, corruption, severity, list_transform(logits, lambda z, k: z + size * (('0x' || substr(md5(corruption || ':' || severity || ':' || id || ':' || (k - 1)), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5::DOUBLE)) AS lg FROM base CROSS JOIN step),
zp AS (SELECT *, list_transform(lg, lambda z: exp(z - list_max(lg))) AS pw FROM zn),
zq AS (SELECT *, list_max(pw) / list_sum(pw) AS conf, (list_position(pw, list_max(pw)) - 1)::INT AS pred FROM zp),
shaken AS (SELECT *, pred = y AS correct, model || '/' || corruption || '/' || severity AS cell FROM zq)"""


def _sweep(t: Tables, both: bool = True) -> DataFrame:
    s = scored(t).withColumn("model", F.lit("dot"))
    if both:
        s = s.unionByName(scored(t, distance=True).withColumn("model", F.lit("distance")))
    return freeze(_shaken(s))


_CELL = ["model", "corruption", "severity"]


@query(f"""WITH {_SHAKEN}, {_sql_metrics('shaken', 'cell')}, bins AS (SELECT cell, len(list_filter(list_transform(range(1, 15), lambda i: i / 15.0::DOUBLE), lambda e: conf > e)) AS bin, count(*) AS n, avg(conf) AS c, avg(correct::INT) AS a FROM shaken GROUP BY 1, 2),
e AS (SELECT cell, sum(n * abs(a - c)) / sum(n) AS ece FROM bins GROUP BY 1), m AS (SELECT cell, model, corruption, severity, avg(conf) AS mc FROM shaken GROUP BY 1, 2, 3, 4)
SELECT model, corruption, severity::INT AS severity, n, errors, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall,
  round(mc, 6) AS mean_confidence, round(ece, 6) AS ece FROM core JOIN e USING (cell) JOIN m USING (cell)""")
def corruption_sweep(t: Tables):
    return rounded(rollups.score_block(_sweep(t), _CELL))


@query(f"""WITH {SCORED}, k AS (SELECT split, c FROM (SELECT DISTINCT split FROM scored) CROSS JOIN (SELECT unnest(range(8))::INT AS c))
SELECT k.split, k.c AS pred, count(s.id) AS predicted, count(s.id) FILTER (s.y <> s.pred) AS errors_to FROM k LEFT JOIN scored s ON s.split = k.split AND s.pred = k.c GROUP BY 1, 2""")
def prediction_counts(t: Tables):
    return rollups.prediction_counts(scored(t), CLASSES, ["split"])


def _sweep_scores(t: Tables) -> DataFrame:
    s = _sweep(t)
    means = s.groupBy(*_CELL).agg(F.avg("conf").alias("mean_confidence"))
    return freeze(core_metrics(cells(s, by=_CELL), _CELL).select(*_CELL, "macro_f1").join(means, _CELL))


@query(f"WITH {_SHAKEN} SELECT model, corruption, severity::INT AS severity, y, pred, count(*) AS n FROM shaken GROUP BY ALL")
def sweep_confusion(t: Tables):
    """The confusion cells of every corruption cell that :func:`corruption_sweep` scores."""
    return cells(_sweep(t), by=_CELL).select(*_CELL, "y", "pred", "n")


_SWEEP_F1 = f"""{_SHAKEN}, {_sql_metrics('shaken', 'cell')},
sure AS (SELECT cell, avg(conf) AS mean_confidence FROM shaken GROUP BY 1),
f1 AS (SELECT split_part(cell, '/', 1) AS model, split_part(cell, '/', 2) AS corruption, split_part(cell, '/', 3)::INT AS severity, macro_f1, mean_confidence FROM core JOIN sure USING (cell))"""


@query(f"""WITH {_SWEEP_F1} SELECT model, round(max(macro_f1) FILTER (severity = 0), 6) AS clean_macro_f1,
  round(avg(macro_f1) FILTER (severity BETWEEN 1 AND 3) / max(macro_f1) FILTER (severity = 0), 6) AS relative_1_3,
  round(avg(macro_f1) FILTER (severity BETWEEN 1 AND 5) / max(macro_f1) FILTER (severity = 0), 6) AS relative_1_5 FROM f1 GROUP BY 1""")
def relative_robustness(t: Tables):
    return rounded(rollups.relative_robustness(_sweep_scores(t), "model"))


@query(f"""WITH {_SWEEP_F1} SELECT model, round(max(macro_f1) FILTER (corruption = 'blur'), 6) AS blur_sev3_f1, round(max(macro_f1) FILTER (corruption = 'noise'), 6) AS noise_sev3_f1 FROM f1 WHERE severity = 3 GROUP BY 1""")
def sweep_summary(t: Tables):
    return rounded(rollups.sweep_summary(_sweep_scores(t), "model", CORRUPTIONS))


@query(f"""WITH {_SWEEP_F1} SELECT model, corruption, severity, round(macro_f1, 6) AS macro_f1, round(mean_confidence, 6) AS mean_confidence FROM f1 WHERE severity > 0
UNION ALL SELECT model, unnest(['blur', 'noise']), 0, round(macro_f1, 6), round(mean_confidence, 6) FROM f1 WHERE severity = 0""")
def degradation_curve(t: Tables):
    return rounded(rollups.degradation_curve(_sweep_scores(t), CORRUPTIONS))


# ---------------------------------------------------------------- shortcuts and explanations


def _masked(t: Tables) -> DataFrame:
    """Scored rows with a reproducible mask share and focus share per record."""
    return scored(t).withColumn("mask", hash_uniform("mask", "id")).withColumn("focus", hash_uniform("focus", "id"))


_MASKED = f"""{SCORED}, masked AS (SELECT *, ('0x' || substr(md5('mask:' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS mask, ('0x' || substr(md5('focus:' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS focus FROM scored)"""


@query(f"WITH {_MASKED} SELECT y, count(*) FILTER (mask <= 0.8) AS kept, count(*) FILTER (mask > 0.8) AS excluded FROM masked GROUP BY 1")
def shortcut_groups(t: Tables):
    return rollups.shortcut_groups(_masked(t), "mask")


@query(f"""WITH {_MASKED}, v AS (SELECT 'original' AS variant, id, y, pred FROM masked WHERE mask <= 0.8 UNION ALL SELECT 'foreground', id, y, CASE WHEN focus > 0.2 THEN pred ELSE 0 END FROM masked WHERE mask <= 0.8
  UNION ALL SELECT 'background', id, y, CASE WHEN focus > 0.9 THEN pred ELSE 0 END FROM masked WHERE mask <= 0.8), {_sql_metrics('v', 'variant')},
m AS (SELECT max(c)::DOUBLE / sum(c) AS majority_rate FROM (SELECT count(*) AS c FROM masked WHERE mask <= 0.8 GROUP BY y))
SELECT variant, n, errors, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(majority_rate, 6) AS majority_rate FROM core CROSS JOIN m""")
def shortcut_comparison(t: Tables):
    used = freeze(_masked(t).where("mask <= 0.8").select("id", "y", "pred", "focus"))
    guess = lambda limit: F.when(F.col("focus") > limit, F.col("pred")).otherwise(F.lit(0))
    variants = used.select("id", "y", F.lit("original").alias("variant"), "pred")
    for name, limit in (("foreground", 0.2), ("background", 0.9)):
        variants = variants.unionByName(used.select("id", "y", F.lit(name).alias("variant"), guess(limit).alias("pred")))
    scores = core_metrics(cells(variants, by=["variant"]), ["variant"]).select("variant", "n", "errors", "accuracy", "macro_f1")
    return rounded(scores.withColumn("majority_rate", rollups.majority_rate(used, "y").scalar()))


@query(f"""WITH {_MASKED} SELECT count(*) AS n_used, round(avg(focus), 6) AS mean_focus, round(avg(mask), 6) AS mean_mask,
  round(avg(focus) FILTER (correct), 6) AS focus_right, round(avg(focus) FILTER (NOT correct), 6) AS focus_wrong FROM masked WHERE mask <= 0.8""")
def focus_summary(t: Tables):
    return rounded(rollups.focus_summary(_masked(t), "focus", "mask"))


@query(f"WITH {_MASKED} SELECT y, round(avg(focus), 6) AS mean_focus FROM masked WHERE mask <= 0.8 GROUP BY 1")
def focus_by_class(t: Tables):
    return rounded(rollups.focus_by_class(_masked(t), "focus", "mask"))


def _curves(t: Tables) -> DataFrame:
    e = t("embeddings")
    part = lambda start: F.transform(F.slice("embedding", start, 32), lambda x: F.abs(x.cast("double")))
    return e.select("vec_id", part(1).alias("guided"), part(33).alias("random"))


_CURVES = """curves AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: abs(x::DOUBLE)) AS guided, list_transform(embedding[33:64], lambda x: abs(x::DOUBLE)) AS random FROM embeddings)"""


@query(f"""WITH {_CURVES} SELECT 'guided' AS curve, step::INT AS step, round(avg(v), 6) AS mean FROM (SELECT unnest(guided) AS v, generate_subscripts(guided, 1) - 1 AS step FROM curves) GROUP BY 2
UNION ALL SELECT 'random', step::INT, round(avg(v), 6) FROM (SELECT unnest(random) AS v, generate_subscripts(random, 1) - 1 AS step FROM curves) GROUP BY 2""")
def deletion_curves(t: Tables):
    return rounded(rollups.mean_curves(_curves(t), ["guided", "random"]))


_AREA = "list_sum(list_transform(range(1, 32), lambda i: (1 / 31::DOUBLE) * ({c}[i] + {c}[i + 1]) / 2))"


@query(f"""WITH {_CURVES}, a AS (SELECT {_AREA.format(c='guided')} AS g, {_AREA.format(c='random')} AS r FROM curves)
SELECT round(avg(g), 6) AS area_guided, round(avg(r), 6) AS area_random, round(avg((g < r)::INT), 6) AS share_guided_smaller FROM a""")
def deletion_summary(t: Tables):
    return rounded(rollups.deletion_summary(_curves(t), "guided", "random", FRACTIONS))


_SEVERITY = """sev AS (SELECT l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey AS key, l_returnflag AS label, l_extendedprice AS value, CASE WHEN l_discount < 0.05 THEN 'accepted' WHEN l_discount < 0.08 THEN 'uncertain' ELSE 'rejected' END AS status,
  CASE WHEN l_discount < 0.08 THEN CASE WHEN l_tax < 0.02 THEN 'R' WHEN l_tax < 0.05 THEN 'N' ELSE 'A' END END AS pred, CASE WHEN l_discount < 0.08 THEN 1 - l_tax END AS confidence FROM lineitem WHERE l_quantity > 2 AND l_quantity <= 40)"""


def _severity(t: Tables) -> DataFrame:
    li = t("lineitem").where("l_quantity > 2 and l_quantity <= 40")
    tax, discount = F.col("l_tax"), F.col("l_discount")
    return li.select(
        (F.col("l_orderkey") * 1000000000 + F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("key"),
        F.col("l_returnflag").alias("label"), F.col("l_extendedprice").alias("value"),
        F.when(discount < 0.05, "accepted").when(discount < 0.08, "uncertain").otherwise("rejected").alias("status"),
        F.when(discount < 0.08, F.when(tax < 0.02, "R").when(tax < 0.05, "N").otherwise("A")).alias("pred"),
        F.when(discount < 0.08, 1 - tax).alias("confidence"),
    )


@query(f"""WITH {_SEVERITY}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY value, key) AS r, count(*) OVER (PARTITION BY label) AS c FROM sev WHERE label <> 'N'),
b AS (SELECT *, greatest(1, ((r - 1) * 3 + c - 2) // (c - 1))::INT AS tercile FROM r)
SELECT label, tercile, count(*) AS n, round(avg((status = 'accepted')::INT), 6) AS accepted, round(avg((status = 'uncertain')::INT), 6) AS uncertain, round(avg((status = 'rejected')::INT), 6) AS rejected,
  round(avg(coalesce(pred <> label, false)::INT), 6) AS wrong_top_class, round(avg(coalesce(pred = 'N', false)::INT), 6) AS called_healthy, round(avg((status = 'accepted' AND coalesce(pred <> label, true))::INT), 6) AS answered_wrong,
  round(avg(confidence), 6) AS mean_confidence, round(quantile_cont(value, 0.5), 6) AS median FROM b GROUP BY 1, 2""")
def severity_terciles(t: Tables):
    return rounded(rollups.severity_terciles(freeze(_severity(t).where("label <> 'N'")), "key", "label", "value", "N"))


@query(f"""WITH {_SEVERITY} SELECT label, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS p25,
  round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, round(max(value), 4) AS max FROM sev GROUP BY 1""")
def severity_by_class(t: Tables):
    return aggregates.describe_spread(_severity(t).select("label", "value"), ["label"])


# ---------------------------------------------------------------- comparison and report tables

EVAL = T.StructType().add("model_kind", "string").add(
    "test", T.StructType().add("macro_f1", "double").add("errors", "long").add("ci", T.ArrayType(T.DoubleType()))
)
ROBUST = T.StructType().add("relative", T.MapType(T.StringType(), T.DoubleType()))
BENCH = T.StructType().add("model_only", T.StructType().add("p50_ms", "double").add("p95_ms", "double"))


@query("""WITH m AS (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW','6-UNKNOWN']) AS model),
e AS (SELECT o_orderpriority AS model, round(avg(o_totalprice), 4) AS f1, count(*) AS errors, round(min(o_totalprice), 4) AS lo, round(max(o_totalprice), 4) AS hi FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1),
r AS (SELECT o_orderpriority AS model, round(avg((o_orderstatus = 'F')::INT), 6) AS sev3 FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1)
SELECT m.model, e.f1 AS test_macro_f1, e.errors AS test_errors, e.lo AS ci_low, e.hi AS ci_high, r.sev3 AS relative_1_3, NULL::DOUBLE AS latency_p50 FROM m LEFT JOIN e USING (model) LEFT JOIN r USING (model)""")
def decision_matrix(t: Tables):
    """One row per model from optional nested result documents; missing ones leave NULLs."""
    o = t("orders")
    root = scratch_path(t.spark, "results")
    by = F.col("o_orderpriority").alias("model")
    ev = o.where("o_orderpriority <> '5-LOW'").groupBy(by).agg(
        F.struct(
            F.round(F.avg("o_totalprice"), 4).alias("macro_f1"), F.count("*").alias("errors"),
            F.array(F.round(F.min("o_totalprice"), 4), F.round(F.max("o_totalprice"), 4)).alias("ci"),
        ).alias("test")
    )
    rb = o.where("o_orderpriority in ('1-URGENT', '5-LOW')").groupBy(by).agg(
        F.create_map(F.lit("severity_1_3"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6)).alias("relative")
    )
    named = T.StructType().add("model", "string")
    docs = {}
    for kind, table, schema in (("eval", ev, EVAL), ("robustness", rb, ROBUST)):
        tables.write_json(table, f"{root}/{kind}")
        docs[kind] = tables.read_json(t.spark, f"{root}/{kind}", T.StructType(named.fields + schema.fields))
    docs["benchmark"] = tables.read_documents(t.spark, root, {"benchmark": BENCH}, "model")["benchmark"]
    models = [*(f for f in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-UNKNOWN"))]
    base = t.spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    parts = [
        docs["eval"].select("model", F.col("test.macro_f1").alias("test_macro_f1"), F.col("test.errors").alias("test_errors"),
                            F.col("test.ci")[0].alias("ci_low"), F.col("test.ci")[1].alias("ci_high")),
        docs["robustness"].select("model", F.col("relative")["severity_1_3"].alias("relative_1_3")),
        docs["benchmark"].select("model", F.col("model_only.p50_ms").alias("latency_p50")),
    ]
    return joins.optional_join(base, parts, "model")


_STATS = """s AS (SELECT o_orderpriority AS bundle, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(min(o_totalprice), 4) AS low, round(max(o_totalprice), 4) AS high,
  round(avg((o_orderstatus = 'F')::INT), 6) AS f, round(avg((o_orderstatus = 'O')::INT), 6) AS o, round(avg((o_orderstatus = 'P')::INT), 6) AS p FROM orders GROUP BY 1)"""


@query(f"""WITH {_STATS}, b AS (SELECT bundle FROM s UNION ALL SELECT '6-UNKNOWN'), m AS (SELECT mean FROM s WHERE bundle = '2-HIGH'),
ev AS (SELECT * FROM s WHERE bundle <> '5-LOW'), rb AS (SELECT * FROM s WHERE bundle IN ('1-URGENT', '5-LOW')), od AS (SELECT * FROM s WHERE bundle <> '2-HIGH'),
bm AS (SELECT * FROM s WHERE bundle <> '3-MEDIUM')
SELECT b.bundle, 'm' || ev.bundle AS model, ev.f AS val_macro_f1, ev.mean AS test_macro_f1, ev.low AS test_ci_low, ev.high AS test_ci_high, ev.n AS test_errors, ev.o AS ece_after,
  rb.f AS relative_robustness_sev1_3, rb.o AS relative_robustness_sev1_5, rb.p AS background_only_acc, NULL::DOUBLE AS leaf_only_acc,
  CASE od.n % 2 WHEN 0 THEN 'energy' WHEN 1 THEN 'knn' END AS ood_scorer, CASE WHEN od.n IS NULL THEN NULL WHEN od.n % 2 = 0 THEN od.f ELSE od.o END AS ood_auroc_near,
  CASE WHEN od.n IS NULL THEN NULL WHEN od.n % 2 = 0 THEN od.p ELSE od.f END AS ood_auroc_far, od.o AS accepted_share, od.p AS accepted_accuracy, od.n AS ood_test_accepted,
  NULL::DOUBLE AS external_auroc, NULL::DOUBLE AS external_accuracy, bm.mean AS onnx_mb, bm.low AS params_m, bm.low AS latency_model_p50_ms, bm.high AS latency_model_p95_ms, bm.mean AS latency_end_to_end_p50_ms,
  CASE WHEN b.bundle IN ('1-URGENT', '3-MEDIUM') THEN round(m.mean - s.mean, 4) END AS diff_main_minus_this, CASE WHEN b.bundle IN ('1-URGENT', '3-MEDIUM') THEN s.low END AS paired_ci_low,
  CASE WHEN b.bundle IN ('1-URGENT', '3-MEDIUM') THEN s.high END AS paired_ci_high, b.bundle = '2-HIGH' AS is_main
FROM b CROSS JOIN m LEFT JOIN s USING (bundle) LEFT JOIN ev ON ev.bundle = b.bundle LEFT JOIN rb ON rb.bundle = b.bundle LEFT JOIN od ON od.bundle = b.bundle LEFT JOIN bm ON bm.bundle = b.bundle""")
def full_decision_matrix(t: Tables):
    """All fields of the comparison, from JSON documents of differing shape that are written and read back by kind."""

    def share(status: str) -> Column:
        return F.round(F.avg((F.col("o_orderstatus") == status).cast("double")), 6)

    price = F.col("o_totalprice")
    s = freeze(t("orders").groupBy(F.col("o_orderpriority").alias("bundle")).agg(
        F.count("*").alias("n"), F.round(F.avg(price), 4).alias("mean"), F.round(F.min(price), 4).alias("low"),
        F.round(F.max(price), 4).alias("high"), share("F").alias("f"), share("O").alias("o"), share("P").alias("p"),
    ))
    shapes = {
        "eval": ("bundle <> '5-LOW'", """named_struct('model', concat('m', bundle), 'val', named_struct('macro_f1', f), 'test', named_struct('macro_f1', mean, 'errors', n,
            'bootstrap_95ci', named_struct('macro_f1', named_struct('lo', low, 'hi', high)), 'calibration', named_struct('ece_after', o)))"""),
        "robustness": ("bundle in ('1-URGENT', '5-LOW')", """named_struct('relative_robustness', named_struct('severity_1_3', f, 'severity_1_5', o),
            'shortcut', named_struct('background_only', named_struct('accuracy', p), 'leaf_only', 'none'))"""),
        "ood": ("bundle <> '2-HIGH'", """named_struct('scorer', if(n % 2 = 0, 'energy', 'knn'), 'test', named_struct(
            'energy', named_struct('near', named_struct('auroc', f), 'far', named_struct('auroc', p)), 'knn', named_struct('near', named_struct('auroc', o), 'far', named_struct('auroc', f))),
            'decisions', named_struct('test', named_struct('accepted_share', o, 'accepted_accuracy', p), 'ood_test', named_struct('counts', named_struct('accepted:None', n))))"""),
        "benchmark": ("bundle <> '3-MEDIUM'", """named_struct('onnx_mb', mean, 'params_m', low, 'extra', array(1, 2),
            'model_only', named_struct('p50_ms', low, 'p95_ms', high), 'end_to_end', named_struct('p50_ms', mean))"""),
    }
    parts = [s.where(rows).select(F.lit(kind).alias("kind"), "bundle", F.to_json(F.expr(shape)).alias("value")) for kind, (rows, shape) in shapes.items()]
    main = F.max(F.when(F.col("bundle") == "2-HIGH", F.col("mean")))
    rest = s.agg(main.alias("main"), F.collect_list(F.struct("bundle", "mean", "low", "high")).alias("all"))  # a row per priority
    paired = rest.selectExpr("'paired' as kind", "'all' as bundle", """to_json(named_struct('main', '2-HIGH', 'comparisons', map_from_entries(
        transform(filter(all, r -> r.bundle in ('1-URGENT', '3-MEDIUM')), r -> struct(r.bundle, named_struct('diff', round(main - r.mean, 4), 'lo', r.low, 'hi', r.high)))))) as value""")
    root = scratch_path(t.spark, "results")
    for part in [*parts, paired]:
        part.write.mode("append").partitionBy("kind", "bundle").text(root)
    layout = {kind: rf"/kind={kind}/bundle=([^/]+)/" for kind in (*shapes, "external", "paired")}
    bundles = s.select("bundle").unionByName(t.spark.createDataFrame([("6-UNKNOWN",)], "bundle string"))
    return matrix.result_matrix(bundles, tables.read_variants(t.spark, root, layout))


@query("""WITH a AS (SELECT event_type AS condition, round(avg((value > 40)::INT), 6) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1),
b AS (SELECT event_type AS condition, round(avg((value > 40)::INT), 6) AS v FROM events WHERE event_id % 2 = 1 AND event_type <> 'view' GROUP BY 1)
SELECT condition, b.v AS before, a.v AS after, round(a.v - b.v, 6) AS change FROM a LEFT JOIN b USING (condition)""")
def before_after(t: Tables):
    """Two result versions aligned by condition; a condition new in the second has no before."""
    e = t("events")

    def version(rows: DataFrame, name: str) -> DataFrame:
        share = F.round(F.avg((F.col("value") > 40).cast("double")), 6)
        return rows.groupBy(F.col("event_type").alias("condition")).agg(share.alias(name))

    new = version(e.where("event_id % 2 = 0"), "after")
    old = version(e.where("event_id % 2 = 1 and event_type <> 'view'"), "before")
    out = joins.optional_join(new, [old], "condition")
    return out.select("condition", "before", "after", F.round(F.col("after") - F.col("before"), 6).alias("change"))


def _profiled(t: Tables) -> DataFrame:
    m = _precedence(t).withColumn("is_valid", F.col("status") != "invalid")
    return m.select("is_valid", "status", "lang", F.col("bytes").cast("double").alias("bytes"), F.col("n_chars").cast("double").alias("n_chars"), "source")


@query(f"""WITH {_PRECEDENCE}, p AS (SELECT f.status, f.status <> 'invalid' AS is_valid, m.lang, m.source, m.bytes::DOUBLE AS bytes, m.n_chars::DOUBLE AS n_chars FROM final f JOIN manifest m USING (path)),
ok AS (SELECT * FROM p WHERE status = 'ok'), long AS (SELECT lang, 'bytes' AS measure, bytes AS v FROM ok UNION ALL SELECT lang, 'n_chars', n_chars FROM ok),
d AS (SELECT lang || '/' || measure AS key, avg(v) AS mean, quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.99) AS p99 FROM long GROUP BY 1),
s AS (UNPIVOT d ON mean, p01, p25, median, p75, p99 INTO NAME stat VALUE value)
SELECT section, key, stat, round(value, 4) AS value FROM (
 SELECT 'totals' AS section, 'files' AS key, 'count' AS stat, count(*)::DOUBLE AS value FROM p UNION ALL SELECT 'totals', 'valid', 'count', count(*) FILTER (is_valid) FROM p
 UNION ALL SELECT 'status', status, 'count', count(*) FROM p GROUP BY status UNION ALL SELECT 'source', source, 'count', count(*) FROM p WHERE is_valid GROUP BY source
 UNION ALL SELECT 'clean_lang', lang, 'count', count(*) FROM ok GROUP BY lang
 UNION ALL SELECT 'imbalance', 'all', 'ratio', max(n)::DOUBLE / greatest(min(n), 1) FROM (SELECT count(*) AS n FROM ok GROUP BY lang)
 UNION ALL SELECT 'describe', key, stat, value FROM s)""")
def data_profile(t: Tables):
    return rounded(aggregates.profile(freeze(_profiled(t)), "lang", ["bytes", "n_chars"], ["source"]), 4)


def _sql_described(key: str, rows: str) -> str:
    """(key, stat, value) rows of the described ``v`` of a subquery with ``key``."""
    stats = ", ".join(f"quantile_cont(v, {q}) AS {n}" for n, q in (("p01", 0.01), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p99", 0.99)))
    return f"UNPIVOT (SELECT {key} AS key, avg(v) AS mean, {stats} FROM ({rows}) GROUP BY 1) ON mean, p01, p25, median, p75, p99 INTO NAME stat VALUE value"


_SECTION_SPLITS = ("0", "1", "2", "3")


@query(f"""WITH {_PRECEDENCE}, p AS (SELECT f.status, f.status <> 'invalid' AS is_valid, f.path, f.duplicate_of, m.lang, m.source, m.bytes, m.n_chars,
  (m.doc_id % 4)::VARCHAR AS given, m.bytes / m.n_chars AS ratio FROM final f JOIN manifest m USING (path)),
ok AS (SELECT * FROM p WHERE status = 'ok'), valid AS (SELECT * FROM p WHERE is_valid),
langs AS (SELECT unnest({list(LANGS)}) AS lang), givens AS (SELECT unnest({list(_SECTION_SPLITS)}) AS given),
a AS (SELECT coalesce(lang, '?') AS lang, given FROM p),
b AS (SELECT source FROM ok WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (lang IN (SELECT lang FROM langs)) >= 5),
s1 AS ({_sql_described("m", "SELECT 'bytes' AS m, bytes::DOUBLE AS v FROM valid UNION ALL SELECT 'n_chars', n_chars FROM valid")}),
s2 AS ({_sql_described("lang || '/' || m", "SELECT lang, 'long_side' AS m, greatest(bytes, n_chars)::DOUBLE AS v FROM ok UNION ALL SELECT lang, 'kb', bytes / 1024.0 FROM ok")})
SELECT section, key, stat, round(value, 4) AS value FROM (
 SELECT 'given_by_class' AS section, l.lang AS key, g.given AS stat, count(a.lang)::DOUBLE AS value
   FROM (SELECT DISTINCT lang FROM a) l CROSS JOIN givens g LEFT JOIN a ON a.lang = l.lang AND a.given = g.given GROUP BY 2, 3
 UNION ALL SELECT 'pattern_by_class', b.source, l.lang, count(ok.path) FROM b CROSS JOIN langs l LEFT JOIN ok ON ok.source = b.source AND ok.lang = l.lang GROUP BY 2, 3
 UNION ALL SELECT * FROM (SELECT 'common_size', bytes || 'x' || n_chars, 'count', count(*) FROM valid GROUP BY 2 ORDER BY 4 DESC, 2 LIMIT 10)
 UNION ALL SELECT * FROM (SELECT 'warning', 'aspect', 'count', count(*) FROM valid WHERE NOT (ratio BETWEEN 1.0 AND 1.02) HAVING count(*) > 0)
 UNION ALL SELECT 'group_size', size::VARCHAR, 'groups', count(*) FROM (SELECT count(*) AS size FROM ok GROUP BY source) GROUP BY 2
 UNION ALL SELECT 'sides', key, stat, value FROM s1 UNION ALL SELECT 'resolution_by_class', key, stat, value FROM s2)""")
def data_profile_sections(t: Tables):
    """Crosstabs, common sizes, warnings, group sizes and described sides of the profiled documents."""
    m = _precedence(t).withColumn("is_valid", F.col("status") != "invalid")
    m = m.withColumn("given", (F.col("doc_id") % 4).cast("string"))
    m = m.withColumn("warnings", rules.aspect_warnings(F.col("bytes"), F.col("n_chars"), 1.0, 1.02))
    kept = freeze(m.select("is_valid", "status", "lang", "source", "given", "bytes", "n_chars", "warnings"))
    sections = aggregates.profile_sections(
        kept, "lang", "given", "source", LANGS, _SECTION_SPLITS, ("bytes", "n_chars"), "source"
    )
    return rounded(sections, 4)


@query(f"""WITH {MANIFEST} SELECT lang, round(quantile_cont(greatest(bytes, n_chars)::DOUBLE, 0.5), 4) AS median_side, round(quantile_cont(bytes / 1024.0::DOUBLE, 0.5), 4) AS median_kb,
  round(quantile_cont(len(string_split(text, chr(10)))::DOUBLE, 0.5), 4) AS median_lines FROM manifest GROUP BY 1""")
def confound_table(t: Tables):
    """Medians per class of measures a model could use as a shortcut."""
    from sievemark.operators.ordered import quantiles

    m = manifest(t).select(
        "lang", F.greatest("bytes", "n_chars").cast("double").alias("median_side"), (F.col("bytes") / 1024).alias("median_kb"),
        F.size(F.split("text", "\n")).cast("double").alias("median_lines"),
    )
    names = ["median_side", "median_kb", "median_lines"]
    med = quantiles(m.unpivot(["lang"], names, "measure", "value"), "value", {"v": 0.5}, ["lang", "measure"])
    return rounded(med.groupBy("lang").pivot("measure", names).agg(F.max("v")), 4)


@query(f"""WITH {SCORED}, f AS (SELECT *, id % 5 || '' AS fold FROM scored), {_sql_metrics('f', 'fold')},
l AS (SELECT 'accuracy' AS metric, accuracy AS v FROM core UNION ALL SELECT 'macro_f1', macro_f1 FROM core)
SELECT metric, count(*) AS k, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high FROM l GROUP BY 1""")
def cv_table(t: Tables):
    s = scored(t).withColumn("fold", (F.col("id") % 5).cast("string"))
    per_fold = core_metrics(cells(s, by=["fold"]), ["fold"]).select("fold", "accuracy", "macro_f1")
    return rounded(rollups.cv_table(per_fold, ["accuracy", "macro_f1"]))


@query(f"""WITH {SCORED} SELECT id, y, pred, round(conf, 5) AS conf, correct, {', '.join(f'round(probs[{c + 1}], 5) AS p_{c}' for c in CLASSES)} FROM scored""")
def flat_predictions(t: Tables):
    return rollups.flat_predictions(scored(t), [str(c) for c in CLASSES], ["id", "y", "pred", "conf", "correct"])
