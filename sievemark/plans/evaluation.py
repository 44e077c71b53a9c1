"""Queries on predictions: metrics, calibration, conformal sets and label audit."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sievemark.functions import arrays
from sievemark.functions.hashing import hash_uniform
from sievemark.operators import audit, calibration, joins, metrics, splits
from sievemark.operators.ordered import quantiles, with_running_sums
from sievemark.plans.datasets import CLASSES, SCALE, SCORED, VECTORS, frozen_scored, scored, sql_refined, sql_scored, vectors
from sievemark.plans.registry import Tables, query, rounded
from sievemark.session import freeze

BUCKETS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0001)
CONFIDENCE_EDGES = (0.4, 0.6, 0.8, 0.9, 0.95, 0.99, 1.0001)
RELIABILITY_EDGES = (0.4, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0001)


# ---------------------------------------------------------------- predictions


@query(f"""WITH {SCORED} SELECT id, split, y, pred, round(conf, 6) AS conf, correct, round(-ln(probs[y + 1] + 1e-12), 6) AS nll,
  round(1 - conf, 6) AS msp, round(-(list_max(logits) + ln(list_sum(list_transform(logits, lambda z: exp(z - list_max(logits)))))), 6) AS energy FROM scored""")
def scored_rows(t: Tables):
    s = scored(t)
    return rounded(
        s.select(
            "id", "split", "y", "pred", "conf", "correct", arrays.nll_term("probs", "y").alias("nll"),
            (1 - F.col("conf")).alias("msp"), arrays.energy("logits").alias("energy"),
        )
    )


@query(f"""WITH {SCORED}, soft AS (SELECT id, logits, list_transform(logits, lambda z: exp((z - list_max(logits)) / 2.5)) AS pw FROM scored)
SELECT id, round(list_max(list_transform(pw, lambda p: p / list_sum(pw))), 6) AS conf, round(pw[1] / list_sum(pw), 6) AS p0 FROM soft""")
def tempered_softmax(t: Tables):
    s = scored(t).select("id", arrays.softmax("logits", 2.5).alias("p"))
    return rounded(s.select("id", F.array_max("p").alias("conf"), F.get("p", F.lit(0)).alias("p0")))


_RANKED = """ranked AS (SELECT id, list(k ORDER BY p DESC, k) AS ranked, list(k ORDER BY p DESC, k) FILTER (p >= 1 - 0.75 OR k = pred) AS members,
  list(k ORDER BY p DESC, k) FILTER (p >= 0.15) AS likely
  FROM (SELECT id, pred, unnest(probs) AS p, generate_subscripts(probs, 1) - 1 AS k FROM scored) GROUP BY id)"""


@query(f"""WITH {SCORED}, {_RANKED} SELECT id, array_to_string(members, ',') AS members,
  coalesce(array_to_string((CASE WHEN len(members) >= 2 THEN members ELSE coalesce(likely, []) END)[:3], ','), '') AS named FROM ranked""")
def candidate_sets(t: Tables):
    members = arrays.prediction_set("probs", 0.75)
    s = scored(t).select("id", members.alias("members"), arrays.candidate_classes("probs", members).alias("named"))
    return s.select("id", F.array_join("members", ",").alias("members"), F.array_join("named", ",").alias("named"))


# ---------------------------------------------------------------- classification metrics


def _sql_metrics(source: str, by: str = "", pred: str = "pred", weight: str = "count(*)", name: str = "core", rows: str = "") -> str:
    """CTEs for accuracy and macro scores of ``source`` grouped by ``by``."""
    b = f"{by}, " if by else ""
    cells = rows or f"SELECT {b}y, {pred} AS p, {weight} AS n FROM {source} GROUP BY ALL"
    on = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    return f"""{name}_cells AS ({cells}),
{name}_classes AS (SELECT {b}c, sum(tp) AS tp, sum(s) AS s, sum(q) AS q FROM (
  SELECT {b}y AS c, CASE WHEN y = p THEN n ELSE 0 END AS tp, n AS s, 0 AS q FROM {name}_cells
  UNION ALL SELECT {b}p, 0, 0, n FROM {name}_cells) GROUP BY ALL),
{name} AS (SELECT {b}sum(s)::BIGINT AS n, (sum(s) - sum(tp))::BIGINT AS errors, sum(tp)::DOUBLE / sum(s) AS accuracy,
  avg(2.0 * tp / (s + q)) AS macro_f1, avg(CASE WHEN q > 0 THEN tp::DOUBLE / q ELSE 0 END) AS macro_precision,
  avg(CASE WHEN s > 0 THEN tp::DOUBLE / s ELSE 0 END) AS macro_recall FROM {name}_classes WHERE s + q > 0 {group})"""


_CORE = "n, errors, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall"


@query(f"WITH {SCORED}, {_sql_metrics('scored', 'split')} SELECT split, {_CORE} FROM core")
def core_metrics(t: Tables):
    return rounded(metrics.core_metrics(metrics.cells(scored(t), by=["split"]), ["split"]))


@query(f"""WITH {SCORED}, k AS (SELECT unnest(range(8))::INT AS c), s AS (SELECT k.c,
  (SELECT count(*) FROM scored WHERE y = k.c AND pred = k.c) AS tp, (SELECT count(*) FROM scored WHERE y = k.c) AS s, (SELECT count(*) FROM scored WHERE pred = k.c) AS q FROM k),
m AS (SELECT c, CASE WHEN q > 0 THEN tp / q ELSE 0 END::DOUBLE AS p, CASE WHEN s > 0 THEN tp / s ELSE 0 END::DOUBLE AS r, CASE WHEN s + q > 0 THEN 2.0 * tp / (s + q) ELSE 0 END::DOUBLE AS f, s FROM s)
SELECT c::VARCHAR AS row, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s AS support FROM m
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(s)::BIGINT FROM m
UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), sum(s)::BIGINT FROM m""")
def class_report(t: Tables):
    return rounded(metrics.class_report(metrics.cells(scored(t)), CLASSES))


@query(f"""WITH {SCORED}, k AS (SELECT a.c AS y, b.c AS pred FROM (SELECT unnest(range(8))::INT AS c) a CROSS JOIN (SELECT unnest(range(8))::INT AS c) b),
c AS (SELECT k.y, k.pred, count(s.id) AS n FROM k LEFT JOIN scored s ON s.y = k.y AND s.pred = k.pred GROUP BY 1, 2)
SELECT y, pred, n, round(n / greatest(sum(n) OVER (PARTITION BY y), 1), 6) AS share FROM c""")
def confusion_matrix(t: Tables):
    return rounded(metrics.confusion_matrix(metrics.cells(scored(t)), CLASSES))


def _sql_auroc(rows: str, by: str, score: str, pos: str, name: str) -> str:
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""{name}_rank AS (SELECT {b}{pos} AS pos, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER (PARTITION BY {b}{score}) - 1) / 2.0 AS r FROM {rows}),
{name} AS (SELECT {b}CASE WHEN count(*) FILTER (pos) > 0 AND count(*) FILTER (NOT pos) > 0 THEN
  (sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos)::DOUBLE * count(*) FILTER (NOT pos)) END AS auroc
  FROM {name}_rank GROUP BY ALL)"""


@query(f"""WITH {SCORED}, long AS (SELECT unnest(probs) AS score, generate_subscripts(probs, 1) - 1 AS cls, y FROM scored),
{_sql_auroc('long', 'cls', 'score', '(y = cls)', 'area')} SELECT cls::INT AS cls, round(auroc, 6) AS auroc FROM area""")
def class_auroc(t: Tables):
    long_rows = metrics.one_vs_rest(scored(t), "y", "probs")
    return rounded(metrics.auroc(long_rows, "score", F.col("is_cls"), ["cls"]))


@query(f"""WITH {SCORED}, long AS (SELECT unnest(probs) AS score, generate_subscripts(probs, 1) - 1 AS cls, y FROM scored),
{_sql_auroc('long', 'cls', 'score', '(y = cls)', 'area')} SELECT CASE WHEN count(auroc) = count(*) THEN round(avg(auroc), 6) END AS macro_auroc FROM area""")
def macro_auroc(t: Tables):
    return rounded(metrics.macro_auroc(scored(t), "y", "probs"))


@query(f"""WITH {SCORED} SELECT id, rank() OVER (ORDER BY round(conf, 2)) + (count(*) OVER (PARTITION BY round(conf, 2)) - 1) / 2.0 AS mid_rank FROM scored""")
def mid_ranks(t: Tables):
    """Rank of every row with ties sharing their mean rank."""
    s = frozen_scored(t).select("id", F.round("conf", 2).alias("s"))
    steps = with_running_sums(s.groupBy("s").agg(F.count("*").alias("n")), ["s"], ["n"])
    return s.join(steps, "s").select("id", (F.col("n_before") + (F.col("n") + 1) / 2).alias("mid_rank"))


@query()
def bootstrap_interval(t: Tables):
    """2000 multinomial resamples; random by construction, so only rows are compared."""
    return rounded(metrics.bootstrap_ci(metrics.cells(scored(t))))


def _sql_poisson(seed_key: str) -> str:
    steps = " ".join(f"WHEN u < {p!r} THEN {k}" for k, p in enumerate(metrics.POISSON_STEPS))
    return f"(CASE {steps} ELSE {len(metrics.POISSON_STEPS)} END)"


_REPS = 2000
_WEIGHTED = f"""draws AS (SELECT *, ('0x' || substr(md5('boot' || (rep // 4) || ':' || id), (1 + 8 * (rep % 4))::INT, 8))::BIGINT / 4294967296.0 AS u
  FROM {{rows}} CROSS JOIN (SELECT unnest(range({_REPS})) AS rep)), weighted AS (SELECT *, {_sql_poisson('')} AS w FROM draws)"""


@query(f"""WITH {SCORED}, {_WEIGHTED.format(rows='scored')}, {_sql_metrics('', 'rep', rows="SELECT rep, y, pred AS p, sum(w) AS n FROM weighted GROUP BY ALL")}
SELECT 'accuracy' AS metric, round(quantile_cont(accuracy, 0.025), 6) AS lo, round(quantile_cont(accuracy, 0.975), 6) AS hi FROM core
UNION ALL SELECT 'macro_f1', round(quantile_cont(macro_f1, 0.025), 6), round(quantile_cont(macro_f1, 0.975), 6) FROM core""")
def poisson_bootstrap(t: Tables):
    cells = metrics.poisson_cells(scored(t), "id", ["y", "pred"], _REPS)
    reps = metrics.core_metrics(cells, ["rep"])
    long_rows = reps.select(F.expr("stack(2, 'accuracy', accuracy, 'macro_f1', macro_f1) as (metric, v)"))
    return rounded(
        long_rows.groupBy("metric").agg(F.percentile("v", 0.025).alias("lo"), F.percentile("v", 0.975).alias("hi"))
    )


_TWO = VECTORS + ",\n" + sql_scored() + ",\n" + sql_scored(distance=True, name="other")


def _two(t: Tables):
    a = scored(t).select("id", "y", F.col("pred").alias("a"))
    b = scored(t, distance=True).select("id", F.col("pred").alias("b"))
    return joins.align(a, b, "id")


@query(f"""WITH {_TWO} SELECT s.id, s.y, s.pred AS a, o.pred AS b FROM scored s JOIN other o USING (id)""")
def aligned_predictions(t: Tables):
    return _two(t)


@query()
def paired_difference(t: Tables):
    """Paired multinomial bootstrap of two models; random by construction."""
    triples = _two(t).groupBy("y", "a", "b").agg(F.count("*").alias("n"))
    return rounded(metrics.paired_bootstrap(freeze(triples)))


@query(f"""WITH {_TWO}, duo AS (SELECT s.id, s.y, s.pred AS a, o.pred AS b FROM scored s JOIN other o USING (id)), {_WEIGHTED.format(rows='duo')},
{_sql_metrics('', 'rep', name='ma', rows="SELECT rep, y, a AS p, sum(w) AS n FROM weighted GROUP BY ALL")},
{_sql_metrics('', 'rep', name='mb', rows="SELECT rep, y, b AS p, sum(w) AS n FROM weighted GROUP BY ALL")},
d AS (SELECT ma.macro_f1 - mb.macro_f1 AS d FROM ma JOIN mb USING (rep))
SELECT round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, round(avg((d <= 0)::INT), 6) AS share_not_better FROM d""")
def poisson_paired(t: Tables):
    cells = metrics.poisson_cells(_two(t), "id", ["y", "a", "b"], _REPS)
    cells = freeze(cells)

    def f1(c: str):
        one = cells.groupBy("rep", "y", F.col(c).alias("pred")).agg(F.sum("n").alias("n"))
        return metrics.core_metrics(one, ["rep"]).select("rep", F.col("macro_f1").alias(f"f1_{c}"))

    d = f1("a").join(f1("b"), "rep").select((F.col("f1_a") - F.col("f1_b")).alias("d"))
    return rounded(
        d.agg(
            F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"),
            F.avg((F.col("d") <= 0).cast("double")).alias("share_not_better"),
        )
    )


@query(f"""WITH {SCORED}, b AS (SELECT unnest(range(5))::INT AS bucket), e AS (SELECT *, CASE WHEN conf < 0.2 THEN 0 WHEN conf < 0.4 THEN 1 WHEN conf < 0.6 THEN 2 WHEN conf < 0.8 THEN 3 ELSE 4 END AS bucket FROM scored)
SELECT b.bucket, count(e.id) AS n, round(avg(e.correct::INT), 6) AS accuracy,
  round(count(*) FILTER (NOT e.correct) / greatest((SELECT count(*) FROM scored WHERE NOT correct), 1), 6) AS share_of_errors FROM b LEFT JOIN e USING (bucket) GROUP BY 1""")
def confidence_buckets(t: Tables):
    return rounded(metrics.confidence_buckets(frozen_scored(t), "conf", "correct", BUCKETS))


@query(f"""WITH {SCORED} SELECT id, round(row_number() OVER w / count(*) OVER (), 6) AS coverage, round(avg(correct::INT) OVER w, 6) AS accuracy, round(conf, 6) AS threshold
FROM scored WINDOW w AS (ORDER BY conf DESC, id ROWS UNBOUNDED PRECEDING)""")
def selective_curve(t: Tables):
    return rounded(metrics.selective_curve(scored(t), "conf", "correct", "id"))


@query("""WITH long AS (SELECT doc_id, quality, 'n_chars' AS measure, n_chars::DOUBLE AS value FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT doc_id, quality, 'bytes', strlen(text) FROM documents JOIN labels USING (doc_id) UNION ALL SELECT doc_id, quality, 'lines', len(string_split(text, chr(10))) FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY value, doc_id) AS r, count(*) OVER (PARTITION BY measure) AS c FROM long)
SELECT measure, greatest(1, ((r - 1) * 4 + c - 2) // (c - 1))::INT AS bin, count(*) AS n, round(avg((quality = 0)::INT), 6) AS error_rate FROM r GROUP BY 1, 2""")
def error_by_quartile(t: Tables):
    d = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id").select(
        "doc_id", "quality", F.col("n_chars").cast("double").alias("n_chars"),
        F.octet_length("text").cast("double").alias("bytes"), F.size(F.split("text", "\n")).cast("double").alias("lines"),
    )
    long_rows = d.unpivot(["doc_id", "quality"], ["n_chars", "bytes", "lines"], "measure", "value")
    return rounded(metrics.error_rate_by_quartile(long_rows, "measure", "value", F.col("quality") == 0, "doc_id"))


@query(f"""WITH {_TWO}, all_rows AS (SELECT 'dot' AS model, * FROM scored UNION ALL SELECT 'distance', * FROM other), {_sql_metrics('all_rows', 'model')},
t AS (SELECT model, count(*) AS rows, avg(conf) AS conf FROM all_rows GROUP BY 1)
SELECT model, {_CORE}, round(conf, 6) AS mean_confidence FROM core JOIN t USING (model)""")
def model_table(t: Tables):
    a = scored(t).withColumn("model", F.lit("dot"))
    both = freeze(a.unionByName(scored(t, distance=True).withColumn("model", F.lit("distance"))).drop("embedding", "logits"))
    core = metrics.core_metrics(metrics.cells(both, by=["model"]), ["model"])
    means = both.groupBy("model").agg(F.avg("conf").alias("mean_confidence"))
    return rounded(core.join(means, "model"))


_THREE = f"""{_TWO}, {sql_scored(train_only=True, name='strict')}, c_all AS (SELECT 'dot' AS model, id, split, y, pred FROM scored UNION ALL SELECT 'distance', id, split, y, pred FROM other UNION ALL SELECT 'train_only', id, split, y, pred FROM strict),
c_rows AS (SELECT a.*, s.pred AS main FROM c_all a JOIN scored s USING (id) WHERE a.split = 'test')"""


@query(f"""WITH {_THREE}, {_WEIGHTED.format(rows='c_rows')}, {_sql_metrics('c_rows', 'model', name='pt')}, {_sql_metrics('c_rows', 'model', pred='main', name='pm')},
{_sql_metrics('', 'model, rep', name='ma', rows="SELECT model, rep, y, main AS p, sum(w) AS n FROM weighted GROUP BY ALL")},
{_sql_metrics('', 'model, rep', name='mb', rows="SELECT model, rep, y, pred AS p, sum(w) AS n FROM weighted GROUP BY ALL")},
d AS (SELECT model, mb.accuracy, mb.macro_f1, CASE WHEN model <> 'dot' THEN round(ma.macro_f1 - mb.macro_f1, 12) END AS gap FROM ma JOIN mb USING (model, rep)),
e AS (SELECT model, {', '.join(f"round(quantile_cont({c}, {q}), 6) AS {n}_{side}" for c, n in (('accuracy', 'accuracy'), ('macro_f1', 'f1'), ('gap', 'diff')) for side, q in (('lo', 0.025), ('hi', 0.975)))}, round(avg((gap <= 0)::INT), 6) AS share_not_better FROM d GROUP BY 1)
SELECT model, pt.n, pt.errors, round(pt.accuracy, 6) AS accuracy, round(pt.macro_f1, 6) AS macro_f1, round(CASE WHEN model <> 'dot' THEN pm.macro_f1 - pt.macro_f1 END, 6) AS diff, e.* EXCLUDE (model) FROM pt JOIN pm USING (model) JOIN e USING (model)""")
def model_comparison(t: Tables):
    """Test scores of three models with intervals, and the first one's paired lead over each other one."""
    models = {"dot": scored(t), "distance": scored(t, distance=True), "train_only": scored(t, train_only=True)}
    rows = [m.where("split = 'test'").select(F.lit(name).alias("model"), "id", "y", "pred") for name, m in models.items()]
    return rounded(metrics.compare_models(rows[0].unionByName(rows[1]).unionByName(rows[2]), "dot"))


@query(f"""WITH {SCORED} SELECT count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(quantile_cont(conf, 0.5) FILTER (correct), 6) AS median_right,
  round(quantile_cont(conf, 0.5) FILTER (NOT correct), 6) AS median_wrong FROM scored""")
def median_confidence(t: Tables):
    return rounded(metrics.median_confidence(frozen_scored(t), "conf", "correct"))


@query(f"""WITH {SCORED}, e AS (SELECT unnest(range(6))::INT AS bin, unnest([0.4, 0.6, 0.8, 0.9, 0.95, 0.99]) AS lo, unnest([0.6, 0.8, 0.9, 0.95, 0.99, 1.0001]) AS hi)
SELECT bin, o.outcome, count(s.id) AS n FROM e CROSS JOIN (VALUES ('correct'), ('wrong')) o(outcome)
LEFT JOIN scored s ON s.conf > e.lo AND s.conf <= e.hi AND (CASE WHEN s.correct THEN 'correct' ELSE 'wrong' END) = o.outcome GROUP BY 1, 2""")
def outcome_by_confidence(t: Tables):
    s = scored(t).withColumn("outcome", F.when(F.col("correct"), "correct").otherwise("wrong"))
    return metrics.binned_counts(s, "conf", CONFIDENCE_EDGES, "outcome", ["correct", "wrong"])


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY (NOT correct)::INT, conf DESC, id) AS best, row_number() OVER (PARTITION BY y ORDER BY correct::INT, conf, id) AS worst FROM scored)
SELECT id, y, 'confident' AS side FROM r WHERE best <= 4 UNION ALL SELECT id, y, 'doubtful' FROM r WHERE worst <= 4""")
def class_examples(t: Tables):
    """Per class: the most confident correct rows, and errors first then the least confident."""
    s = frozen_scored(t).select("id", "y", "conf", "correct")

    def top(side, *order):
        w = Window.partitionBy("y").orderBy(*order, "id")
        return s.withColumn("rn", F.row_number().over(w)).where("rn <= 4").select("id", "y", F.lit(side).alias("side"))

    return top("confident", (~F.col("correct")).cast("int"), F.col("conf").desc()).unionByName(
        top("doubtful", F.col("correct").cast("int"), F.col("conf"))
    )


@query(f"WITH {SCORED} SELECT id, y, pred, round(conf, 6) AS conf FROM scored WHERE NOT correct ORDER BY scored.conf DESC, id LIMIT 12")
def confident_errors(t: Tables):
    wrong = scored(t).where("not correct").select("id", "y", "pred", "conf")
    return rounded(wrong.orderBy(F.col("conf").desc(), "id").limit(12))


# ---------------------------------------------------------------- calibration and conformal sets


@query(f"""WITH {SCORED}, g AS (SELECT unnest([0.25, 0.5, 1.0, 2.0, 4.0, 8.0]::DOUBLE[]) AS temperature),
p AS (SELECT id, y, temperature, logits, list_transform(logits, lambda z: exp((z - list_max(logits)) / temperature)) AS pw FROM scored CROSS JOIN g)
SELECT temperature, round(avg(-ln(pw[y + 1] / list_sum(pw) + 1e-12)), 6) AS nll FROM p GROUP BY 1""")
def temperature_grid(t: Tables):
    return rounded(calibration.nll_grid(scored(t), "logits", "y", [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]))


@query(f"WITH {SCORED}, {sql_refined()} SELECT round(nll, 4) AS nll, round(temperature, 4) AS temperature FROM fitted")
def fitted_temperature(t: Tables):
    """Minimiser of the validation NLL by a refined grid (three passes)."""
    s = frozen_scored(t)
    best = calibration.fit_temperature(s.where("split = 'val'"), "logits", "y")
    return rounded(calibration.nll(s.where("split = 'val'"), "logits", "y", best).withColumn("temperature", F.lit(best)), 4)


def _sql_bins(bins: int, source: str = "scored") -> str:
    return f"""bins AS (SELECT len(list_filter(list_transform(range(1, {bins}), lambda i: i / {bins}.0::DOUBLE), lambda e: conf > e))::INT AS bin, count(*) AS n,
  avg(conf) AS confidence, avg(correct::INT) AS accuracy FROM {source} GROUP BY 1)"""


@query(f"WITH {SCORED}, {_sql_bins(15)} SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM bins")
def reliability_bins(t: Tables):
    return rounded(calibration.reliability(scored(t), "conf", "correct", 15))


@query(f"WITH {SCORED}, {_sql_bins(15)} SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM bins")
def calibration_error(t: Tables):
    return rounded(calibration.ece(scored(t), "conf", "correct", 15))


@query(f"""WITH {SCORED}, b AS (SELECT *, len(list_filter([0.4, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0001], lambda e: conf > e)) - 1 AS bin FROM scored)
SELECT bin::INT AS bin, round(avg(conf), 6) AS confidence, round(avg(correct::INT), 6) AS accuracy, count(*) AS n FROM b WHERE bin BETWEEN 0 AND 5 GROUP BY 1""")
def dashboard_reliability(t: Tables):
    return rounded(calibration.reliability_at(scored(t), "conf", "correct", RELIABILITY_EDGES))


@query(f"""WITH {SCORED}, b AS (SELECT *, CASE WHEN conf = 0.5 THEN 0 ELSE len(list_filter(list_transform(range(11), lambda i: 0.5::DOUBLE + i * 0.05::DOUBLE), lambda e: conf > e)) - 1 END AS bin FROM scored)
SELECT bin::INT AS bin, round(avg(conf), 6) AS confidence, round(avg(correct::INT), 6) AS accuracy, count(*) AS n FROM b WHERE bin BETWEEN 0 AND 9 GROUP BY 1""")
def notebook_reliability(t: Tables):
    """Ten bins on .5-1.0, the lowest edge included."""
    edges = [0.5 + i * 0.05 for i in range(11)]
    return rounded(calibration.reliability_at(scored(t), "conf", "correct", edges, include_lowest=True))


_QHAT = """score AS (SELECT 1 - probs[y + 1] AS s, row_number() OVER (ORDER BY 1 - probs[y + 1]) - 1 AS r, count(*) OVER () AS n FROM scored WHERE split = 'val'),
qhat AS (SELECT s AS qhat FROM score WHERE r = ceil(least(1.0, ceil((n + 1) * (1 - 0.1)) / n) * (n - 1)))"""


@query(f"WITH {SCORED}, {_QHAT} SELECT round(qhat, 6) AS qhat FROM qhat")
def conformal_threshold(t: Tables):
    return rounded(calibration.qhat(scored(t).where("split = 'val'"), "probs", "y", 0.1))


# The record that sets the threshold is inside: 1 - (1 - p) may miss p by the last digit, which the slack covers.
_SLACK = 1e-12
_SETS = f"""{_QHAT}, sets AS (SELECT id, split, y, list_filter(range(8), lambda k: probs[k + 1] >= 1 - (qhat + {_SLACK}::DOUBLE) OR k = pred) AS members FROM scored CROSS JOIN qhat)"""


def _sets(t: Tables):
    s = frozen_scored(t)
    q = calibration.qhat(s.where("split = 'val'"), "probs", "y", 0.1).first()["qhat"]
    return s.withColumn("members", arrays.prediction_set("probs", q + _SLACK))


@query(f"WITH {SCORED}, {_SETS} SELECT id, array_to_string(members, ',') AS members, len(members)::INT AS size FROM sets")
def prediction_sets(t: Tables):
    s = _sets(t)
    return s.select("id", F.array_join(F.array_sort("members"), ",").alias("members"), F.size("members").alias("size"))


@query(f"""WITH {SCORED}, {_SETS} SELECT split, count(*) AS n, round(avg(list_contains(members, y)::INT), 6) AS coverage, round(avg(len(members)), 6) AS mean_size,
  round(avg((len(members) = 1)::INT), 6) AS singleton_rate FROM sets GROUP BY 1""")
def set_metrics(t: Tables):
    return rounded(calibration.set_metrics(_sets(t), "members", "y", ["split"]))


@query(f"""WITH {SCORED}, {_SETS} SELECT y, count(*) AS n, round(avg(list_contains(members, y)::INT), 6) AS coverage, round(avg(len(members)), 6) AS mean_size,
  round(avg((len(members) = 1)::INT), 6) AS singleton_rate FROM sets WHERE split = 'test' GROUP BY 1""")
def class_coverage(t: Tables):
    return rounded(calibration.set_metrics(_sets(t).where("split = 'test'"), "members", "y", ["y"]))


@query(f"""WITH {SCORED}, {sql_refined()}, tts AS (SELECT 1.0::DOUBLE AS tt, false AS scaled UNION ALL SELECT temperature, true FROM fitted),
p AS (SELECT id, y, pred, correct, tt AS temperature, scaled, list_transform(logits, lambda z: exp((z - list_max(logits)) / tt)) AS pw FROM scored CROSS JOIN tts),
q AS (SELECT temperature, scaled, id, y, correct, list_transform(pw, lambda x: x / list_sum(pw)) AS probs FROM p), c AS (SELECT *, list_max(probs) AS conf FROM q),
b AS (SELECT scaled, len(list_filter(list_transform(range(1, 15), lambda i: i / 15.0::DOUBLE), lambda e: conf > e)) AS bin, count(*) AS n, avg(conf) AS confidence, avg(correct::INT) AS accuracy FROM c GROUP BY ALL),
e AS (SELECT scaled, sum(n * abs(accuracy - confidence)) / sum(n) AS ece FROM b GROUP BY 1)
SELECT scaled, round(any_value(temperature), 4) AS temperature, round(any_value(ece), 4) AS ece, round(avg(-ln(probs[y + 1] + 1e-12)), 4) AS nll, round(avg(conf), 4) AS mean_confidence FROM c JOIN e USING (scaled) GROUP BY 1""")
def calibration_summary(t: Tables):
    """ECE, NLL and mean confidence before and after scaling by the temperature that validation rows give."""
    s = frozen_scored(t)
    best = calibration.fit_temperature(s.where("split = 'val'"), "logits", "y")
    steps = F.array(*[F.struct(F.lit(x).alias("scaled"), F.lit(v).alias("temperature")) for x, v in ((False, 1.0), (True, best))])
    both = s.select("id", "y", "correct", "logits", F.inline(steps)).withColumn("probs", arrays.softmax("logits", F.col("temperature")))
    both = freeze(both.withColumn("conf", F.array_max("probs")).drop("logits"))
    facts = both.groupBy("scaled").agg(
        F.max("temperature").alias("temperature"), F.avg(arrays.nll_term("probs", "y")).alias("nll"), F.avg("conf").alias("mean_confidence")
    )
    return rounded(calibration.ece(both, "conf", "correct", 15, ["scaled"]).join(facts, "scaled"), 4)


# ---------------------------------------------------------------- label audit


@query(f"WITH {SCORED} SELECT y AS cls, round(avg(probs[y + 1]), 6) AS threshold, count(*) AS n FROM scored GROUP BY 1")
def class_thresholds(t: Tables):
    return rounded(audit.self_confidence(scored(t), "probs", "y"))


_ISSUES = """th AS (SELECT y AS k, avg(probs[y + 1]) AS t, count(*) AS n FROM scored GROUP BY 1), tl AS (SELECT list(t ORDER BY k) AS t FROM th),
above AS (SELECT id, y, pred, list_filter(range(8), lambda k: probs[k + 1] >= tl.t[k + 1] - 1e-6) AS a FROM scored CROSS JOIN tl),
guess AS (SELECT y, CASE WHEN len(a) > 1 THEN pred ELSE a[1] END AS g FROM above WHERE len(a) > 0),
k AS (SELECT a.c AS i, b.c AS j FROM (SELECT unnest(range(8)) AS c) a CROSS JOIN (SELECT unnest(range(8)) AS c) b),
joint AS (SELECT i, j, CASE WHEN i = j THEN greatest(count(g.y), 1) ELSE count(g.y) END::DOUBLE AS n FROM k LEFT JOIN guess g ON g.y = i AND g.g = j GROUP BY 1, 2),
cal AS (SELECT i, j, joint.n / sum(joint.n) OVER (PARTITION BY i) * th.n AS v FROM joint JOIN th ON th.k = i),
calr AS (SELECT i, j, floor(v + 1e-9) + (row_number() OVER (PARTITION BY i ORDER BY v - floor(v + 1e-9) DESC, j) <= round(sum(v) OVER (PARTITION BY i) - sum(floor(v + 1e-9)) OVER (PARTITION BY i)))::INT AS v FROM cal),
diag AS (SELECT i AS c, v AS d FROM calr WHERE i = j),
pcm AS (SELECT j AS k, i AS j, v FROM calr),
lift AS (SELECT p.k, p.j, CASE WHEN p.k = p.j THEN greatest(v, 1) ELSE greatest(v - (greatest(d, 1) - d) / greatest(count(*) FILTER (v > 0) OVER (PARTITION BY p.j) - 1, 1), 0) END AS v FROM pcm p JOIN diag ON c = p.j),
drp AS (SELECT k, j, floor(v + 1e-9) + (row_number() OVER (PARTITION BY k ORDER BY v - floor(v + 1e-9) DESC, j) <= round(sum(v) OVER (PARTITION BY k) - sum(floor(v + 1e-9)) OVER (PARTITION BY k)))::INT AS n FROM lift),
mar AS (SELECT s.id, s.y, s.pred, d.n, probs[d.k + 1] - probs[s.y + 1] AS m, rank() OVER (PARTITION BY s.y, d.k ORDER BY probs[d.k + 1] - probs[s.y + 1] DESC) AS r FROM scored s JOIN drp d ON d.j = s.y AND d.k <> s.y AND d.n > 0),
hit AS (SELECT DISTINCT id FROM mar WHERE r <= n AND pred <> y)"""
_ISSUE_SQL = f"WITH {SCORED}, {_ISSUES}"


@query(f"{_ISSUE_SQL} SELECT s.id, s.y, s.pred, round(probs[y + 1], 6) AS given_prob, round(conf, 6) AS pred_prob FROM scored s SEMI JOIN hit USING (id)")
def label_issues(t: Tables):
    """Doubtful labels by confident learning, from per-class thresholds and pruned margins."""
    return rounded(audit.label_issues(scored(t), "id", "probs", "y", len(CLASSES)))


@query(f"""{_ISSUE_SQL}, iss AS (SELECT s.y, s.pred FROM scored s SEMI JOIN hit USING (id))
SELECT 'all' AS section, 'issues' AS key, count(*) AS n, round(count(*) / (SELECT count(*) FROM scored), 6) AS rate FROM iss
UNION ALL SELECT 'label', y::VARCHAR, count(*), NULL FROM iss GROUP BY y UNION ALL SELECT 'pair', y || '>' || pred, count(*), NULL FROM iss GROUP BY y, pred""")
def audit_summary(t: Tables):
    s = frozen_scored(t)
    issues = freeze(audit.label_issues(s, "id", "probs", "y", len(CLASSES)))
    return rounded(audit.audit_summary(issues, s.count()))


FOLDS = 5

_OUT_OF_FOLD = f"""{VECTORS}, o_fold AS (SELECT vec_id AS id, split, label AS y, v, floor(('0x' || substr(md5('fold:' || vec_id), 1, 8))::BIGINT / 4294967296.0 * {FOLDS})::INT AS fold FROM emb WHERE label < 8),
o_sum AS (SELECT fold, y, d, sum(x) AS s, count(*) AS n FROM (SELECT fold, y, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM o_fold) GROUP BY ALL),
o_cent AS (SELECT fold, k, list(c ORDER BY d) AS c FROM (SELECT f.fold, o.y AS k, d, sum(s) / sum(n) AS c FROM (SELECT DISTINCT fold FROM o_fold) f JOIN o_sum o ON o.fold <> f.fold GROUP BY ALL) GROUP BY ALL),
o_logit AS (SELECT id, any_value(o.fold) AS fold, any_value(y) AS y, list({SCALE} * list_dot_product(v, c) ORDER BY k) AS logits FROM o_fold o JOIN o_cent USING (fold) GROUP BY id),
o_pow AS (SELECT *, list_transform(logits, lambda z: exp(z - list_max(logits))) AS pw FROM o_logit),
o_prob AS (SELECT id, fold, y, list_transform(pw, lambda p: p / list_sum(pw)) AS probs FROM o_pow),
scored AS (SELECT *, (list_position(probs, list_max(probs)) - 1)::INT AS pred, list_max(probs) AS conf FROM o_prob), {_ISSUES}"""


def _out_of_fold(t: Tables):
    v = vectors(t).where(F.col("label").isin(*CLASSES)).select(F.col("vec_id").alias("id"), F.col("label").alias("y"), "embedding")
    folded = v.withColumn("fold", F.floor(hash_uniform("fold", "id") * FOLDS).cast("int"))
    logits = audit.out_of_fold_centroids(folded, "embedding", "y", "fold", CLASSES, SCALE).drop("embedding")
    return freeze(metrics.predicted(logits.withColumn("probs", arrays.softmax("logits"))))


@query(f"""WITH {_OUT_OF_FOLD} SELECT row_number() OVER (ORDER BY s.probs[s.y + 1], s.id) AS rank, s.id, s.fold, s.y, s.pred, round(s.probs[s.y + 1], 6) AS given_prob, round(s.conf, 6) AS pred_prob FROM scored s SEMI JOIN hit USING (id)""")
def ranked_label_issues(t: Tables):
    """Doubtful labels from out-of-fold probabilities, the least self-confident first."""
    s = _out_of_fold(t)
    issues = audit.ranked_issues(audit.label_issues(s, "id", "probs", "y", len(CLASSES)), "id")
    return rounded(issues.join(s.select("id", "fold"), "id"))


@query(f"""WITH {_OUT_OF_FOLD}, iss AS (SELECT s.y, s.pred FROM scored s SEMI JOIN hit USING (id)), {_sql_metrics('scored')}
SELECT 'all' AS section, 'issues' AS key, count(*) AS n, round(count(*) / (SELECT count(*) FROM scored), 6) AS rate FROM iss
UNION ALL SELECT 'label', y::VARCHAR, count(*), NULL FROM iss GROUP BY y UNION ALL SELECT 'pair', y || '>' || pred, count(*), NULL FROM iss GROUP BY y, pred
UNION ALL SELECT 'model', 'oof_accuracy', n, round(accuracy, 6) FROM core UNION ALL SELECT 'model', 'oof_macro_f1', n, round(macro_f1, 6) FROM core""")
def audit_report(t: Tables):
    """Counts of doubtful labels with accuracy and macro F1 of the out-of-fold predictions."""
    s = _out_of_fold(t)
    issues = freeze(audit.label_issues(s, "id", "probs", "y", len(CLASSES)))
    return rounded(audit.audit_report(issues, s, "y"))


def _folded(t: Tables, folds: int):
    v = vectors(t).where(F.col("label").isin(*CLASSES))
    dealt = splits.group_folds(v, "vec_id", "label", folds)
    return freeze(v.join(dealt, "vec_id"))


@query()
def out_of_fold_rows(t: Tables):
    """Each vector once, scored by a linear probe fitted on the other folds."""
    oof = audit.out_of_fold(_folded(t, 5), "embedding", "label", "fold", 5, audit.Probe)
    return rounded(oof.select("vec_id", "label", "fold", "pred", F.array_max("probs").alias("conf")))


@query()
def probe_report(t: Tables):
    """Linear probe fitted on train and reported per class on val."""
    v = vectors(t).where(F.col("label").isin(*CLASSES))
    fitted = audit.Probe().fit(v.where("split = 'train'"), "embedding", "label")
    out = fitted.predict(v.where("split = 'val'"), "embedding")
    return rounded(metrics.class_report(metrics.cells(out, y="label"), CLASSES))


def hashing_embedder():
    """A deterministic stand-in for a user model: 16 hashed character counts of each text."""

    def predict(texts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), 16), dtype=np.float32)
        for i, s in enumerate(texts):
            codes = np.frombuffer(str(s).encode(), dtype=np.uint8)
            out[i] = np.bincount(codes % 16, minlength=16)
        return out

    return predict


@query("SELECT sha256(text) AS key, strlen(text)::DOUBLE AS total FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id)) GROUP BY ALL")
def incremental_embedding(t: Tables):
    """Batch model over the content the store lacks, once per distinct content."""
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("key"), "text")
    store = d.join(t("labels").select("doc_id"), "doc_id", "left_semi").select("key")
    out = audit.embed_new(d, store, "key", "text", hashing_embedder, 32)
    return out.select("key", F.aggregate("emb", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))
