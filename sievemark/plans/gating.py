"""Queries on foreignness scores, gates and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemark.functions import arrays
from sievemark.functions.hashing import hash_uniform
from sievemark.operators import bundle, gates, metrics, ood
from sievemark.operators.ordered import quantiles
from sievemark.operators.vector_pairs import kth_cosine
from sievemark.plans.datasets import CLASSES, VECTORS, centroids, scored, sql_refined, sql_scored, vectors
from sievemark.plans.registry import Tables, query, rounded
from sievemark.session import freeze, scratch_path

K = 10
QHAT, TAU, TAU_CONF = 0.7, 0.8, 0.45
NAMES = tuple(f"class {c}" for c in CLASSES)
BOUNDS = {
    "min_brightness": 20.0, "max_brightness": 235.0, "min_contrast": 6.0, "min_sharpness": 4.0, "min_green_frac": 0.05,
}

# ---------------------------------------------------------------- scores

_SCORES = f"""{VECTORS}, {sql_scored(train_only=True, known=False)},
pairs AS (SELECT q.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, b.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(b.v, b.v)) DESC) AS r,
  list_dot_product(q.v, b.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(b.v, b.v)) AS c
  FROM emb q CROSS JOIN (SELECT v FROM emb WHERE split = 'train' AND label < 8) b WHERE q.split <> 'train' OR q.label >= 8),
rows AS (SELECT s.id, CASE WHEN y < 8 THEN split WHEN split = 'test' THEN 'test' ELSE 'cal' END AS split,
  CASE y WHEN 8 THEN 'near' WHEN 9 THEN 'far' ELSE 'id' END AS kind, 'source ' || s.id % 5 AS source, y, pred, conf, correct, probs,
  1 - conf AS msp, -(list_max(logits) + ln(list_sum(list_transform(logits, lambda z: exp(z - list_max(logits)))))) AS energy, 1 - c AS knn
  FROM scored s JOIN pairs p ON p.id = s.id AND p.r = {K}),
long AS (SELECT id, split, kind, source, 'msp' AS scorer, msp AS score FROM rows UNION ALL SELECT id, split, kind, source, 'energy', energy FROM rows
  UNION ALL SELECT id, split, kind, source, 'knn', knn FROM rows)"""


def _held(rows: DataFrame) -> DataFrame:
    """Held-out and foreign rows of (id, split, y) with their part, kind and source; no score is needed for that."""
    inside = F.col("y").isin(*CLASSES)
    return rows.where(~inside | (F.col("split") != "train")).withColumns(
        {
            "split": F.when(inside, F.col("split")).when(F.col("split") == "test", "test").otherwise("cal"),
            "kind": F.when(F.col("y") == 8, "near").when(F.col("y") == 9, "far").otherwise("id"),
            "source": F.concat(F.lit("source "), (F.col("id") % 5).cast("string")),
        }
    )


def _rows(t: Tables) -> DataFrame:
    """Held-out and foreign vectors with three scores; the bank and centroids use train only."""
    v = vectors(t)
    known = F.col("label").isin(*CLASSES)
    bank = v.where(known & (F.col("split") == "train"))
    asked = v.where(~known | (F.col("split") != "train"))
    near = kth_cosine(asked, "vec_id", "embedding", bank, "vec_id", "embedding", K)
    s = _held(scored(t, train_only=True, known=False)).join(near.withColumnRenamed("vec_id", "id"), "id")
    return freeze(
        s.select(
            "id", "split", "kind", "source", "y", "pred", "conf", "correct", "probs",
            (1 - F.col("conf")).alias("msp"), arrays.energy("logits").alias("energy"), (1 - F.col("kth")).alias("knn"),
        )
    )


def _long(t: Tables) -> DataFrame:
    return _rows(t).unpivot(["id", "split", "kind", "source"], ["msp", "energy", "knn"], "scorer", "score")


@query(f"WITH {_SCORES} SELECT id, split, kind, round(msp, 6) AS msp, round(energy, 6) AS energy, round(knn, 6) AS knn FROM rows")
def foreign_scores(t: Tables):
    return rounded(_rows(t).select("id", "split", "kind", "msp", "energy", "knn"))


@query(f"""WITH {VECTORS}, train AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM emb WHERE split = 'train' AND label < 8)
SELECT label, dim::INT AS dim, round(avg(x), 6) AS mean FROM train GROUP BY 1, 2""")
def class_mean_vectors(t: Tables):
    train = vectors(t).where(F.col("label").isin(*CLASSES) & (F.col("split") == "train"))
    means = ood.class_means(train, "embedding", "label")
    return rounded(means.select("label", F.posexplode("mean").alias("dim", "mean")))


def _mahalanobis(t: Tables) -> DataFrame:
    train = vectors(t).where(F.col("label").isin(*CLASSES) & (F.col("split") == "train"))
    means = centroids(t, True)
    cov = ood.shrunk_covariance(train, "embedding", "label", means, CLASSES)
    held = vectors(t).where(~(F.col("label").isin(*CLASSES) & (F.col("split") == "train")))
    return held.select("vec_id", arrays.whitened_distance("embedding", means, cov).alias("score"))


_COV = """c_tr AS (SELECT vec_id, label, v FROM emb WHERE split = 'train' AND label < 8),
c_x AS (SELECT vec_id, label, unnest(v) AS x, (unnest(range(0, len(v))))::INT AS i FROM c_tr),
c_m AS (SELECT label, i, avg(x) AS m FROM c_x GROUP BY 1, 2), c_r AS (SELECT vec_id, x.i, x - m AS r FROM c_x x JOIN c_m m ON m.label = x.label AND m.i = x.i),
c_n AS (SELECT count(*)::DOUBLE AS n FROM c_tr), c_o AS (SELECT i, avg(r) AS o FROM c_r GROUP BY 1),
c_cov AS (SELECT a.i, b.i AS j, sum(a.r * b.r) / any_value(c_n.n) - any_value(oa.o) * any_value(ob.o) AS c FROM c_r a JOIN c_r b USING (vec_id) JOIN c_o oa ON oa.i = a.i JOIN c_o ob ON ob.i = b.i, c_n GROUP BY 1, 2),
c_f AS (SELECT sum(s * s) AS fourth FROM (SELECT sum(r * r) AS s FROM c_r GROUP BY vec_id)),
c_k AS (SELECT sum(c) FILTER (i = j) AS tr, sum(c * c) AS spread, (max(i) + 1)::DOUBLE AS d FROM c_cov),
c_g AS (SELECT tr / d AS mu, (spread - 2 * (tr / d) * tr + d * (tr / d) * (tr / d)) / d AS gap, greatest((fourth / n - spread) / (n * d), 0) AS noise FROM c_k, c_f, c_n),
shrunk AS (SELECT i, j, (1 - least(noise, gap) / gap) * c + CASE WHEN i = j THEN least(noise, gap) / gap * mu ELSE 0 END AS value FROM c_cov, c_g)"""

# The inverse by elimination, a pivot a step, and the smallest quadratic form; the Spark side whitens by a Cholesky factor.
_MAHALANOBIS = f"""{_COV}, square AS (SELECT list(line ORDER BY i) AS m FROM (SELECT i, list(value ORDER BY j) AS line FROM shrunk GROUP BY i)),
steps_ (k, m) AS (SELECT 0, list_transform(m, lambda line, i: list_concat(line, list_transform(range(1, len(line) + 1), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))) FROM square
  UNION ALL SELECT k + 1, list_transform(m, lambda line, i: CASE WHEN i = k + 1 THEN list_transform(line, lambda x: x / line[k + 1])
    ELSE list_transform(line, lambda x, j: x - line[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM steps_ WHERE k < len(m)),
inverse AS (SELECT list_transform(m, lambda line: line[len(m) + 1 : 2 * len(m)]) AS p FROM steps_ WHERE k = len(m)),
gaps_ AS (SELECT e.vec_id, list_transform(list_zip(e.v, c.c), lambda z: z[1] - z[2]) AS d FROM emb e CROSS JOIN scored_cent c WHERE e.split <> 'train' OR e.label >= 8),
far AS (SELECT vec_id, min(list_dot_product(d, list_transform(p, lambda line: list_dot_product(line, d)))) AS mahalanobis FROM gaps_ CROSS JOIN inverse GROUP BY 1)"""

_FOUR = f"""{_SCORES}, {_MAHALANOBIS}, long4 AS (SELECT * FROM long UNION ALL SELECT id, split, kind, source, 'mahalanobis', mahalanobis FROM rows JOIN far ON vec_id = id)"""


@query(f"""WITH {VECTORS}, {_COV} SELECT i, j, round(value, 6) AS value FROM shrunk""")
def shrunk_covariance(t: Tables):
    """The shared covariance under the foreignness score, before its inverse."""
    train = vectors(t).where(F.col("label").isin(*CLASSES) & (F.col("split") == "train"))
    m = ood.shrunk_covariance(train, "embedding", "label", centroids(t, True), CLASSES)
    rows = t.spark.createDataFrame([(m.tolist(),)], "m array<array<double>>")  # dims² numbers
    lines = rows.select(F.posexplode("m").alias("i", "line"))
    return rounded(lines.select("i", F.posexplode("line").alias("j", "value")))


@query(f"WITH RECURSIVE {VECTORS}, {sql_scored(train_only=True, known=False)}, {_MAHALANOBIS} SELECT vec_id, round(mahalanobis, 4) AS score FROM far")
def mahalanobis_scores(t: Tables):
    """Smallest squared distance to a class mean under the shrunk shared covariance."""
    return rounded(_mahalanobis(t), 4)


@query(f"""WITH {VECTORS}, bank AS (SELECT 'original' AS variant, v FROM emb WHERE split = 'train' AND label < 8 UNION ALL SELECT 'reversed', list_reverse(v) FROM emb WHERE split = 'train' AND label < 8),
cells AS (SELECT variant, (unnest(range(0, len(v))))::INT AS dim, unnest(list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12))) AS x FROM bank)
SELECT variant, dim, count(*) AS n, round(avg(x), 6) AS mean FROM cells GROUP BY 1, 2""")
def reference_bank(t: Tables):
    """Unit vectors of every variant of the training vectors, in one bank."""
    train = vectors(t).where(F.col("label").isin(*CLASSES) & (F.col("split") == "train"))
    bank = train.select(F.lit("original").alias("variant"), "embedding").unionByName(
        train.select(F.lit("reversed").alias("variant"), F.reverse("embedding").alias("embedding"))
    )
    unit = bank.select("variant", F.posexplode(arrays.unit("embedding")).alias("dim", "x"))
    return rounded(unit.groupBy("variant", "dim").agg(F.count("*").alias("n"), F.avg("x").alias("mean")))


@query(f"""WITH {VECTORS}, asked AS (SELECT vec_id, vec_id % 40 AS key, CASE WHEN vec_id % 7 <> 0 THEN v END AS v FROM emb),
sims AS (SELECT a.vec_id, a.key, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS c
  FROM asked a CROSS JOIN (SELECT v FROM asked WHERE v IS NOT NULL AND vec_id % 3 = 0) b WHERE a.v IS NOT NULL)
SELECT a.key, round(r.kth, 6) AS kth FROM asked a LEFT JOIN (SELECT vec_id, list_sort(list(c), 'DESC')[{K}] AS kth FROM sims GROUP BY 1) r USING (vec_id)""")
def knn_with_gaps(t: Tables):
    """The cell search with missing vectors and repeated keys: a row for each query row, NULL where there is no vector."""
    gaps = F.when(F.pmod("vec_id", F.lit(7)) != 0, F.col("embedding"))
    asked = t("embeddings").select("vec_id", F.pmod("vec_id", F.lit(40)).alias("key"), gaps.alias("v"))
    bank = asked.where("vec_id % 3 = 0").select(F.col("vec_id").alias("b"), "v")
    return rounded(kth_cosine(asked, "key", "v", bank, "b", "v", K, bank_bytes=0))


def _sql_areas(long: str) -> str:
    return f"""sides AS (SELECT scorer, kind, score, true AS pos FROM {long} WHERE split = 'cal'
  UNION ALL SELECT scorer, unnest(['near', 'far']), score, false FROM {long} WHERE split = 'val'),
ranks AS (SELECT *, rank() OVER (PARTITION BY scorer, kind ORDER BY score) + (count(*) OVER (PARTITION BY scorer, kind, score) - 1) / 2.0 AS r FROM sides),
areas AS (SELECT scorer, kind, (sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos)::DOUBLE * count(*) FILTER (NOT pos)) AS auroc FROM ranks GROUP BY 1, 2)"""


def _areas(t: Tables) -> DataFrame:
    return ood.scorer_comparison(_long(t).where("split in ('val', 'cal')"))


def _long4(t: Tables) -> DataFrame:
    far = _mahalanobis(t).withColumnsRenamed({"vec_id": "id", "score": "mahalanobis"})
    names = ["msp", "energy", "mahalanobis", "knn"]
    return _rows(t).join(far, "id").unpivot(["id", "split", "kind", "source"], names, "scorer", "score")


def _four_areas(t: Tables) -> DataFrame:
    return ood.scorer_comparison(_long4(t).where("split in ('val', 'cal')"))


@query(f"WITH {_SCORES}, {_sql_areas('long')} SELECT scorer, kind, round(auroc, 6) AS auroc FROM areas")
def scorer_areas(t: Tables):
    return rounded(_areas(t))


@query(f"""WITH RECURSIVE {_FOUR}, {_sql_areas('long4')}, m AS (SELECT scorer, avg(auroc) AS a FROM areas GROUP BY 1)
SELECT scorer, round(a, 6) AS mean_auroc FROM m WHERE a >= (SELECT max(a) FROM m) - 0.001 ORDER BY list_position(['knn', 'mahalanobis', 'energy', 'msp'], scorer) LIMIT 1""")
def chosen_scorer(t: Tables):
    return rounded(ood.choose_scorer(_four_areas(t)))


@query(f"WITH RECURSIVE {_FOUR}, {_sql_areas('long4')} SELECT scorer, kind, round(auroc, 6) AS auroc FROM areas")
def all_scorer_areas(t: Tables):
    """Areas of all four scorers."""
    return rounded(_four_areas(t))


@query(f"""WITH RECURSIVE {_FOUR}, tau AS (SELECT scorer, quantile_cont(score, 0.95) AS tau FROM long4 WHERE split = 'val' GROUP BY 1),
test AS (SELECT scorer, kind, score, score <= tau AS kept FROM long4 JOIN tau USING (scorer) WHERE split = 'test'),
acc AS (SELECT scorer, avg(kept::INT) AS id_acceptance FROM test WHERE kind = 'id' GROUP BY 1),
sides AS (SELECT scorer, unnest([kind, 'all']) AS kind, score, kept, true AS pos FROM test WHERE kind <> 'id' UNION ALL SELECT scorer, unnest(['near', 'far', 'all']), score, kept, false FROM test WHERE kind = 'id'),
ranks AS (SELECT *, rank() OVER (PARTITION BY scorer, kind ORDER BY score) + (count(*) OVER (PARTITION BY scorer, kind, score) - 1) / 2.0 AS r FROM sides)
SELECT scorer, kind, round((sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos)::DOUBLE * count(*) FILTER (NOT pos)), 6) AS auroc,
  round(avg(kept::INT) FILTER (pos), 6) AS fpr, round(any_value(id_acceptance), 6) AS id_acceptance FROM ranks JOIN acc USING (scorer) GROUP BY 1, 2""")
def foreign_test_report(t: Tables):
    return rounded(ood.test_report(freeze(_long4(t))))


@query(f"""WITH {_SCORES}, tau AS (SELECT quantile_cont(knn, 0.95) AS tau FROM rows WHERE split = 'val')
SELECT source, count(*) AS n, round(avg((knn <= tau)::INT), 6) AS accepted FROM rows CROSS JOIN tau WHERE split = 'test' AND kind <> 'id' GROUP BY 1""")
def source_acceptance(t: Tables):
    rows = _rows(t)
    tau = quantiles(rows.where("split = 'val'"), "knn", {"tau": 0.95}).first()["tau"]
    foreign = rows.where("split = 'test' and kind <> 'id'").withColumnRenamed("knn", "score")
    return rounded(ood.acceptance_by(foreign, "source", tau))


# ---------------------------------------------------------------- thresholds

_MEASURES = """measures AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 5 AS brightness, l_extendedprice / 4000 AS contrast, l_tax * 1000 AS sharpness, l_discount AS green_frac FROM lineitem)"""


def _measures(t: Tables) -> DataFrame:
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 5).alias("brightness"),
        (F.col("l_extendedprice") / 4000).alias("contrast"), (F.col("l_tax") * 1000).alias("sharpness"),
        F.col("l_discount").alias("green_frac"),
    )


_MEASURE_NAMES = ("brightness", "contrast", "sharpness", "green_frac")
_ISSUE_LIST = """list_filter([CASE WHEN brightness < 20 THEN 'too_dark' END, CASE WHEN brightness > 235 THEN 'too_bright' END, CASE WHEN sharpness < 4 THEN 'too_blurry' END,
  CASE WHEN contrast < 6 THEN 'low_contrast' END, CASE WHEN green_frac < 0.05 THEN 'no_leaf' END], lambda x: x IS NOT NULL)"""


def _gate(bounds: dict[str, float] = BOUNDS):
    return gates.quality_issues(*[F.col(c) for c in _MEASURE_NAMES], bounds)


@query(f"WITH {_MEASURES}, g AS (SELECT array_to_string({_ISSUE_LIST}, ';') AS issues FROM measures) SELECT issues, count(*) AS n FROM g GROUP BY 1")
def quality_gate(t: Tables):
    return _measures(t).groupBy(F.array_join(_gate(), ";").alias("issues")).agg(F.count("*").alias("n"))


@query(f"""WITH {_MEASURES}, long AS (UNPIVOT (SELECT brightness, contrast, sharpness, green_frac FROM measures) ON brightness, contrast, sharpness, green_frac INTO NAME measure VALUE value)
SELECT measure, round(quantile_cont(value, 0.005), 6) AS low, round(quantile_cont(value, 0.995), 6) AS high FROM long GROUP BY 1""")
def quality_bounds(t: Tables):
    long_rows = _measures(t).select(*_MEASURE_NAMES).unpivot([], list(_MEASURE_NAMES), "measure", "value")
    return rounded(gates.percentile_bounds(long_rows, "measure", "value"))


@query(f"""WITH {_MEASURES}, graded AS (SELECT l_linenumber AS severity, brightness / l_linenumber AS brightness, contrast + l_linenumber AS contrast, sharpness, green_frac FROM measures),
steps AS (SELECT 'brightness' AS measure, severity, avg((brightness > 22)::INT) AS accuracy, quantile_cont(brightness, 0.5) AS m FROM graded GROUP BY 2
  UNION ALL SELECT 'contrast', severity, avg((contrast > 1.2)::INT), quantile_cont(contrast, 0.5) FROM graded GROUP BY 2
  UNION ALL SELECT 'sharpness', severity, avg((sharpness > 35)::INT), quantile_cont(sharpness, 0.5) FROM graded GROUP BY 2),
pct AS (SELECT 'brightness' AS measure, quantile_cont(brightness, 0.6) AS p FROM measures UNION ALL SELECT 'contrast', quantile_cont(contrast, 0.6) FROM measures UNION ALL SELECT 'sharpness', quantile_cont(sharpness, 0.6) FROM measures),
b AS (SELECT *, lag(m) OVER (PARTITION BY measure ORDER BY severity) AS before FROM steps),
f AS (SELECT measure, min(severity) FILTER (accuracy < 0.9) AS fail, max(severity) AS last FROM b GROUP BY 1)
SELECT f.measure, round(p, 6) AS percentile, round(least(p, CASE WHEN fail IS NOT NULL THEN (coalesce((SELECT before FROM b WHERE b.measure = f.measure AND severity = fail), p) + (SELECT m FROM b WHERE b.measure = f.measure AND severity = fail)) / 2
  ELSE (SELECT m FROM b WHERE b.measure = f.measure AND severity = last) END), 6) AS threshold FROM f JOIN pct USING (measure)""")
def degradation_thresholds(t: Tables):
    """Thresholds where accuracy on ever worse data first drops below 90%."""
    m = _measures(t)
    names = ["brightness", "contrast", "sharpness"]
    pct = quantiles(m.select(*names).unpivot([], names, "measure", "value"), "value", {"percentile": 0.6}, ["measure"])
    sev = F.col("l_linenumber")
    graded = m.select(
        sev.alias("severity"), (F.col("brightness") / sev).alias("brightness"), (F.col("contrast") + sev).alias("contrast"), "sharpness"
    )
    long_rows = freeze(graded.unpivot(["severity"], names, "measure", "value"))
    floor = F.when(F.col("measure") == "brightness", 22.0).when(F.col("measure") == "contrast", 1.2).otherwise(35.0)
    accuracy = long_rows.groupBy("measure", "severity").agg(F.avg((F.col("value") > floor).cast("double")).alias("accuracy"))
    medians = quantiles(long_rows, "value", {"median_measure": 0.5}, ["measure", "severity"])
    return rounded(gates.degradation_thresholds(accuracy.join(medians, ["measure", "severity"]), pct))


_LADDER = "[0.95, 0.96, 0.97, 0.98, 0.99, 0.995]::DOUBLE[]"


@query(f"""WITH {_SCORES}, q AS (SELECT unnest({_LADDER}) AS level), tau AS (SELECT level, (SELECT quantile_cont(knn, [0.95, 0.96, 0.97, 0.98, 0.99, 0.995]) FROM rows WHERE split = 'val')[list_position({_LADDER}, level)] AS tau FROM q),
s AS (SELECT level, tau, (SELECT avg((knn <= tau)::INT) FROM rows WHERE split = 'cal') AS share FROM tau),
pick AS (SELECT coalesce(max(level) FILTER (share <= 0.95), 0.95) AS level FROM s)
SELECT level, round(tau, 6) AS tau FROM s JOIN pick USING (level)""")
def foreign_threshold(t: Tables):
    rows = _rows(t)
    return rounded(gates.foreign_threshold(rows.where("split = 'val'"), rows.where("split = 'cal'"), "knn", 0.95))


def _sql_tau_conf(target: float) -> str:
    return f"""steps AS (SELECT conf, avg(correct::INT) OVER (ORDER BY conf DESC RANGE UNBOUNDED PRECEDING) AS a FROM scored WHERE split = 'val')
SELECT round(coalesce(min(conf) FILTER (a >= {target}), 0.5), 6) AS tau_conf FROM steps"""


@query(f"WITH {VECTORS}, {sql_scored()}, {_sql_tau_conf(0.75)}")
def confidence_threshold(t: Tables):
    return rounded(gates.confidence_threshold(scored(t).where("split = 'val'"), "conf", "correct", 0.75))


# ---------------------------------------------------------------- decisions


def _sql_uniform(seed: str, key: str = "id") -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0)"


_QUALITY = f"""{_sql_uniform('brightness')} * 255 AS brightness, {_sql_uniform('contrast')} * 60 AS contrast,
  {_sql_uniform('sharpness')} * 100 AS sharpness, {_sql_uniform('green')} AS green_frac"""


def with_quality(df: DataFrame) -> DataFrame:
    """Reproducible stand-in measures per record."""
    return df.withColumns(
        {
            "brightness": hash_uniform("brightness", "id") * 255,
            "contrast": hash_uniform("contrast", "id") * 60,
            "sharpness": hash_uniform("sharpness", "id") * 100,
            "green_frac": hash_uniform("green", "id"),
        }
    )


HINTS = {k: f"see {k}" for k in ("too_dark", "too_bright", "too_blurry", "low_contrast", "no_leaf", "ood", "low_confidence")}
_ADVICE = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in HINTS.items()) + "}"


def _sql_decide(
    source: str, name: str = "decided", qhat: object = QHAT, tau: object = TAU, tau_conf: object = TAU_CONF, issues: str = _ISSUE_LIST
) -> str:
    return f"""{name}_q AS (SELECT *, {_QUALITY} FROM {source}),
{name}_i AS (SELECT *, {issues} AS issues FROM {name}_q),
{name}_m AS (SELECT *, list_transform(list_sort(list_transform(list_filter(range(8), lambda k: probs[k + 1] >= 1 - {qhat} OR k = pred), lambda k: {{'p': -probs[k + 1], 'k': k}})), lambda s: s.k) AS members FROM {name}_i),
{name}_s AS (SELECT *, CASE WHEN len(issues) > 0 THEN 'rejected' WHEN score > {tau} THEN 'rejected' WHEN len(members) = 1 AND conf >= {tau_conf} THEN 'accepted' ELSE 'uncertain' END AS status,
  CASE WHEN len(issues) > 0 THEN 'low_quality' WHEN score > {tau} THEN 'ood' WHEN len(members) = 1 AND conf >= {tau_conf} THEN NULL ELSE 'low_confidence' END AS reason FROM {name}_m),
{name} AS (SELECT id, y, source, split, kind, score, correct, pred, status, reason, CASE WHEN status <> 'rejected' THEN 'class ' || pred END AS label, CASE WHEN status <> 'rejected' THEN conf END AS confidence,
  CASE WHEN status <> 'rejected' THEN array_to_string(list_transform(members, lambda k: 'class ' || k), '|') ELSE '' END AS prediction_set,
  CASE WHEN reason = 'low_quality' THEN array_to_string(issues, '|') ELSE '' END AS issues,
  CASE WHEN reason = 'low_quality' THEN array_to_string(list_transform(issues, lambda i: {_ADVICE}[i]), '|') WHEN reason IS NOT NULL THEN {_ADVICE}[reason] ELSE '' END AS advice FROM {name}_s)"""


_DECIDED = f"""{_SCORES}, inputs AS (SELECT id, y, source, split, kind, probs, pred, conf, correct, knn AS score FROM rows), {_sql_decide('inputs')}"""


def decide_column(score: str = "score"):
    return gates.decide("probs", score, _gate(), NAMES, TAU, QHAT, TAU_CONF, HINTS)


def _decided(t: Tables) -> DataFrame:
    rows = with_quality(_rows(t).withColumn("score", F.col("knn")))
    return freeze(rows.withColumn("decision", decide_column()).drop("probs"))


_FLAT = "id, status, reason, label, round(confidence, 6) AS confidence, prediction_set, issues, advice"


def flat_decision(df: DataFrame) -> DataFrame:
    d = "decision."
    return rounded(
        df.select(
            "id", F.col(d + "status").alias("status"), F.col(d + "reason").alias("reason"), F.col(d + "label").alias("label"),
            F.col(d + "confidence").alias("confidence"), F.array_join(d + "prediction_set", "|").alias("prediction_set"),
            F.array_join(d + "issues", "|").alias("issues"), F.array_join(d + "advice", "|").alias("advice"),
        )
    )


@query(f"WITH {_DECIDED} SELECT {_FLAT} FROM decided")
def decisions(t: Tables):
    return flat_decision(_decided(t))


@query(f"WITH {_DECIDED} SELECT {_FLAT} FROM decided")
def gated_scoring(t: Tables):
    """Quality first: rejected rows never reach the scorer or the model, then both parts are united."""
    v = vectors(t)
    known = F.col("label").isin(*CLASSES)
    held = v.where(~known | (F.col("split") != "train")).withColumnRenamed("vec_id", "id")
    checked = with_quality(held).withColumn("issues", _gate())
    checked = freeze(checked)
    passed, failed = checked.where(F.size("issues") == 0), checked.where(F.size("issues") > 0)
    bank = v.where(known & (F.col("split") == "train"))
    near = kth_cosine(passed, "id", "embedding", bank, "vec_id", "embedding", K)
    weights = 60.0 * centroids(t, True)
    answered = passed.join(near, "id").select(
        "id", *_MEASURE_NAMES, (1 - F.col("kth")).alias("score"),
        arrays.linear_scores("embedding", weights).alias("logits"),
    )
    answered = answered.withColumn("probs", arrays.softmax("logits")).drop("logits")
    refused = failed.select("id", *_MEASURE_NAMES, F.lit(None).cast("double").alias("score"), F.lit(None).cast("array<double>").alias("probs"))
    return flat_decision(answered.unionByName(refused).withColumn("decision", decide_column()))


@query(f"""WITH {_DECIDED} SELECT kind, status || ':' || coalesce(reason, 'None') AS outcome, count(*) AS n FROM decided GROUP BY 1, 2""")
def decision_counts(t: Tables):
    return _decided(t).groupBy("kind", gates.outcome().alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""WITH {_DECIDED} SELECT split, count(*) AS n, round(avg((status = 'accepted')::INT), 6) AS accepted_share, round(avg(CASE WHEN status = 'accepted' THEN (label = 'class ' || y)::INT END), 6) AS accepted_accuracy FROM decided GROUP BY 1""")
def decision_summary(t: Tables):
    d = _decided(t).withColumn("truth", F.concat(F.lit("class "), F.col("y").cast("string")))
    return rounded(gates.decision_summary(d, "truth", by=["split"]))


@query(f"""WITH {_DECIDED}, o AS (SELECT source, CASE WHEN status = 'rejected' THEN reason ELSE status END AS outcome, count(*) AS n FROM decided GROUP BY 1, 2)
SELECT source, outcome, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM o""")
def condition_outcomes(t: Tables):
    return rounded(gates.outcome_shares(_decided(t), ["source"]))


@query(f"""WITH {_DECIDED} SELECT source, count(*) AS n, round(avg((status <> 'rejected')::INT), 6) AS passed_gates, round(quantile_cont(score, 0.5), 6) AS median_score, round(avg(correct::INT), 6) AS top1_accuracy FROM decided GROUP BY 1""")
def condition_summary(t: Tables):
    d = _decided(t)
    facts = d.groupBy("source").agg(
        F.count("*").alias("n"),
        F.avg((F.col("decision.status") != "rejected").cast("double")).alias("passed_gates"),
        F.avg(F.col("correct").cast("double")).alias("top1_accuracy"),
    )
    return rounded(facts.join(quantiles(d, "score", {"median_score": 0.5}, ["source"]), "source"))


@query(f"""WITH {_DECIDED} SELECT source, y, pred, count(*) AS n FROM decided WHERE kind = 'id' GROUP BY 1, 2, 3""")
def condition_confusion(t: Tables):
    answered = _held(scored(t, train_only=True, known=False))  # a cell is counted whatever was decided
    return metrics.cells(answered.where("kind = 'id'"), by=["source"])


@query(f"""WITH {_SCORES}, q AS (SELECT id, split, kind, {_QUALITY} FROM rows),
g AS (SELECT split || '/' || kind AS part, 'none' AS corruption, 0 AS severity, brightness, contrast, sharpness, green_frac FROM q
  UNION ALL SELECT 'test/id', 'brightness', s, brightness * (1 - 0.15 * s), contrast, sharpness, green_frac FROM q CROSS JOIN (SELECT unnest([3, 5]) AS s) WHERE split = 'test' AND kind = 'id'
  UNION ALL SELECT 'test/id', 'contrast', s, brightness, contrast * (1 - 0.15 * s), sharpness, green_frac FROM q CROSS JOIN (SELECT unnest([3, 5]) AS s) WHERE split = 'test' AND kind = 'id')
SELECT part, corruption, severity, count(*) AS n, round(avg((len({_ISSUE_LIST}) > 0)::INT), 6) AS rejected FROM g GROUP BY 1, 2, 3""")
def gate_rejections(t: Tables):
    """Share rejected by the quality gate: per part, and per corruption and severity on test."""
    held = _held(vectors(t).select(F.col("vec_id").alias("id"), "split", F.col("label").alias("y")))
    q = with_quality(held.select("id", "split", "kind"))
    part = F.concat_ws("/", "split", "kind").alias("part")
    none = q.select(part, F.lit("none").alias("corruption"), F.lit(0).alias("severity"), *_MEASURE_NAMES)
    worse = q.where("split = 'test' and kind = 'id'").withColumn("severity", F.explode(F.array(F.lit(3), F.lit(5))))
    factor = 1 - 0.15 * F.col("severity")
    out = none
    for name in ("brightness", "contrast"):
        changed = worse.withColumn(name, F.col(name) * factor)
        out = out.unionByName(changed.select(part, F.lit(name).alias("corruption"), "severity", *_MEASURE_NAMES))
    return rounded(
        out.groupBy("part", "corruption", "severity").agg(
            F.count("*").alias("n"), F.avg((F.size(_gate()) > 0).cast("double")).alias("rejected")
        )
    )


# ---------------------------------------------------------------- fitted bundle

GATE_PERCENT, MAX_ACCEPT, TARGET = 5.0, 0.9, 0.9  # the stand-in measures and foreign vectors need wider settings than photos

_FITTED_ISSUES = """list_filter([CASE WHEN brightness < b.lo[1] THEN 'too_dark' END, CASE WHEN brightness > b.hi[1] THEN 'too_bright' END, CASE WHEN sharpness < b.lo[3] THEN 'too_blurry' END,
  CASE WHEN contrast < b.lo[2] THEN 'low_contrast' END, CASE WHEN green_frac < b.lo[4] THEN 'no_leaf' END], lambda x: x IS NOT NULL)"""
_FITTED = f"""{_FOUR}, t_q AS (SELECT {_QUALITY} FROM (SELECT vec_id AS id FROM emb WHERE split = 'train' AND label < 8)),
b AS (SELECT {{'lo': [{', '.join(f'quantile_cont({c}, {GATE_PERCENT / 100})' for c in _MEASURE_NAMES)}], 'hi': [{', '.join(f'quantile_cont({c}, {1 - GATE_PERCENT / 100})' for c in _MEASURE_NAMES)}]}} AS b FROM t_q),
{sql_refined(source="rows JOIN scored USING (id) WHERE rows.kind = 'id' AND rows.split = 'val'", y="rows.y", logits="scored.logits")},
g_pow AS (SELECT r.id, r.split, r.kind, r.source, r.y, s.logits, temperature AS t, list_transform(s.logits, lambda z: exp((z - list_max(s.logits)) / temperature)) AS pw, r.knn, far.mahalanobis
  FROM rows r JOIN scored s USING (id) JOIN far ON far.vec_id = r.id CROSS JOIN fitted),
g_prob AS (SELECT * EXCLUDE (pw), list_transform(pw, lambda p: p / list_sum(pw)) AS probs, -t * (list_max(logits) / t + ln(list_sum(pw))) AS energy FROM g_pow),
g_rows AS (SELECT *, list_max(probs) AS conf, 1 - list_max(probs) AS msp, (list_position(probs, list_max(probs)) - 1)::INT AS pred, list_position(probs, list_max(probs)) - 1 = y AS correct, {_QUALITY} FROM g_prob),
g_clean AS (SELECT g.*, {_FITTED_ISSUES} AS issues FROM g_rows g CROSS JOIN b),
g_score AS (SELECT 1 - probs[y + 1] AS s, row_number() OVER (ORDER BY 1 - probs[y + 1]) - 1 AS r, count(*) OVER () AS n FROM g_rows WHERE split = 'val'),
g_qhat AS (SELECT s AS qhat FROM g_score WHERE r = ceil(least(1.0, ceil((n + 1) * (1 - 0.1)) / n) * (n - 1))),
g_long AS (UNPIVOT (SELECT id, split, kind, msp, energy, knn, mahalanobis FROM g_rows WHERE split IN ('val', 'cal')) ON msp, energy, knn, mahalanobis INTO NAME scorer VALUE score),
{_sql_areas('g_long')}, g_mean AS (SELECT scorer, avg(auroc) AS a FROM areas GROUP BY 1),
g_best AS (SELECT scorer FROM g_mean WHERE a >= (SELECT max(a) FROM g_mean) - 0.001 ORDER BY list_position(['knn', 'mahalanobis', 'energy', 'msp'], scorer) LIMIT 1),
g_taus AS (SELECT unnest({_LADDER}) AS level, unnest(quantile_cont(score, {_LADDER})) AS tau FROM g_long SEMI JOIN g_best USING (scorer) WHERE split = 'val'),
g_share AS (SELECT level, tau, avg((score <= tau)::INT) AS share FROM g_taus CROSS JOIN (SELECT score FROM g_long SEMI JOIN g_best USING (scorer) WHERE split = 'cal') GROUP BY 1, 2),
g_tau AS (SELECT level, tau FROM g_share WHERE level = coalesce((SELECT max(level) FROM g_share WHERE share <= {MAX_ACCEPT}), 0.95)),
g_gated AS (SELECT *, CASE (SELECT scorer FROM g_best) WHEN 'msp' THEN msp WHEN 'energy' THEN energy WHEN 'knn' THEN knn ELSE mahalanobis END AS score FROM g_clean),
g_steps AS (SELECT conf, avg(correct::INT) OVER (ORDER BY conf DESC RANGE UNBOUNDED PRECEDING) AS a FROM g_gated CROSS JOIN g_tau WHERE split = 'val' AND len(issues) = 0 AND score <= tau),
g_conf AS (SELECT coalesce(min(conf) FILTER (a >= {TARGET}), 0.5) AS tau_conf FROM g_steps)"""


def _gate_rows(t: Tables) -> DataFrame:
    """Held-out and foreign rows with logits, measures and the two scores that need vectors."""
    far = _mahalanobis(t).withColumnsRenamed({"vec_id": "id", "score": "mahalanobis"})
    logits = scored(t, train_only=True, known=False).select("id", "logits")
    rows = _rows(t).select("id", "split", "kind", "source", "y", "knn").join(far, "id").join(logits, "id")
    return freeze(with_quality(rows))


def _gate_model(t: Tables, rows: DataFrame) -> bundle.GateModel:
    train = vectors(t).where(F.col("label").isin(*CLASSES) & (F.col("split") == "train"))
    measures = with_quality(train.select(F.col("vec_id").alias("id"))).select(*_MEASURE_NAMES)
    found = gates.percentile_bounds(measures.unpivot([], list(_MEASURE_NAMES), "measure", "value"), "measure", "value", GATE_PERCENT)
    edges = {r["measure"]: r for r in found.collect()}  # a row per measure
    bounds = {f"min_{m}": edges[m]["low"] for m in _MEASURE_NAMES} | {"max_brightness": edges["brightness"]["high"]}
    return bundle.GateEstimator(NAMES, bounds, HINTS, maxAccept=MAX_ACCEPT, target=TARGET).fit(rows)


@query(f"""WITH RECURSIVE {_FITTED} SELECT round(temperature, 4) AS temperature, round(qhat, 5) AS qhat, scorer, level, round(tau, 5) AS tau, round(tau_conf, 5) AS tau_conf, round(b.hi[1], 5) AS max_brightness,
round(b.lo[1], 5) AS min_brightness, round(b.lo[2], 5) AS min_contrast, round(b.lo[3], 5) AS min_sharpness, round(b.lo[4], 5) AS min_green_frac FROM fitted, g_qhat, g_best, g_tau, g_conf, b""")
def fitted_gates(t: Tables):
    """Every number that the estimator of the gates fits, in one row."""
    model = _gate_model(t, _gate_rows(t))
    get = model.getOrDefault
    values = {n: F.lit(v) for n, v in get("bounds").items()} | {
        "qhat": F.lit(get("qhat")), "scorer": F.lit(get("scorer")), "level": F.lit(get("level")),
        "tau": F.lit(get("tau")), "tau_conf": F.lit(get("tauConf")),
    }
    row = t.spark.range(1).select(*[v.alias(n) for n, v in values.items()])
    return rounded(row, 5).withColumn("temperature", F.round(F.lit(get("temperature")), 4))


@query(f"""WITH RECURSIVE {_FITTED}, inputs AS (SELECT id, y, source, split, kind, probs, pred, conf, correct, score, qhat + 1e-12::DOUBLE AS q_, tau AS t_, tau_conf AS c_, b
  FROM g_gated, g_qhat, g_tau, g_conf, b WHERE split = 'test'), {_sql_decide('inputs', 'decided', 'q_', 't_', 'c_', _FITTED_ISSUES)} SELECT {_FLAT.replace('6', '4')} FROM decided""")
def fitted_decisions(t: Tables):
    """Decisions on test rows by a model that was fitted, saved and loaded again."""
    rows = _gate_rows(t)
    path = scratch_path(t.spark, "gates")
    _gate_model(t, rows).save(path)
    return rounded(flat_decision(bundle.GateModel.load(path).transform(rows.where("split = 'test'"))), 4)
