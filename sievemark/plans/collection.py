"""Queries on records: sources, expressions, filters, joins, aggregates, windows, samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievemark.functions import arrays, hashing, rules, text
from sievemark.operators import aggregates, histories, joins, splits
from sievemark.operators.ordered import quantile_bin, with_position
from sievemark.plans.datasets import LANGS, MANIFEST, VECTORS, manifest
from sievemark.plans.registry import Tables, query, rounded
from sievemark.session import scratch_path
from sievemark.sources import tables

# ---------------------------------------------------------------- sources and sinks


@query("""SELECT doc_id, strlen(text)::BIGINT AS bytes,
  CASE WHEN strlen(text) > 0 THEN sha256(text) END AS sha256 FROM documents""")
def content_hash(t: Tables):
    size = F.octet_length("text").cast("long")
    return t("documents").select(
        "doc_id", size.alias("bytes"), F.when(size > 0, F.sha2("text", 256)).alias("sha256")
    )


@query(f"WITH {MANIFEST} SELECT path, sha256 FROM manifest")
def manifest_round_trip(t: Tables):
    path = scratch_path(t.spark, "manifest")
    tables.write_table(manifest(t).drop("text"), path)
    return tables.read_table(t.spark, path, ["path", "sha256"])


@query("SELECT doc_id, source, lang, n_chars FROM documents")
def csv_round_trip(t: Tables):
    path = scratch_path(t.spark, "split-csv")
    rows = t("documents").select("doc_id", "source", "lang", "n_chars")
    tables.write_csv(rows, path)
    return tables.read_csv(t.spark, path, rows.schema)


@query("""SELECT o_orderpriority AS priority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price
  FROM orders GROUP BY 1""")
def json_round_trip(t: Tables):
    report = t("orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count("*").alias("n"), F.struct(F.avg("o_totalprice").alias("mean")).alias("price")
    )
    path = scratch_path(t.spark, "report-json")
    tables.write_json(report, path)
    back = tables.read_json(t.spark, path, report.schema)
    return back.select("priority", "n", F.round("price.mean", 4).alias("mean_price"))


@query("""SELECT user_id AS run, event_type AS stage, event_id AS epoch, value AS train_loss,
  CASE WHEN value >= 50 THEN value END AS ema_val_macro_f1 FROM events""")
def history_lines(t: Tables):
    """JSON lines with absent keys, read back through a column whitelist."""
    e = t("events")
    lines = e.select(
        F.col("user_id").alias("run"), F.col("event_type").alias("stage"), F.col("event_id").alias("epoch"),
        F.col("value").alias("train_loss"), F.when(F.col("value") >= 50, F.col("value")).alias("ema_val_macro_f1"),
        F.col("props").alias("note"),
    )
    path = scratch_path(t.spark, "history")
    tables.write_json(lines, path)
    return tables.read_history(t.spark, path).select("run", "stage", "epoch", "train_loss", "ema_val_macro_f1")


@query("""SELECT sha256(array_to_string(embedding, ',')) IS NOT NULL AS keyed, vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS s
  FROM embeddings""")
def embedding_store(t: Tables):
    """Keyed vector store: append the keys it lacks, read it back."""
    e = t("embeddings").select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("emb"))
    path = scratch_path(t.spark, "store")
    tables.append_vectors(e.where("pmod(cast(key as long), 3) = 0"), path)
    tables.append_vectors(e, path)
    back = tables.read_vectors(t.spark, path)
    return back.select(
        F.col("key").isNotNull().alias("keyed"), F.col("key").cast("long").alias("vec_id"),
        F.round(arrays.total(F.transform("emb", lambda x: x.cast("double"))), 6).alias("s"),
    )


@query("""SELECT page_id, strlen(html)::BIGINT AS bytes FROM pages WHERE strlen(html) > 0 AND page_id % 7 <> 0""")
def image_cells(t: Tables):
    """Binary cells nested in Parquet: keep the non-empty ones."""
    cell = F.struct(
        F.when(F.col("page_id") % 7 == 0, F.encode(F.lit(""), "utf-8")).otherwise(F.encode("html", "utf-8")).alias("bytes"),
        F.col("url").alias("path"),
    )
    path = scratch_path(t.spark, "cells")
    tables.write_table(t("pages").select("page_id", cell.alias("image")), path)
    cells = tables.nonempty_cells(t.spark.read.parquet(path))
    return cells.select("page_id", F.octet_length("content").cast("long").alias("bytes"))


# ---------------------------------------------------------------- expressions


@query("""SELECT regexp_replace(regexp_replace(lower(p_brand || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
  count(*) AS n FROM part GROUP BY 1""")
def label_slugs(t: Tables):
    slug = text.label_slug(F.concat("p_brand", F.lit(" / "), "p_type"))
    return t("part").groupBy(slug.alias("slug")).agg(F.count("*").alias("n"))


@query(r"""WITH names AS (
  SELECT url AS p FROM pages UNION ALL SELECT c_name || CASE WHEN c_custkey % 3 = 0 THEN ' (2).jpg' ELSE '.jpeg' END FROM customer),
base AS (SELECT regexp_replace(p, '^.*/', '') AS b FROM names),
stem AS (SELECT CASE WHEN regexp_matches(b, '.\.[^.]+$') THEN regexp_replace(b, '\.[^.]+$', '') ELSE b END AS s FROM base)
SELECT regexp_replace(regexp_replace(s, '\s*\(\d+\)$', ''), '\d+', '#', 'g') AS pattern, count(*) AS n FROM stem GROUP BY 1""")
def name_patterns(t: Tables):
    suffix = F.when(F.col("c_custkey") % 3 == 0, " (2).jpg").otherwise(".jpeg")
    names = t("pages").select(F.col("url").alias("p")).unionByName(
        t("customer").select(F.concat("c_name", suffix).alias("p"))
    )
    return names.groupBy(text.name_pattern("p").alias("pattern")).agg(F.count("*").alias("n"))


_FOLDERS = ("Train aug", "raw/TEST", "validation set/x", "notes/validated", "val")


@query("""WITH p AS (SELECT doc_id, ['Train aug','raw/TEST','validation set/x','notes/validated','val'][(doc_id % 5) + 1] || '/' || lang || '/f.txt' AS path FROM documents),
f AS (SELECT doc_id, list_filter(string_split(lower(path), '/')[:-2],
  lambda x: string_split_regex(ltrim(x), '\\s+')[1] IN ('train','test','val','valid','validation')) AS hits FROM p)
SELECT coalesce(hits[1], '') AS source_split, count(*) AS n FROM f GROUP BY 1""".replace("\\\\s", "\\s"))
def source_splits(t: Tables):
    folder = F.get(F.array(*[F.lit(f) for f in _FOLDERS]), (F.col("doc_id") % 5).cast("int"))
    paths = t("documents").select(F.concat(folder, F.lit("/"), "lang", F.lit("/f.txt")).alias("path"))
    return paths.groupBy(text.source_split("path").alias("source_split")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' ' || upper(lang) || ' ' WHEN 1 THEN lang ELSE source END AS raw FROM documents),
l AS (SELECT doc_id, CASE lower(trim(raw)) WHEN 'src1' THEN 'de' WHEN 'src2' THEN 'fr' WHEN 'de' THEN 'de' WHEN 'en' THEN 'en'
  WHEN 'es' THEN 'es' WHEN 'fr' THEN 'fr' END AS label FROM r)
SELECT label, (list_position(['de','en','es','fr'], label) - 1)::INT AS class_id, count(*) AS n FROM l GROUP BY 1, 2""")
def canonical_labels(t: Tables):
    raw = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")))
        .when(F.col("doc_id") % 3 == 1, F.col("lang"))
        .otherwise(F.col("source"))
    )
    label = text.canonical_label(raw, LANGS, {"SRC1": "de", "src2 ": "fr"})
    rows = t("documents").select(label.alias("label"))
    return rows.groupBy("label", text.class_id("label", LANGS).alias("class_id")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, url FROM pages
  WHERE regexp_matches(regexp_replace(url, '^.*/', ''), '^\d+\.html') OR regexp_matches(regexp_replace(url, '^.*/', ''), 'utm_source')""")
def name_filter(t: Tables):
    return t("pages").where(text.matches_any("url", [r"^\d+\.html", "utm_source"])).select("page_id", "url")


_ISSUES = """issues AS (SELECT doc_id, source, n_chars,
  list_filter([CASE WHEN strlen(text) = 0 THEN 'empty_file' END,
   CASE WHEN strlen(text) > 0 AND contains(text, '%%%') THEN 'unreadable:Junk' END,
   CASE WHEN strlen(text) > 0 AND NOT contains(text, '%%%') AND source NOT IN ('src0','src1','src2','src3','src4','src5','src6','src7') THEN 'format:' || source END,
   CASE WHEN strlen(text) > 0 AND NOT contains(text, '%%%') AND n_chars < 300 THEN 'too_small' END,
   CASE WHEN lang = 'fr' THEN 'unknown_label' END], lambda x: x IS NOT NULL) AS issues FROM documents)"""


def _issues(t: Tables):
    d = t("documents")
    return d.select(
        "doc_id", "source", "n_chars",
        rules.scan_issues(
            F.octet_length("text"), F.when(F.contains("text", F.lit("%%%")), "Junk"), F.col("source"), F.col("n_chars"),
            F.when(F.col("lang") != "fr", F.col("lang")), [f"src{i}" for i in range(8)], 300,
        ).alias("issues"),
    )


@query(f"""WITH {_ISSUES} SELECT doc_id, array_to_string(issues, ';') AS issues, len(issues) = 0 AS is_valid FROM issues""")
def issue_lists(t: Tables):
    return _issues(t).select("doc_id", F.array_join("issues", ";").alias("issues"), (F.size("issues") == 0).alias("is_valid"))


@query(f"""WITH {_ISSUES} SELECT split_part(i, ':', 1) AS reason, count(*) AS n
  FROM (SELECT unnest(issues) AS i FROM issues) GROUP BY 1""")
def issue_histogram(t: Tables):
    return aggregates.reason_histogram(_issues(t), "issues")


@query("""SELECT p_brand, count(*) AS n, count(*) FILTER (NOT (p_size / (p_retailprice / 50.0) BETWEEN 0.5 AND 2.0)) AS warned
  FROM part GROUP BY 1""")
def warning_counts(t: Tables):
    """Parts of each brand, and those whose list of warnings holds one of shape."""
    w = rules.aspect_warnings(F.col("p_size"), F.col("p_retailprice") / 50.0, 0.5, 2.0)
    warned = F.count(F.when(rules.has_entry(F.col("w"), "aspect"), 1))
    return t("part").select("p_brand", w.alias("w")).groupBy("p_brand").agg(F.count("*").alias("n"), warned.alias("warned"))


@query("""SELECT p_partkey, CASE WHEN NOT (p_size / (p_retailprice / 50.0) BETWEEN 0.5 AND 2.0) THEN 'aspect' ELSE '' END AS warnings
  FROM part""")
def aspect_warnings(t: Tables):
    w = rules.aspect_warnings(F.col("p_size"), F.col("p_retailprice") / 50.0, 0.5, 2.0)
    return t("part").select("p_partkey", F.array_join(w, ";").alias("warnings"))


@query(f"""WITH {MANIFEST} SELECT doc_id, CASE WHEN lang <> 'es' THEN lang || '/' || substr(sha256, 1, 20) || '.jpg' END AS cache_path FROM manifest""")
def content_paths(t: Tables):
    m = manifest(t).withColumn("label", F.when(F.col("label") != "es", F.col("label")))
    return m.select("doc_id", text.content_path("label", "sha256").alias("cache_path"))


@query("""WITH h AS (SELECT doc_id, ('0x' || substr(md5(text), 1, 16))::UBIGINT AS a, ('0x' || substr(sha256(text), 1, 16))::UBIGINT AS b FROM documents)
SELECT doc_id, (CASE WHEN a >= 9223372036854775808 THEN a::HUGEINT - 18446744073709551616 ELSE a::HUGEINT END)::BIGINT AS bits,
  bit_count(xor(a, b))::INT AS distance FROM h""")
def hex_distance(t: Tables):
    d = t("documents").select(
        "doc_id",
        hashing.hex_to_long(F.substring(F.md5("text"), 1, 16)).alias("bits"),
        hashing.hex_to_long(F.substring(F.sha2("text", 256), 1, 16)).alias("other"),
    )
    return d.select("doc_id", "bits", hashing.hamming("bits", "other").alias("distance"))


@query(f"""WITH {VECTORS}, pairs AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_dot_product(a, b), 6) AS dot,
  round(list_dot_product(a, b) / (greatest(sqrt(list_dot_product(a, a)), 1e-12) * greatest(sqrt(list_dot_product(b, b)), 1e-12)), 6) AS cosine,
  round(list_sum(a) / greatest(sqrt(list_dot_product(a, a)), 1e-12), 6) AS unit_sum FROM pairs""")
def vector_algebra(t: Tables):
    e = t("embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    p = e.join(other, "vec_id")
    return rounded(
        p.select(
            "vec_id", arrays.dot("embedding", "b").alias("dot"), arrays.cosine("embedding", "b").alias("cosine"),
            arrays.total(arrays.unit("embedding")).alias("unit_sum"),
        )
    )


@query("""SELECT page_id, greatest(strlen(url), strlen(html))::BIGINT AS long_side, round(strlen(html) / 1024.0, 6) AS kb,
  strlen(url)::VARCHAR || 'x' || strlen(html)::VARCHAR AS size, round(strlen(url)::DOUBLE / strlen(html), 6) AS aspect FROM pages""")
def derived_sizes(t: Tables):
    w, h = F.octet_length("url").cast("long"), F.octet_length("html").cast("long")
    return t("pages").select(
        "page_id", F.greatest(w, h).alias("long_side"), F.round(h / 1024, 6).alias("kb"),
        F.concat(w.cast("string"), F.lit("x"), h.cast("string")).alias("size"), F.round(w / h, 6).alias("aspect"),
    )


def _upload(kind):
    """Binary content whose head depends on the record, then the record's text."""
    heads = F.array(*[F.unhex(F.lit(x)) for x in ("FFD8FFE0", "89504E470D0A1A0A", "524946460000000057454250", "47494638")])
    return F.concat(F.get(heads, kind), F.encode("text", "utf-8"))


@query("""SELECT CASE doc_id % 4 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'PNG' WHEN 2 THEN 'WEBP' END AS format, count(*) AS n FROM documents GROUP BY 1""")
def sniffed_formats(t: Tables):
    d = t("documents").select(hashing.sniff_format(_upload((F.col("doc_id") % 4).cast("int"))).alias("format"))
    return aggregates.value_counts(d, "format", "format")


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'empty_file' WHEN strlen(text) + [4, 8, 12, 4][doc_id % 4 + 1] > 20000 THEN 'file_too_large'
  WHEN doc_id % 4 = 3 THEN 'unsupported_media_type' WHEN n_chars > 9000 THEN 'image_too_large'
  WHEN contains(text, '%%%') THEN 'invalid_image' END AS reason FROM documents""")
def intake_reasons(t: Tables):
    content = F.when(F.col("doc_id") % 11 == 0, F.encode(F.lit(""), "utf-8")).otherwise(_upload((F.col("doc_id") % 4).cast("int")))
    d = t("documents").withColumn("content", content)
    return d.select(
        "doc_id",
        rules.intake_reason(
            F.octet_length("content"), hashing.sniff_format("content"), F.col("n_chars"), F.contains("text", F.lit("%%%")), 20000, 9000
        ).alias("reason"),
    )


@query("""SELECT doc_id, ('0x' || substr(sha256(text), 1, 12))::BIGINT AS seed,
  round(('0x' || substr(md5('7:' || doc_id), 1, 8))::BIGINT / 4294967296.0, 9) AS u FROM documents""")
def record_seeds(t: Tables):
    return t("documents").select(
        "doc_id", hashing.record_seed(F.sha2("text", 256)).alias("seed"), F.round(hashing.hash_uniform(7, "doc_id"), 9).alias("u")
    )


@query(r"""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '2024-' || c_name || '-cv' || (c_custkey % 5) || '-s42' ELSE ' ' || c_name || ' !' END AS name FROM customer)
SELECT c_custkey, regexp_replace(regexp_replace(name, '[^A-Za-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  CASE WHEN regexp_extract(name, '-cv(\d+)-', 1) <> '' THEN regexp_extract(name, '-cv(\d+)-', 1)::INT END AS fold FROM n""")
def run_names(t: Tables):
    name = F.when(
        F.col("c_custkey") % 2 == 0,
        F.concat(F.lit("2024-"), "c_name", F.lit("-cv"), (F.col("c_custkey") % 5).cast("string"), F.lit("-s42")),
    ).otherwise(F.concat(F.lit(" "), "c_name", F.lit(" !")))
    c = t("customer").withColumn("name", name)
    return c.select("c_custkey", text.run_slug("name").alias("slug"), text.run_fold("name").alias("fold"))


@query("""SELECT CASE r_name WHEN 'AFRICA' THEN 'south' WHEN 'EUROPE' THEN 'north' WHEN 'ASIA' THEN 'east' ELSE r_name END AS area, count(*) AS n
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def mapped_values(t: Tables):
    names = {"AFRICA": "south", "EUROPE": "north", "ASIA": "east"}
    mapping = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    area = F.coalesce(F.try_element_at(mapping, F.col("r_name")), F.col("r_name"))
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(area.alias("area")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_suppkey, avg(l_discount - 0.05) AS m, stddev_samp(l_discount) / sqrt(count(*)) AS se FROM lineitem GROUP BY 1),
b AS (SELECT l_suppkey, round(m - 1.96 * se, 9) AS low, round(m + 1.96 * se, 9) AS high FROM g)
SELECT l_suppkey, low, high, CASE WHEN low < 0 AND high > 0 THEN 'no clear difference' WHEN low > 0 THEN 'deployed better' ELSE 'deployed worse' END AS verdict FROM b""")
def interval_verdicts(t: Tables):
    g = t("lineitem").groupBy("l_suppkey").agg(
        F.avg(F.col("l_discount") - 0.05).alias("m"), (F.stddev_samp("l_discount") / F.sqrt(F.count("*"))).alias("se")
    )
    ci = g.select("l_suppkey", F.array(F.round(F.col("m") - 1.96 * F.col("se"), 9), F.round(F.col("m") + 1.96 * F.col("se"), 9)).alias("ci"))
    flat = ci.select("l_suppkey", F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"))
    return flat.withColumn("verdict", rules.difference_verdict(F.col("low"), F.col("high")))


# ---------------------------------------------------------------- filters and joins


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000 AND o_totalprice <= 400000")
def record_filters(t: Tables):
    o = t("orders")
    return o.where(
        (F.col("o_orderstatus") != "O")
        & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        & (F.col("o_totalprice") > 100000)
        & (F.col("o_totalprice") <= 400000)
    ).select("o_orderkey")


@query("""SELECT doc_id FROM documents WHERE NOT regexp_matches(source, '^src1') AND sha256(text) NOT IN
  (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""")
def exclusion_list(t: Tables):
    m = manifest(t)
    listed = m.join(t("labels").where("toxic = 1").select("doc_id"), "doc_id").select("sha256")
    return m.where(~F.col("source").rlike("^src1")).join(listed, "sha256", "left_anti").select("doc_id")


@query("""WITH s AS (SELECT bool_and(quality IS NOT NULL) AS whole FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, coalesce(quality <> 1, false) AS wrong, (SELECT whole FROM s) AS all_labelled FROM documents LEFT JOIN labels USING (doc_id)""")
def null_aware_rules(t: Tables):
    d = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    whole = d.agg(F.bool_and(F.col("quality").isNotNull()))
    wrong = F.coalesce(F.col("quality") != 1, F.lit(False))
    return d.select("doc_id", wrong.alias("wrong"), whole.scalar().alias("all_labelled"))


@query(f"""WITH {MANIFEST}, l AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1)
SELECT m.doc_id, m.bytes, l.quality FROM manifest m LEFT JOIN l USING (doc_id)""")
def quality_join(t: Tables):
    rows = manifest(t).select("doc_id", "bytes")
    return joins.attach(rows, t("labels").select("doc_id", "quality"), "doc_id")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_lookups(t: Tables):
    return joins.missing_keys(t("documents"), t("labels"), "doc_id")


@query("""SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN
  (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))""")
def new_content(t: Tables):
    m = manifest(t).select("doc_id", "sha256")
    store = m.join(t("labels").select("doc_id"), "doc_id").select("sha256")
    return joins.new_keys(m.select("sha256"), store, "sha256")


@query(f"""WITH {VECTORS}, a AS (SELECT d.doc_id, e.v FROM documents d LEFT JOIN emb e ON e.vec_id = d.doc_id * 2)
SELECT doc_id, (unnest(range(0, len(v))))::INT AS dim, round(unnest(v), 6) AS value, false AS missing FROM a WHERE v IS NOT NULL
UNION ALL SELECT doc_id, NULL, NULL, true FROM a WHERE v IS NULL""")
def aligned_vectors(t: Tables):
    d = t("documents").select("doc_id", (F.col("doc_id") * 2).alias("key"))
    out = joins.aligned_vectors(d, t("embeddings"), "key", "vec_id", "embedding")
    cells = out.select("doc_id", "missing", F.posexplode_outer("embedding").alias("dim", "value"))
    return cells.select("doc_id", "dim", F.round(F.col("value").cast("double"), 6).alias("value"), "missing")


@query("SELECT doc_id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.vec_id IS NULL")
def missing_vectors(t: Tables):
    d = t("documents").select("doc_id")
    return joins.zero_vectors(joins.aligned_vectors(d, t("embeddings"), "doc_id", "vec_id", "embedding"), "embedding").select("doc_id")


@query("SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1)")
def referenced_records(t: Tables):
    l = t("labels")
    return joins.referenced(t("documents"), [l.where("quality = 0"), l.where("toxic = 1")], "doc_id").select("doc_id", "source")


@query("""SELECT coalesce(a.o_orderkey, b.l_orderkey) AS key, coalesce(a.n, 0) AS left_rows, coalesce(b.n, 0) AS right_rows
  FROM (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) b ON a.o_orderkey = b.l_orderkey
  WHERE coalesce(a.n, 0) <> 1 OR coalesce(b.n, 0) <> 1""")
def unmatched_keys(t: Tables):
    a = t("orders").select(F.col("o_orderkey").alias("key"))
    return joins.unmatched(a, t("lineitem").select(F.col("l_orderkey").alias("key")), "key")


# ---------------------------------------------------------------- aggregates


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def value_counts(t: Tables):
    return aggregates.value_counts(t("orders"), "o_orderpriority")


@query("""SELECT position, lang, count(d.doc_id) AS n FROM (VALUES (0,'de'),(1,'en'),(2,'es'),(3,'fr'),(4,'it')) c(position, lang)
  LEFT JOIN documents d USING (lang) GROUP BY 1, 2""")
def zero_filled_counts(t: Tables):
    return aggregates.zero_filled_counts(t("documents"), "lang", [*LANGS, "it"])


@query("""SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr
  FROM documents GROUP BY 1 HAVING count(*) >= 45""")
def pattern_crosstab(t: Tables):
    return aggregates.crosstab(t("documents"), "source", "lang", LANGS, min_total=45)


@query("""SELECT coalesce(label, 'total') AS label, coalesce(split, 'total') AS split, count(*) AS n
  FROM (SELECT o_orderpriority AS label, o_orderstatus AS split FROM orders) GROUP BY CUBE (label, split)""")
def balance_table(t: Tables):
    return splits.balance(t("orders").select(F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("split")))


_LONG = """long AS (SELECT l_returnflag, 'quantity' AS measure, l_quantity::DOUBLE AS value FROM lineitem
  UNION ALL SELECT l_returnflag, 'price', l_extendedprice FROM lineitem UNION ALL SELECT l_returnflag, 'discount', l_discount FROM lineitem)"""


def _long(t: Tables):
    li = t("lineitem").select(
        "l_returnflag", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount")
    )
    return aggregates.long_measures(li, ["l_returnflag"], ["quantity", "price", "discount"])


@query(f"""WITH {_LONG} SELECT l_returnflag, measure, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.01), 4) AS p01, round(quantile_cont(value, 0.25), 4) AS p25,
  round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.99), 4) AS p99 FROM long GROUP BY 1, 2""")
def describe_measures(t: Tables):
    return rounded(aggregates.describe(_long(t), ["l_returnflag", "measure"]), 4)


@query(f"""WITH {_LONG} SELECT l_returnflag, measure, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min,
  round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, round(max(value), 4) AS max FROM long GROUP BY 1, 2""")
def describe_spread(t: Tables):
    return aggregates.describe_spread(_long(t), ["l_returnflag", "measure"])


@query(f"""WITH {_LONG}, q AS (SELECT l_returnflag, measure, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1, 2)
SELECT l_returnflag, measure, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(min(value), 4) AS low_whisker, round(max(value), 4) AS high_whisker
FROM long JOIN q USING (l_returnflag, measure) WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def boxplot_stats(t: Tables):
    return rounded(aggregates.boxplot(_long(t), ["l_returnflag", "measure"]), 4)


@query("SELECT round(max(n)::DOUBLE / greatest(min(n), 1), 6) AS imbalance_ratio FROM (SELECT count(*) AS n FROM documents GROUP BY lang)")
def imbalance_ratio(t: Tables):
    return rounded(aggregates.imbalance(t("documents"), "lang"))


@query("SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM documents GROUP BY sha256(text)) GROUP BY 1")
def copy_group_sizes(t: Tables):
    return aggregates.group_sizes(manifest(t).select("sha256"), "sha256")


@query("""WITH r AS (SELECT min(l_extendedprice)::DOUBLE AS low, max(l_extendedprice)::DOUBLE AS high FROM lineitem),
b AS (SELECT least(floor((l_extendedprice - low) / ((high - low) / 40)), 39)::INT AS bin FROM lineitem, r)
SELECT g.bin::INT AS bin, count(b.bin) AS n FROM range(40) g(bin) LEFT JOIN b ON b.bin = g.bin GROUP BY 1""")
def price_histogram(t: Tables):
    """Equal bins over the whole range of prices."""
    li = t("lineitem")
    low, high = li.agg(F.min("l_extendedprice").cast("double"), F.max("l_extendedprice").cast("double")).first()
    return aggregates.equal_width_histogram(li, "l_extendedprice", 40, low, high)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_percentiles(t: Tables):
    return rounded(aggregates.latency(t("events"), "value", ["event_type"]))


@query("""SELECT o_orderpriority, count(*) AS n, round(avg((o_orderstatus = 'O')::INT), 6) AS open_share,
  round(avg(CASE WHEN o_orderstatus = 'O' THEN (o_totalprice > 250000)::INT END), 6) AS large_when_open,
  round(avg(CASE WHEN o_totalprice < 0 THEN 1 END), 6) AS never FROM orders GROUP BY 1""")
def conditional_shares(t: Tables):
    is_open = F.col("o_orderstatus") == "O"
    return rounded(
        t("orders").groupBy("o_orderpriority").agg(
            F.count("*").alias("n"),
            F.avg(is_open.cast("double")).alias("open_share"),
            F.avg(F.when(is_open, (F.col("o_totalprice") > 250000).cast("double"))).alias("large_when_open"),
            F.avg(F.when(F.col("o_totalprice") < 0, 1.0)).alias("never"),
        )
    )


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def event_shares(t: Tables):
    return rounded(aggregates.shares(t("events"), "event_type"))


@query("SELECT o_orderstatus || ':' || coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, 'None') AS value, count(*) AS n FROM orders GROUP BY 1")
def composite_counts(t: Tables):
    reason = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return aggregates.value_counts(t("orders"), F.concat("o_orderstatus", F.lit(":"), F.coalesce(reason, F.lit("None"))))


@query("SELECT sha256(text) AS sha256, count(*) AS copies, count(DISTINCT source) > 1 AS differs FROM documents GROUP BY 1")
def label_disagreement(t: Tables):
    return aggregates.labels_differ(manifest(t, "source"), "sha256", "label")


@query("SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM embeddings GROUP BY 1")
def class_weights(t: Tables):
    return rounded(aggregates.class_weights(t("embeddings"), "label"))


def _sql_tree(lines: str, head: str) -> str:
    return f"""WITH {lines}, leaf AS (SELECT sha256(line || '#' || n) AS h FROM (SELECT line, count(*) AS n FROM lines GROUP BY 1)),
l6 AS (SELECT substr(h, 1, 6) AS p, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM leaf GROUP BY 1),
l4 AS (SELECT substr(p, 1, 4) AS p, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM l6 GROUP BY 1),
l2 AS (SELECT substr(p, 1, 2) AS p, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM l4 GROUP BY 1)
SELECT substr(sha256('{head}' || chr(10) || coalesce((SELECT string_agg(h, chr(10) ORDER BY h) FROM l2), '')), 1, 16) AS fingerprint"""


@query(_sql_tree("lines AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END || ':' || sha256(text) || ':' || lang AS line FROM documents)", "classes:de|en|es|fr"))
def collection_fingerprint(t: Tables):
    rows = manifest(t).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train"))
    return splits.fingerprint(rows, ["split", "sha256", "label"], LANGS)


# ---------------------------------------------------------------- windows, order, sets, samples


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r,
  count(*) OVER (PARTITION BY l_returnflag) AS n, l_returnflag FROM lineitem)
SELECT l_returnflag, greatest(1, ((r - 1) * 4 + n - 2) // (n - 1))::INT AS bin, count(*) AS n, sum(r)::BIGINT AS ranks FROM r GROUP BY 1, 2""")
def rank_bins(t: Tables):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = t("lineitem").select("l_returnflag", "l_extendedprice", *keys)
    placed = with_position(li, ["l_extendedprice", *keys], by=["l_returnflag"], total="total")
    return placed.groupBy("l_returnflag", quantile_bin(F.col("position"), F.col("total"), 4).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("position").alias("ranks")
    )


@query("""WITH w AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn, step, b IS NULL OR role <> b AS starts FROM w""")
def stage_starts(t: Tables):
    return histories.stage_starts(t("conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "step", "starts")


@query("""WITH e AS (SELECT user_id, event_id, greatest(value, coalesce(CASE WHEN event_type = 'error' THEN value * 1.5 END, value)) AS v FROM events)
SELECT user_id, count(*) AS steps, (array_agg(event_id ORDER BY v DESC, event_id))[1] AS best_step, round(max(v), 6) AS best_value FROM e GROUP BY 1""")
def best_steps(t: Tables):
    other = F.when(F.col("event_type") == "error", F.col("value") * 1.5)
    return rounded(histories.best_step(t("events"), "user_id", "event_id", F.greatest("value", F.coalesce(other, F.col("value")))))


@query("""WITH s AS (SELECT user_id, event_id, value, row_number() OVER w AS step, max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, CASE WHEN p IS NULL OR value > p THEN step END AS hit FROM s)
SELECT user_id, event_id, step, greatest(p, value) AS best, step - max(hit) OVER (PARTITION BY user_id ORDER BY event_id) AS patience FROM i""")
def running_best(t: Tables):
    return histories.running_best(t("events"), "user_id", "event_id", "value").select("user_id", "event_id", "step", "best", "patience")


@query("""WITH x AS (SELECT user_id, event_id::DOUBLE AS x, value AS y FROM events),
l AS (SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly FROM x WINDOW w AS (PARTITION BY user_id ORDER BY x))
SELECT user_id, round(sum((x - lx) * (y + ly) / 2) / max(x), 6) AS area FROM l GROUP BY 1""")
def curve_areas(t: Tables):
    e = t("events").select("user_id", F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))
    return rounded(histories.area_under(e, "user_id", "x", "y"))


@query("SELECT strlen(text)::VARCHAR AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def common_sizes(t: Tables):
    counts = aggregates.value_counts(t("documents"), F.octet_length("text").cast("string"))
    return counts.orderBy(F.col("n").desc(), "value").limit(10)


@query("""WITH r AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) AS lo,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS hi FROM lineitem)
SELECT l_returnflag, 'low' AS side, l_orderkey, l_linenumber, l_extendedprice FROM r WHERE lo <= 3 UNION ALL SELECT l_returnflag, 'high', l_orderkey, l_linenumber, l_extendedprice FROM r WHERE hi <= 3""")
def class_extremes(t: Tables):
    """Three lowest and highest per class; Spark keeps three rows per task before the shuffle."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    li = t("lineitem").select("l_returnflag", *keys, "l_extendedprice")

    def side(name, first):
        w = Window.partitionBy("l_returnflag").orderBy(first, *keys)
        top = li.withColumn("rn", F.row_number().over(w)).where("rn <= 3")
        return top.select("l_returnflag", F.lit(name).alias("side"), "l_orderkey", "l_linenumber", "l_extendedprice")

    return side("low", F.col("l_extendedprice").asc()).unionByName(side("high", F.col("l_extendedprice").desc()))


@query("""WITH s AS (SELECT unnest(['click','view','login','purchase']) AS stage) SELECT stage FROM s EXCEPT SELECT event_type FROM events""")
def unknown_stages(t: Tables):
    asked = t.spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in ("click", "view", "login", "purchase")])).alias("stage"))
    return asked.exceptAll(t("events").select(F.col("event_type").alias("stage")).distinct().intersect(asked))


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('3:' || doc_id), doc_id) AS r FROM documents WHERE n_chars >= 300) WHERE r <= 5""")
def source_samples(t: Tables):
    return splits.sample_per_group(t("documents").where("n_chars >= 300").select("source", "doc_id"), "doc_id", "source", 5, 3)


@query("SELECT doc_id FROM documents ORDER BY md5('11:' || doc_id), doc_id LIMIT 25")
def random_sample(t: Tables):
    return splits.sample_first(t("documents").select("doc_id"), "doc_id", 25, 11)


@query("""SELECT CASE WHEN substr(source, 4)::INT % 3 = 0 THEN 'test' ELSE 'cal' END AS split, source, count(*) AS n FROM documents GROUP BY 1, 2""")
def split_by_source(t: Tables):
    """Whole sources are dealt to cal or test, so test kinds are unseen in cal."""
    d = t("documents")
    number = F.substring("source", 4, 10).cast("int")
    return d.groupBy(F.when(number % 3 == 0, "test").otherwise("cal").alias("split"), "source").agg(F.count("*").alias("n"))


@query(f"WITH {_LONG} SELECT l_returnflag, measure, count(*) AS n, round(sum(value), 2) AS total FROM long GROUP BY 1, 2")
def melted_measures(t: Tables):
    return _long(t).groupBy("l_returnflag", "measure").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH m AS (SELECT o_orderstatus AS metric, o_orderpriority AS cls, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1, 2)
SELECT metric, cls, 'n' AS stat, n::DOUBLE AS value FROM m UNION ALL SELECT metric, cls, 'mean', mean FROM m""")
def nested_report_rows(t: Tables):
    """A nested report (metric → class → stat) exploded into rows."""
    per = t("orders").groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count("*").cast("double").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")
    )
    stats = F.create_map(F.lit("n"), "n", F.lit("mean"), "mean")
    nested = per.groupBy(F.col("o_orderstatus").alias("metric")).agg(
        F.map_from_entries(F.collect_list(F.struct("o_orderpriority", stats))).alias("report")  # one entry per class
    )
    by_class = nested.select("metric", F.explode("report").alias("cls", "stats"))
    return by_class.select("metric", "cls", F.explode("stats").alias("stat", "value"))
