"""Queries on duplicates, near pairs, groups, splits and folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemark.functions.hashing import text_signatures
from sievemark.operators import aggregates, components, groups, pairs, splits, vector_pairs
from sievemark.plans.datasets import MANIFEST, VECTORS, manifest, signed_documents, sql_signature
from sievemark.plans.registry import Tables, query, rounded
from sievemark.session import freeze

DISTANCE = 3
COSINE = 0.4
PATTERNS = ["^0000000[0-9]7", "9\\.txt$"]


def _statuses(t: Tables, label: str):
    m = manifest(t, label).drop("text")
    return groups.mark_exact(m.withColumn("status", F.lit("ok")), "path", "sha256", "label")


def _sql_statuses(label: str) -> str:
    return f"""{MANIFEST}, marked AS (
  SELECT doc_id, path, {label} AS label, sha256, min(path) OVER w AS keeper, count(*) OVER w AS copies,
         min({label}) OVER w <> max({label}) OVER w AS conflict FROM manifest WINDOW w AS (PARTITION BY sha256)),
statuses AS (SELECT doc_id, path, label, sha256,
  CASE WHEN copies > 1 AND conflict THEN 'conflict' WHEN path <> keeper THEN 'duplicate' ELSE 'ok' END AS status,
  CASE WHEN copies > 1 AND NOT conflict AND path <> keeper THEN keeper END AS duplicate_of FROM marked)"""


@query(f"""WITH {_sql_statuses('lang')} SELECT status, count(*) AS n, count(duplicate_of) AS pointing FROM statuses GROUP BY 1""")
def duplicate_status(t: Tables):
    return _statuses(t, "lang").groupBy("status").agg(F.count("*").alias("n"), F.count("duplicate_of").alias("pointing"))


@query(f"WITH {_sql_statuses('lang')} SELECT path, status, duplicate_of FROM statuses")
def exact_duplicates(t: Tables):
    return _statuses(t, "lang").select("path", "status", "duplicate_of")


@query(f"WITH {_sql_statuses('source')} SELECT path, status FROM statuses WHERE status = 'conflict'")
def exact_conflicts(t: Tables):
    return _statuses(t, "source").where("status = 'conflict'").select("path", "status")


_PRECEDENCE = f"""{MANIFEST}, based AS (SELECT path, source AS label, sha256, CASE WHEN n_chars < 200 THEN 'invalid'
   WHEN regexp_matches(regexp_replace(path, '^.*/', ''), '{PATTERNS[0]}') OR regexp_matches(regexp_replace(path, '^.*/', ''), '{PATTERNS[1]}') THEN 'excluded_pattern'
   WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'excluded' ELSE 'ok' END AS status FROM manifest),
facts AS (SELECT sha256, count(*) AS copies, min(path) AS keeper, min(label) <> max(label) AS conflict FROM based WHERE status = 'ok' GROUP BY 1 HAVING count(*) > 1),
final AS (SELECT path, CASE WHEN status = 'ok' AND conflict THEN 'conflict' WHEN status = 'ok' AND path <> keeper THEN 'duplicate' ELSE status END AS status,
  CASE WHEN status = 'ok' AND NOT conflict AND path <> keeper THEN keeper END AS duplicate_of FROM based LEFT JOIN facts USING (sha256))"""


def _precedence(t: Tables):
    m = manifest(t, "source").drop("text")
    toxic = t("labels").where("toxic = 1").select("doc_id").distinct().withColumn("listed", F.lit(True))
    m = m.join(toxic, "doc_id", "left")
    m = m.withColumn("status", groups.base_status(F.col("n_chars") >= 200, "path", PATTERNS, F.col("listed"))).drop("listed")
    return groups.mark_exact(m, "path", "sha256", "label")


@query(f"WITH {_PRECEDENCE} SELECT path, status, duplicate_of FROM final")
def status_precedence(t: Tables):
    return _precedence(t).select("path", "status", "duplicate_of")


@query(f"WITH {_PRECEDENCE} SELECT path, status FROM final WHERE status <> 'ok'")
def removed_records(t: Tables):
    return _precedence(t).where("status <> 'ok'").select("path", "status")


_STEPS = ("invalid", "excluded_pattern", "excluded", "duplicate", "conflict", "ok")


@query(f"""WITH {_PRECEDENCE}, steps AS (SELECT unnest({list(_STEPS)}) AS status, generate_subscripts({list(_STEPS)}, 1) - 1 AS step)
SELECT step::INT AS step, status, count(f.path) AS n FROM steps LEFT JOIN final f USING (status) GROUP BY 1, 2""")
def cleaning_funnel(t: Tables):
    counts = aggregates.zero_filled_counts(_precedence(t), "status", _STEPS)
    return counts.withColumnRenamed("position", "step")


@query(f"WITH {sql_signature('documents', 'doc_id', 'sig')} SELECT doc_id, signature FROM sig")
def word_signatures(t: Tables):
    return text_signatures(t("documents"), "doc_id", "text")


_MEMBERS = f"""{sql_signature('documents', 'doc_id', 'sig')},
members AS (SELECT signature, min(doc_id) AS first, count(*) AS n FROM sig GROUP BY 1)"""


@query(f"""WITH {_MEMBERS}
SELECT least(a.first, b.first) AS a, greatest(a.first, b.first) AS b, bit_count(xor(a.signature, b.signature))::INT AS distance, a.n * b.n AS pairs
FROM members a JOIN members b ON a.signature < b.signature AND bit_count(xor(a.signature, b.signature)) <= {DISTANCE}
UNION ALL SELECT first, first, 0, n * (n - 1) // 2 FROM members WHERE n > 1""")
def near_document_links(t: Tables):
    sig = freeze(text_signatures(t("documents"), "doc_id", "text"))
    return pairs.record_links(sig, "doc_id", "signature", DISTANCE)


def _turns(s: Column) -> list[Column]:
    """Eight variants of a signature: its rotations by whole bytes."""
    return [s] + [F.shiftleft(s, 8 * k).bitwiseOR(F.shiftrightunsigned(s, 64 - 8 * k)) for k in range(1, 8)]


def _sql_rotated(column: str, bits: int) -> str:
    u = f"(CASE WHEN {column} < 0 THEN {column}::HUGEINT + 18446744073709551616 ELSE {column}::HUGEINT END)"
    if bits == 0:
        return column
    turned = f"(({u} * {1 << bits}) % 18446744073709551616 + {u} // {1 << (64 - bits)})"
    return f"(CASE WHEN {turned} >= 9223372036854775808 THEN {turned} - 18446744073709551616 ELSE {turned} END)::BIGINT"


@query(f"""WITH {_MEMBERS}, v AS (SELECT first AS id, signature, unnest([{', '.join(_sql_rotated('signature', 8 * k) for k in range(8))}]) AS variant FROM members)
SELECT DISTINCT least(m.first, v.id) AS a, greatest(m.first, v.id) AS b FROM members m JOIN v ON m.first <> v.id AND bit_count(xor(m.signature, v.variant)) <= {DISTANCE}""")
def near_variant_pairs(t: Tables):
    """Near pairs over eight variants of each signature (here: its bit rotations by whole bytes)."""
    sig = text_signatures(t("documents"), "doc_id", "text")
    first = sig.groupBy("signature").agg(F.min("doc_id").alias("id"))
    return pairs.variant_pairs(first.select("id", F.array(*_turns(F.col("signature"))).alias("variants")), "id", "variants", DISTANCE)


_SIMILAR = f"""{VECTORS}, one AS (SELECT v, min(vec_id) AS id, count(*) AS copies FROM emb GROUP BY v),
alike AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS cosine, a.copies * b.copies AS pairs
  FROM one a JOIN one b ON a.id < b.id AND list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= {COSINE}
  UNION ALL SELECT id, id, 1.0, copies * (copies - 1) // 2 FROM one WHERE copies > 1)"""


@query(f"WITH {_SIMILAR} SELECT a, b, round(cosine, 6) AS cosine, pairs FROM alike")
def similar_vectors(t: Tables):
    return rounded(vector_pairs.similar_links(t("embeddings"), "vec_id", "embedding", COSINE))


@query(f"""WITH {_SIMILAR}, p AS (SELECT x.label = y.label AS same, s.pairs FROM alike s JOIN emb x ON x.vec_id = s.a JOIN emb y ON y.vec_id = s.b)
SELECT same, count(*) AS links, sum(pairs)::BIGINT AS pairs FROM p GROUP BY 1""")
def similar_by_class(t: Tables):
    """Similar links split into kept (same class) and ignored (other class)."""
    found = vector_pairs.similar_links(t("embeddings"), "vec_id", "embedding", COSINE)
    labels = t("embeddings").select("vec_id", "label")
    both = found.join(labels.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), "a").join(
        labels.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b"
    )
    return both.groupBy((F.col("la") == F.col("lb")).alias("same")).agg(
        F.count("*").alias("links"), F.sum("pairs").alias("pairs")
    )


@query(f"""WITH RECURSIVE {VECTORS}, links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM emb a JOIN emb b ON a.vec_id <> b.vec_id AND a.label = b.label
  AND list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= {COSINE}),
reach(node, root) AS (SELECT DISTINCT a, a FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node)
SELECT node, min(root) AS component FROM reach GROUP BY 1""")
def similar_components(t: Tables):
    links = vector_pairs.component_links(t("embeddings"), "vec_id", "embedding", COSINE, same="label")
    return components.connected_components(links, in_task=groups.SMALL_GRAPH)


@query(f"""WITH {sql_signature('documents', 'doc_id', 'sig')}, {sql_signature('benchmark', 'item_id', 'bank')}
SELECT doc_id, min(bit_count(xor(d.signature, b.signature)))::INT AS distance, min(bit_count(xor(d.signature, b.signature))) <= 8 AS seen
FROM sig d CROSS JOIN bank b GROUP BY doc_id""")
def nearest_benchmark(t: Tables):
    docs = text_signatures(t("documents"), "doc_id", "text")
    bank = text_signatures(t("benchmark"), "item_id", "text")
    return pairs.nearest_distance(docs, "doc_id", "signature", bank, "signature", 8)


def _sql_groups(label: str) -> str:
    return f"""{MANIFEST}, {sql_signature('documents', 'doc_id', 'sig')},
facts AS (SELECT sha256, count(*) AS copies, min(path) AS keeper, min({label}) <> max({label}) AS conflict FROM manifest GROUP BY 1),
marked AS (SELECT m.doc_id, path, {label} AS label, signature,
  CASE WHEN copies > 1 AND conflict THEN 'conflict' WHEN path <> keeper THEN 'duplicate' ELSE 'ok' END AS status,
  CASE WHEN copies > 1 AND NOT conflict AND path <> keeper THEN keeper END AS duplicate_of
  FROM manifest m JOIN facts USING (sha256) JOIN sig USING (doc_id)),
ok AS (SELECT * FROM marked WHERE status = 'ok'),
near AS (SELECT a.path AS a, b.path AS b, a.label = b.label AS same FROM ok a JOIN ok b ON a.path <> b.path AND bit_count(xor(a.signature, b.signature)) <= {DISTANCE}),
bad AS (SELECT DISTINCT a AS path FROM near WHERE NOT same),
reach(node, root) AS (SELECT path, path FROM ok UNION SELECT n.b, r.root FROM reach r JOIN near n ON n.a = r.node AND n.same),
comp AS (SELECT node AS path, min(root) AS root FROM reach GROUP BY 1),
firsts AS (SELECT root, row_number() OVER (ORDER BY min(path)) - 1 AS group_id FROM comp WHERE path NOT IN (SELECT path FROM bad) GROUP BY root),
grouped AS (SELECT m.path, m.label, CASE WHEN b.path IS NOT NULL THEN 'conflict' ELSE m.status END AS status, m.duplicate_of,
  CASE WHEN b.path IS NULL THEN f.group_id END AS group_id
  FROM marked m LEFT JOIN bad b USING (path) LEFT JOIN comp c USING (path) LEFT JOIN firsts f USING (root))"""


def _sql_variant_groups(label: str) -> str:
    turned = ", ".join(_sql_rotated("signature", 8 * k) for k in range(8))
    plain = f"near AS (SELECT a.path AS a, b.path AS b, a.label = b.label AS same FROM ok a JOIN ok b ON a.path <> b.path AND bit_count(xor(a.signature, b.signature)) <= {DISTANCE})"
    over = f"""one AS (SELECT a.path AS a, b.path AS b, a.label = b.label AS same FROM ok a JOIN (SELECT path, label, unnest([{turned}]) AS v FROM ok) b ON a.path <> b.path AND bit_count(xor(a.signature, b.v)) <= {DISTANCE}),
near AS (SELECT a, b, same FROM one UNION SELECT b, a, same FROM one)"""
    whole = _sql_groups(label)
    assert plain in whole
    return whole.replace(plain, over)


@query(f"WITH RECURSIVE {_sql_variant_groups('lang')} SELECT path, status, duplicate_of, group_id FROM grouped")
def variant_groups(t: Tables):
    """Grouping over eight variants of each signature, which every row has."""
    m = signed_documents(t, "lang").withColumn("status", F.lit("ok"))
    m = m.withColumn("variants", F.array(*_turns(F.col("signature"))))
    return groups.assign_groups(m, max_distance=DISTANCE, variant_list="variants")[0].select("path", "status", "duplicate_of", "group_id")


def _signed(t: Tables, label: str):
    return signed_documents(t, label).withColumn("status", F.lit("ok"))


def _grouped(t: Tables, label: str = "lang"):
    return groups.assign_groups(_signed(t, label), max_distance=DISTANCE)


@query(f"WITH RECURSIVE {_sql_groups('lang')} SELECT path, status, duplicate_of, group_id FROM grouped")
def leakage_groups(t: Tables):
    return _grouped(t)[0].select("path", "status", "duplicate_of", "group_id")


@query(f"WITH RECURSIVE {_sql_groups('source')} SELECT path, status, group_id FROM grouped WHERE status <> 'duplicate'")
def near_conflict_groups(t: Tables):
    """Grouping with source as the class: near copies under two sources are conflicts."""
    return _grouped(t, "source")[0].where("status <> 'duplicate'").select("path", "status", "group_id")


@query(f"""WITH RECURSIVE {_sql_groups('lang')} SELECT (SELECT count(*) FROM near) // 2 AS near_pairs, (SELECT count(*) FROM near WHERE NOT same) // 2 AS cross_label_pairs""")
def near_pair_counts(t: Tables):
    return groups.near_counts(_signed(t, "lang"), max_distance=DISTANCE)


@query(f"""WITH RECURSIVE {_sql_groups('lang')}, sizes AS (SELECT group_id, count(*) AS size FROM grouped WHERE group_id IS NOT NULL GROUP BY 1)
SELECT 'status' AS section, status AS key, count(*) AS n FROM grouped GROUP BY 2
UNION ALL SELECT 'groups_of_size', size::VARCHAR, count(*) FROM sizes GROUP BY size
UNION ALL SELECT 'total', 'groups', count(*) FROM sizes UNION ALL SELECT 'total', 'largest_group', coalesce(max(size), 0) FROM sizes""")
def group_summary(t: Tables):
    return groups.group_summary(freeze(_grouped(t)[0].select("path", "status", "group_id")))


@query(f"""WITH {MANIFEST}, s AS (SELECT sha256, count(*) AS n, md5('5:' || sha256) AS h FROM manifest GROUP BY 1 HAVING count(*) > 1),
big AS (SELECT sha256, n, h FROM s ORDER BY n DESC, sha256 LIMIT 3),
few AS (SELECT sha256, n, h FROM s WHERE sha256 NOT IN (SELECT sha256 FROM big) ORDER BY h, sha256 LIMIT 4),
chosen AS (SELECT sha256 FROM big UNION ALL SELECT sha256 FROM few),
m AS (SELECT sha256, path, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS r FROM manifest WHERE sha256 IN (SELECT sha256 FROM chosen))
SELECT sha256, path FROM m WHERE r <= 5""")
def group_gallery(t: Tables):
    """The largest copy groups and a few others, first five members each."""
    m = manifest(t).select("sha256", "path")
    sizes = freeze(m.groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1"))
    big = sizes.orderBy(F.col("n").desc(), "sha256").limit(3)
    few = splits.sample_first(sizes.join(big.select("sha256"), "sha256", "left_anti"), "sha256", 4, 5)
    chosen = big.select("sha256").unionByName(few.select("sha256"))
    w = Window.partitionBy("sha256").orderBy("path")
    members = m.join(F.broadcast(chosen), "sha256", "left_semi")  # seven keys
    return members.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("sha256", "path")


@query(f"""WITH {sql_signature('documents', 'doc_id', 'sig')}, {sql_signature('benchmark', 'item_id', 'bank')},
asked AS (SELECT doc_id % 50 AS key, CASE WHEN doc_id % 7 <> 0 THEN signature END AS signature FROM sig)
SELECT key, CASE WHEN a.signature IS NOT NULL THEN min(bit_count(xor(a.signature, b.signature)))::INT END AS distance,
  CASE WHEN a.signature IS NOT NULL THEN min(bit_count(xor(a.signature, b.signature))) <= 8 END AS seen, count(DISTINCT a.r) AS n
FROM (SELECT *, row_number() OVER () AS r FROM asked) a CROSS JOIN (SELECT signature FROM bank WHERE item_id % 7 <> 0) b GROUP BY a.r, key, a.signature""")
def nearest_with_gaps(t: Tables):
    """Queries and bank with missing signatures and repeated keys: NULL in, NULL out, a row for each row."""
    docs = text_signatures(t("documents"), "doc_id", "text").select(
        F.pmod("doc_id", F.lit(50)).alias("key"), F.when(F.pmod("doc_id", F.lit(7)) != 0, F.col("signature")).alias("signature")
    )
    bank = text_signatures(t("benchmark"), "item_id", "text").select(F.when(F.pmod("item_id", F.lit(7)) != 0, F.col("signature")).alias("signature"))
    return pairs.nearest_distance(docs, "key", "signature", bank, "signature", 8).withColumn("n", F.lit(1).cast("long"))


def _sql_variants(where: str) -> str:
    turned = ", ".join(_sql_rotated("signature", 8 * k) for k in range(8))
    return f"""WITH {sql_signature('documents', 'doc_id', 'sig')}, {sql_signature('benchmark', 'item_id', 'bank')},
variants AS (SELECT DISTINCT unnest([{turned}]) AS variant FROM bank WHERE {where}),
asked AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN signature END AS signature FROM sig),
near AS (SELECT a.signature, min(bit_count(xor(a.signature, v.variant)))::INT AS distance FROM (SELECT DISTINCT signature FROM asked WHERE signature IS NOT NULL) a CROSS JOIN variants v GROUP BY 1)
SELECT doc_id, distance, distance <= 8 AS seen FROM asked LEFT JOIN near USING (signature)"""


def _variants(t: Tables, bank_rows: int):
    docs = text_signatures(t("documents"), "doc_id", "text").select("doc_id", F.when(F.pmod("doc_id", F.lit(7)) != 0, F.col("signature")).alias("signature"))
    bank = text_signatures(t("benchmark"), "item_id", "text").select("item_id", F.array(*_turns(F.col("signature"))).alias("variants"))
    bank = bank.select(F.when(F.pmod("item_id", F.lit(7)) != 0, F.col("variants")).alias("variants"))
    return pairs.nearest_variants(docs, "doc_id", "signature", bank, "variants", 8, bank_rows)


@query(_sql_variants("item_id % 7 <> 0"))
def nearest_variants(t: Tables):
    """The nearest of a bank over eight variants of each row, with missing signatures on both sides."""
    return _variants(t, 100_000)


@query(_sql_variants("item_id % 7 <> 0"))
def nearest_variants_indexed(t: Tables):
    """The same by the index over parts, as for a bank that no task could hold."""
    return _variants(t, 0)


# ---------------------------------------------------------------- splits


def _sql_deal(rows: str, group: str, label: str, folds: int, seed: int, name: str) -> str:
    return f"""{name}_cells AS (SELECT {group} AS g, {label} AS l, count(*) AS n FROM {rows} GROUP BY 1, 2),
{name}_main AS (SELECT g, sum(n) AS size, (array_agg(l ORDER BY n DESC, l))[1] AS main FROM {name}_cells GROUP BY 1),
{name}_rank AS (SELECT g, row_number() OVER (ORDER BY main NULLS FIRST, size DESC, md5('{seed}:' || g), g) - 1 AS turn FROM {name}_main),
{name} AS (SELECT g, ((turn * {splits.stride(folds)} + {folds - 1}) % {folds})::INT AS fold FROM {name}_rank)"""


_SPLIT = f"""{MANIFEST}, {_sql_deal('manifest', 'sha256', 'lang', 20, 42, 'dealt')},
split AS (SELECT m.*, CASE WHEN fold < 3 THEN 'test' WHEN fold < 6 THEN 'val' ELSE 'train' END AS split FROM manifest m JOIN dealt ON g = sha256)"""


def _split(t: Tables):
    return splits.assign_splits(manifest(t).drop("text"), "sha256", "label")


@query(f"WITH {_SPLIT} SELECT path, split FROM split")
def group_split(t: Tables):
    return _split(t).select("path", "split")


@query(f"WITH {_SPLIT} SELECT coalesce(lang, 'total') AS label, coalesce(split, 'total') AS split, count(*) AS n FROM split GROUP BY CUBE (lang, split)")
def split_balance(t: Tables):
    return splits.balance(_split(t))


@query(f"""WITH {_SPLIT}, keys AS (SELECT 'sha256' AS key, sha256 AS value, split FROM split UNION ALL SELECT 'source', source, split FROM split)
SELECT key, value, min(split) AS first_split, max(split) AS last_split FROM keys GROUP BY 1, 2 HAVING min(split) <> max(split)""")
def split_leaks(t: Tables):
    """Keys in more than one split: none for the grouping key, many for one that was not grouped."""
    return splits.leaks(_split(t), ["sha256", "source"])


@query(f"""WITH orderlines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem), {_sql_deal('orderlines', 'l_orderkey', 'l_returnflag', 5, 7, 'dealt')}
SELECT fold, l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM orderlines JOIN dealt ON g = l_orderkey GROUP BY 1, 2""")
def order_folds(t: Tables):
    li = t("lineitem").select("l_orderkey", "l_returnflag")
    dealt = splits.group_folds(li, "l_orderkey", "l_returnflag", 5, 7)
    per = li.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("c"))
    return per.join(dealt, "l_orderkey").groupBy("fold", "l_returnflag").agg(
        F.sum("c").alias("n"), F.count("*").alias("orders")
    )


@query(f"""WITH {_SPLIT}, open AS (SELECT * FROM split WHERE split <> 'test'), {_sql_deal('open', 'sha256', 'lang', 5, 42, 'cv')}
SELECT f.fold::INT AS fold, CASE WHEN cv.fold = f.fold THEN 'val' ELSE 'train' END AS role, lang AS label, count(*) AS n
FROM open JOIN cv ON g = sha256 CROSS JOIN range(5) f(fold) GROUP BY 1, 2, 3""")
def cv_fold_counts(t: Tables):
    folds = splits.cv_folds(_split(t), "sha256", "label")
    return folds.groupBy("fold", "role", "label").agg(F.count("*").alias("n"))


_PREPARED = f"""{_sql_groups('lang')}, clean AS (SELECT * FROM grouped WHERE status = 'ok'), {_sql_deal('clean', 'group_id', 'label', 20, 42, 'dealt')},
prepared AS (SELECT path, label, group_id, CASE WHEN fold < 3 THEN 'test' WHEN fold < 6 THEN 'val' ELSE 'train' END AS split FROM clean JOIN dealt ON g = group_id)"""


def _prepared(t: Tables):
    """Statuses, near groups and a split of the rows that are left, by group; stops at a leak."""
    clean = _grouped(t)[0].where("status = 'ok'")
    out = freeze(splits.assign_splits(clean, "group_id", "label").select("path", "sha256", "label", "group_id", "split"))
    splits.require_no_leaks(out, ["sha256", "group_id"])
    return out


@query(f"WITH RECURSIVE {_PREPARED} SELECT path, group_id, split FROM prepared")
def prepared_splits(t: Tables):
    return _prepared(t).select("path", "group_id", "split")


@query(f"""WITH RECURSIVE {_PREPARED} SELECT coalesce(label, 'total') AS label, coalesce(split, 'total') AS split, count(*) AS n, count(DISTINCT group_id) AS groups
FROM prepared GROUP BY CUBE (label, split)""")
def prepared_summary(t: Tables):
    """Rows and groups per label and split, with margins; a group may hold several labels only in a margin."""
    out = _prepared(t)
    cells = out.groupBy("label", "split", "group_id").agg(F.count("*").alias("n"))
    margins = cells.cube("label", "split").agg(F.sum("n").alias("n"), F.countDistinct("group_id").alias("groups"))
    return margins.select(F.coalesce("label", F.lit("total")).alias("label"), F.coalesce("split", F.lit("total")).alias("split"), "n", "groups")


@query(f"""WITH {_SPLIT}, per AS (SELECT lang, count(*) AS n, count(*) FILTER (split = 'test') AS test, count(*) FILTER (split = 'val') AS val FROM split GROUP BY 1)
SELECT lang AS label, n, round(test / n, 6) AS test_share, round(val / n, 6) AS val_share FROM per""")
def split_shares(t: Tables):
    """How near each class comes to 15 % test and 15 % validation rows."""
    share = lambda s: F.avg((F.col("split") == s).cast("double"))
    per = _split(t).groupBy("label").agg(F.count("*").alias("n"), share("test").alias("test_share"), share("val").alias("val_share"))
    return rounded(per)
