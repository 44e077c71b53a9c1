"""Inputs derived from the shared tables, in Spark and as SQL for the independent check."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.arrays import linear_scores, softmax
from sievemark.functions.hashing import text_signatures
from sievemark.operators.metrics import predicted
from sievemark.operators.ood import means_matrix
from sievemark.plans.registry import Tables
from sievemark.session import freeze

CLASSES = tuple(range(8))  # labels 0-7 are known; 8 is near-foreign, 9 far-foreign
SCALE = 60.0
LANGS = ("de", "en", "es", "fr")


# ---- documents as a file manifest

def manifest(t: Tables, label: str = "lang") -> DataFrame:
    """documents with a path, its content hash and a class column."""
    d = t("documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt")))
    return d.select(
        "doc_id", path.alias("path"), F.sha2("text", 256).alias("sha256"), F.col(label).alias("label"),
        "n_chars", F.octet_length("text").cast("long").alias("bytes"), "lang", "source", "text",
    )


MANIFEST = """manifest AS (
  SELECT doc_id, source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 9, '0') || '.txt' AS path,
         sha256(text) AS sha256, lang, source, n_chars, strlen(text)::BIGINT AS bytes, text
  FROM documents)"""


def signed_documents(t: Tables, label: str) -> DataFrame:
    """The manifest with a word signature per distinct content."""
    m = manifest(t, label).drop("text")
    return m.join(text_signatures(t("documents"), "doc_id", "text"), "doc_id")


def sql_signature(table: str, key: str, name: str) -> str:
    """CTEs giving ``name(key, signature)``: the same word signature bit by bit."""
    bits = " + ".join(
        f"(CASE WHEN 2 * sum(((h >> {i}) & 1)::INT) > count(*) THEN {1 << i}::HUGEINT ELSE 0 END)" for i in range(64)
    )
    return f"""{name}_words AS (
  SELECT {key}, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {table}),
{name}_raw AS (
  SELECT {key}, {bits} AS u
  FROM (SELECT {key}, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h FROM {name}_words WHERE w <> '')
  GROUP BY {key}),
{name} AS (
  SELECT t.{key}, coalesce(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END, 0)::BIGINT AS signature
  FROM {table} t LEFT JOIN {name}_raw USING ({key}))"""


# ---- embeddings as a scored classifier

def split_column(key: str = "vec_id") -> Column:
    m = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(10))
    return F.when(m < 6, "train").when(m < 8, "val").otherwise("test")


def vectors(t: Tables) -> DataFrame:
    return t("embeddings").select("vec_id", "label", "embedding", split_column().alias("split"))


VECTORS = """emb AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v,
         CASE WHEN ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT % 10 < 6 THEN 'train'
              WHEN ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT % 10 < 8 THEN 'val' ELSE 'test' END AS split
  FROM embeddings)"""


def centroids(t: Tables, train_only: bool) -> np.ndarray:
    rows = vectors(t).where(F.col("label").isin(*CLASSES))
    if train_only:
        rows = rows.where("split = 'train'")
    return means_matrix(rows, "embedding", "label", CLASSES)


def scored(
    t: Tables, train_only: bool = False, scale: float = SCALE, known: bool = True, distance: bool = False
) -> DataFrame:
    """(id, split, y, logits, probs, pred, conf, correct) by nearest class centroid.

    ``distance`` gives model B: negative squared distance to the centroid instead of the dot product.
    """
    c = centroids(t, train_only)
    rows = vectors(t)
    if known:
        rows = rows.where(F.col("label").isin(*CLASSES))
    weights, bias = scale * c, np.zeros(len(c))
    if distance:  # unit vectors: -|v - c|² = 2 v·c - |c|² - 1
        weights, bias = 2 * scale * c, -scale * ((c**2).sum(axis=1) + 1.0)
    base = rows.select(
        F.col("vec_id").alias("id"), "split", F.col("label").alias("y"), "embedding",
        linear_scores("embedding", weights, bias).alias("logits"),
    )
    return predicted(base.withColumn("probs", softmax("logits")))


def sql_scored(train_only: bool = False, scale: float = SCALE, known: bool = True, distance: bool = False, name: str = "scored") -> str:
    fit = "AND split = 'train'" if train_only else ""
    keep = "WHERE e.label < 8" if known else ""
    score = "list_dot_product(e.v, c.c)"
    if distance:
        score = "(-list_sum(list_transform(list_zip(e.v, c.c), lambda z: (z[1] - z[2]) ** 2)))"
    return f"""{name}_cent AS (
  SELECT label AS k, list(m ORDER BY d) AS c
  FROM (SELECT label, d, avg(x) AS m
        FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM emb WHERE label < 8 {fit})
        GROUP BY label, d) GROUP BY label),
{name}_logits AS (
  SELECT e.vec_id AS id, any_value(e.split) AS split, any_value(e.label) AS y, any_value(e.v) AS v,
         list({scale} * {score} ORDER BY c.k) AS logits
  FROM emb e CROSS JOIN {name}_cent c {keep} GROUP BY e.vec_id),
{name}_pow AS (
  SELECT *, list_transform(logits, lambda z: exp(z - list_max(logits))) AS pw FROM {name}_logits),
{name}_probs AS (
  SELECT id, split, y, v, logits, list_transform(pw, lambda p: p / list_sum(pw)) AS probs FROM {name}_pow),
{name} AS (
  SELECT *, (list_position(probs, list_max(probs)) - 1)::INT AS pred, list_max(probs) AS conf,
         (list_position(probs, list_max(probs)) - 1) = y AS correct
  FROM {name}_probs)"""


SCORED = VECTORS + ",\n" + sql_scored()


def sql_refined(
    rounds: int = 3, points: int = 64, source: str = "scored WHERE split = 'val'", y: str = "y", logits: str = "logits"
) -> str:
    """The refined grid over log T as CTEs up to ``fitted``: each round keeps the neighbours of its best point."""
    ctes = [f"val AS (SELECT {y} AS y, {logits} AS logits FROM {source}), span0 AS (SELECT ln(0.05) AS low, ln(20.0) AS high)"]
    for r in range(rounds):
        ctes.append(f"""grid{r} AS (SELECT i, low + (high - low) / {points - 1} * i AS g FROM span{r}, range({points}) s(i)),
nll{r} AS (SELECT i, g, avg(-ln(exp((logits[y + 1] - list_max(logits)) / exp(g)) / list_sum(list_transform(logits, lambda z: exp((z - list_max(logits)) / exp(g)))) + 1e-12)) AS nll FROM val, grid{r} GROUP BY 1, 2),
best{r} AS (SELECT i, g, nll FROM nll{r} ORDER BY nll, i LIMIT 1),
span{r + 1} AS (SELECT min(n.g) AS low, max(n.g) AS high FROM nll{r} n, best{r} b WHERE n.i BETWEEN b.i - 1 AND b.i + 1)""")
    return ",\n".join(ctes) + f",\nfitted AS (SELECT nll, exp(g) AS temperature FROM best{rounds - 1})"


def frozen_scored(t: Tables, **kwargs) -> DataFrame:
    return freeze(scored(t, **kwargs))
