"""A corpus pipeline: quality rules, near copies, personal data, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next stage's input. All but the last return the columns of ``documents``.

1. Lines that fail the quality rules go, and documents that fail them go.
2. Of each group of near copies the document with the smallest id stays: SimHash fingerprints under covering masks,
   widened by MinHash keys, 5-word shingles with a Jaccard similarity of at least 0.8 verified.
3. Personal data gets keyed surrogates.
4. Sources are mixed to their targets; a document that is taken twice becomes two rows.
5. Documents are packed into sequences of 512 to 4,096 words.

Cases: null, empty and wordless texts fail the quality rules, so an input of nothing else gives no rows, as
does an empty table. Rows that repeat an id and a text become one at stage 2; rows that repeat an id with
different texts stay apart until a near copy takes one of them. Other columns than those of ``documents`` are dropped at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import mixing, near, packing, quality, surrogates
from sievemark.session import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _like_documents(df: DataFrame, text: str) -> DataFrame:
    """The columns of ``documents`` with a new text and its length in characters."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in COLUMNS])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like_documents(quality.clean_lines(docs.select(*COLUMNS)).where("kept"), "clean_text")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.first_of_groups(docs.select(*COLUMNS))


def surrogates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like_documents(surrogates.pseudonymised(docs.select(*COLUMNS)), "text")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_copies", near_copies_stage),
    ("personal_data", surrogates_stage),
    ("source_mixture", mixing_stage),
    ("packing", packing_stage),
]

# SimHash of XXH64 hashes, keyed surrogates and best fit have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
