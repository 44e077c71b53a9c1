"""Tables, reports and vector stores on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns kept from a training history line.
HISTORY = T.StructType(
    [
        T.StructField("run", T.LongType()),
        T.StructField("stage", T.StringType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("lr", T.DoubleType()),
        T.StructField("train_loss", T.DoubleType()),
        T.StructField("train_acc", T.DoubleType()),
        T.StructField("val_loss", T.DoubleType()),
        T.StructField("val_macro_f1", T.DoubleType()),
        T.StructField("val_accuracy", T.DoubleType()),
        T.StructField("ema_val_macro_f1", T.DoubleType()),
        T.StructField("selected", T.StringType()),
        T.StructField("seconds", T.DoubleType()),
    ]
)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All or the chosen columns; only those are read from the files."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """History lines through the column whitelist: blank lines are skipped, absent keys are NULL."""
    return spark.read.schema(HISTORY).json(path)


def _only_absent(error: AnalysisException) -> None:
    """A missing path stands for no data; a refused or broken read stays an error."""
    if error.getCondition() != "PATH_NOT_FOUND":
        raise error


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(key, emb); an empty store when nothing was written yet."""
    schema = "key string, emb array<float>"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        _only_absent(error)
        return spark.createDataFrame([], schema)


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Add the keys the store lacks, one row per key, sorted by key within each file.

    Only new rows are written; a failed write leaves the store as it was (the commit is atomic).
    """
    spark = vectors.sparkSession
    fresh = vectors.join(read_vectors(spark, path).select("key"), "key", "left_anti").dropDuplicates(["key"])
    fresh.sortWithinPartitions("key").write.mode("append").parquet(path)


def nonempty_cells(df: DataFrame) -> DataFrame:
    """Rows of the first column named image or img whose nested bytes are not empty."""
    name = next(c for c in df.columns if c.lower() in ("image", "img"))
    content = F.col(f"{name}.bytes")
    return df.where(F.octet_length(content) > 0).withColumn("content", content).drop(name)


def read_documents(spark: SparkSession, folder: str, kinds: dict[str, T.StructType], name: str = "model") -> dict[str, DataFrame]:
    """Optional result documents ``<folder>/<kind>/<model>.json``: one scan per kind.

    A kind without any document gives an empty frame, so the later left joins leave NULLs.
    """
    out = {}
    for kind, schema in kinds.items():
        try:
            df = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/{kind}/*.json")
        except AnalysisException as error:
            _only_absent(error)
            df = spark.createDataFrame([], schema)
            out[kind] = df.withColumn(name, F.lit(None).cast("string"))
            continue
        out[kind] = df.withColumn(name, F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1))
    return out


# Where result documents lie below a folder: kind, and a pattern whose group is the bundle (none: of all bundles).
LAYOUT = {
    "eval": r"/eval/([^/]+)/metrics\.json$",
    "robustness": r"/robustness/([^/]+)/robustness\.json$",
    "ood": r"/ood/([^/]+)/ood\.json$",
    "external": r"/ood/([^/]+)/external\.json$",
    "benchmark": r"/benchmark/([^/]+)\.json$",
    "paired": r"/metrics/()paired\.json$",
}


def read_variants(spark: SparkSession, folder: str, layout: dict[str, str] | None = None) -> DataFrame:
    """``(bundle, kind, doc)`` of every result document below ``folder``, in one scan; a broken document is a NULL VARIANT."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    path = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    found = [
        F.when(F.regexp_like(path, F.lit(p)), F.struct(F.regexp_extract(path, p, 1).alias("bundle"), F.lit(kind).alias("kind")))
        for kind, p in (layout or LAYOUT).items()
    ]
    return files.select(F.coalesce(*found).alias("at"), F.try_parse_json("value").alias("doc")).where("at is not null").select("at.*", "doc")
