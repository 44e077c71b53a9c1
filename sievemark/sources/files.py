"""Scanning a folder of images into a manifest, and reading archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions import rules, text
from sievemark.functions.hashing import sniff_format
from sievemark.sources.images import image_measures


_STORE = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*"  # scheme and authority of a file's URI


def _plain(path: Column) -> Column:
    """The path of a file within its store, whichever of Spark's sources names it."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), _STORE, "/")


def _root(spark: SparkSession, folder: str) -> str:
    """The folder's path within its store, for relative folders and any Hadoop file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toUri().getPath().rstrip("/") + "/"


def _raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(_file, bytes, content)`` of every image file, empty ones included.

    Spark's file sources leave out empty files when they plan a scan, but the source's own index
    still names them: names without a scanned row are the empty files.
    """
    source = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    scanned = source.select(_plain(F.col("path")).alias("_file"), F.col("length").alias("bytes"), "content")
    named = spark.createDataFrame([(f,) for f in source.inputFiles()], "path string").select(
        _plain(F.col("path")).alias("_file")
    )
    empty = named.join(scanned.select("_file"), "_file", "left_anti").select(
        "_file", F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("binary").alias("content")
    )
    return scanned.unionByName(empty).where(text.is_image_path("_file"))


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, bytes)`` of image files below ``folder``; file contents are not read."""
    root = _root(spark, folder)
    rel = F.substring("_file", len(root) + 1, 1 << 20)
    return _raw_files(spark, folder).select(rel.alias("path"), "bytes").orderBy("path")


def scan_images(
    spark: SparkSession,
    folder: str,
    classes: Sequence[str],
    aliases: dict[str, str] | None = None,
    formats: Sequence[str] = ("JPEG", "PNG"),
    min_side: int = 64,
    aspect: tuple[float, float] = (0.4, 2.5),
) -> DataFrame:
    """The manifest: one row per image file with hash, size, measures, hash variants and issues.

    The content hash is computed on the raw bytes, pixels come from Spark's image source; the two
    scans are joined on the path, and only the image branch runs Python.
    """
    root = _root(spark, folder)
    raw = _raw_files(spark, folder).select(
        "_file",
        "bytes",
        F.when(F.col("bytes") > 0, F.sha2("content", 256)).alias("sha256"),
        sniff_format("content").alias("format"),
    )
    decoded = (
        spark.read.format("image").option("recursiveFileLookup", True).load(folder)
        .where(F.col("image.height") > 0)
        .select(
            _plain(F.col("image.origin")).alias("_file"),
            F.col("image.width").alias("width"),
            F.col("image.height").alias("height"),
            F.element_at(
                F.create_map(F.lit(1), F.lit("L"), F.lit(3), F.lit("RGB"), F.lit(4), F.lit("RGBA")), F.col("image.nChannels")
            ).alias("mode"),
            image_measures(F.col("image")).alias("m"),
        )
        .select("_file", "width", "height", "mode", "m.*")
    )
    joined = raw.join(decoded, "_file", "left")
    path = F.substring("_file", len(root) + 1, 1 << 20)
    raw_label = F.element_at(F.split("_file", "/"), -2)
    named = joined.withColumns(
        {
            "path": path,
            "raw_label": raw_label,
            "label": text.canonical_label(raw_label, classes, aliases or {}),
        }
    )
    error = F.when((F.col("bytes") > 0) & F.col("width").isNull(), F.lit("DecodeError"))
    issues = rules.scan_issues(
        F.col("bytes"), error, F.col("format"), F.least("width", "height"), F.col("label"), formats, min_side
    )
    warnings = F.when(F.col("width").isNotNull(), rules.aspect_warnings(F.col("width"), F.col("height"), *aspect))
    readable = F.col("width").isNotNull()
    return named.select(
        "path",
        text.source_split("path").alias("source_split"),
        "raw_label",
        "label",
        text.class_id("label", classes).alias("class_id"),
        "bytes",
        "sha256",
        F.when(readable, F.col("format")).alias("format"),
        "mode",
        "width",
        "height",
        F.get("phash_d4", F.lit(0)).alias("phash"),
        "phash_d4",
        F.when(readable, text.content_path("label", "sha256")).alias("cache_path"),
        text.name_pattern("path").alias("name_pattern"),
        "brightness",
        "contrast",
        "sharpness",
        "green_frac",
        "dark_frac",
        "bright_frac",
        (F.size(issues) == 0).alias("is_valid"),
        issues.alias("issues"),
        F.coalesce(warnings, F.array().cast("array<string>")).alias("warnings"),
    )


@F.udtf(returnType="name string, content binary")
class ArchiveMembers:
    """Files inside one zip archive."""

    def eval(self, content: bytes) -> Iterator[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for info in archive.infolist():
                if not info.is_dir():
                    yield info.filename, archive.read(info)


def read_archives(spark: SparkSession, pattern: str) -> DataFrame:
    """``(archive, name, content)`` for every file in the zip archives; archives spread over tasks."""
    archives = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("archive"), F.col("content").alias("zipped"))
    members = archives.lateralJoin(ArchiveMembers(F.col("zipped").outer()))
    return members.select("archive", "name", "content")
