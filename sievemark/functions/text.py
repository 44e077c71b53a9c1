"""Column functions on names, paths and labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name a source split when they start a folder name.
SOURCE_SPLITS = ("train", "test", "val", "valid", "validation")
# File extensions taken as images, and folders that hold no data.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "gif", "tif", "tiff", "webp")
SKIPPED_FOLDERS = (".ipynb_checkpoints", "__MACOSX", ".git")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def stem(path: Column | str) -> Column:
    """Last path part without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def label_slug(label: Column | str) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(_col(label)), "[^a-z0-9]+", "_"), "^_+|_+$", ""
    )


def name_pattern(path: Column | str) -> Column:
    """File stem without a copy suffix such as `` (2)``; each run of digits becomes ``#``."""
    return F.regexp_replace(F.regexp_replace(stem(path), r"\s*\(\d+\)$", ""), r"\d+", "#")


def source_split(path: Column | str) -> Column:
    """The first parent folder whose first word names a split, in lower case; else ''."""
    parts = F.split(F.lower(_col(path)), "/")
    parents = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    named = F.filter(
        parents, lambda p: F.element_at(F.split(F.ltrim(p), r"\s+"), 1).isin(*SOURCE_SPLITS)
    )
    return F.coalesce(F.get(named, F.lit(0)), F.lit(""))


def matches_any(path: Column | str, patterns: Sequence[str]) -> Column:
    """True when any pattern is found in the last path part."""
    name = basename(path)
    return reduce(lambda a, b: a | b, [name.rlike(p) for p in patterns], F.lit(False))


def is_image_path(path: Column | str) -> Column:
    suffix = F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))
    skipped = F.arrays_overlap(
        F.split(_col(path), "/"), F.array(*[F.lit(s) for s in SKIPPED_FOLDERS])
    )
    return suffix.isin(*IMAGE_EXTENSIONS) & ~skipped


def content_path(label: Column | str, digest: Column | str, suffix: str = ".jpg") -> Column:
    """``slug/first-20-hex.jpg`` for a known label, NULL otherwise."""
    named = F.concat(label_slug(label), F.lit("/"), F.substring(_col(digest), 1, 20), F.lit(suffix))
    return F.when(_col(label).isNotNull(), named)


def run_slug(name: Column | str) -> Column:
    cleaned = F.regexp_replace(
        F.regexp_replace(_col(name), r"[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", ""
    )
    return F.when(cleaned == "", F.lit("run")).otherwise(cleaned)


def run_fold(name: Column | str) -> Column:
    """The number K of a run named ``…-cvK-…``; NULL for other runs."""
    return F.nullif(F.regexp_extract(_col(name), r"-cv(\d+)-", 1), F.lit("")).cast("int")


def canonical_label(raw: Column | str, classes: Sequence[str], aliases: dict[str, str]) -> Column:
    """Alias first, then class name, both compared without case or outer blanks; else NULL."""
    key = F.lower(F.trim(_col(raw)))
    known = {c.strip().lower(): c for c in classes}
    known.update({a.strip().lower(): target for a, target in aliases.items()})
    pairs = [F.lit(v) for item in known.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), key)


def class_id(label: Column | str, classes: Sequence[str]) -> Column:
    """Position in the ordered class list, NULL when the label is not in it."""
    found = F.array_position(F.array(*[F.lit(c) for c in classes]), _col(label))
    return F.when(found > 0, (found - 1).cast("int"))
