"""Ordered rule lists: every issue found, or the first reason that applies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str | Column, Column]


def _text(name: str | Column) -> Column:
    return F.lit(name) if isinstance(name, str) else name


def all_issues(rules: Sequence[Rule]) -> Column:
    """Names of the rules that hold, in rule order (a NULL condition does not hold)."""
    return F.array_compact(F.array(*[F.when(cond, _text(name)) for name, cond in rules]))


def first_reason(rules: Sequence[Rule], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise).cast("string")
    for name, cond in reversed(rules):
        out = F.when(cond, _text(name)).otherwise(out)
    return out


def scan_issues(
    size: Column,
    error: Column,
    image_format: Column,
    short_side: Column,
    label: Column,
    formats: Sequence[str],
    min_side: int,
) -> Column:
    """Issue list of one scanned file; an unreadable or empty file gets no format or size rule."""
    readable = (size > 0) & error.isNull()
    return all_issues(
        [
            ("empty_file", size == 0),
            (F.concat(F.lit("unreadable:"), error), (size > 0) & error.isNotNull()),
            (
                F.concat(F.lit("format:"), F.coalesce(image_format, F.lit("None"))),
                readable & ~F.coalesce(image_format.isin(*formats), F.lit(False)),
            ),
            ("too_small", readable & (short_side < min_side)),
            ("unknown_label", label.isNull()),
        ]
    )


def aspect_warnings(width: Column, height: Column, low: float, high: float) -> Column:
    return all_issues([("aspect", ~(width / height).between(low, high))])


def has_entry(entries: Column, name: str) -> Column:
    """True when a list of issues or warnings holds ``name``; a missing list holds none."""
    return F.coalesce(F.array_contains(entries, name), F.lit(False))


def intake_reason(
    size: Column, kind: Column, pixels: Column, undecodable: Column, max_bytes: int, max_pixels: int
) -> Column:
    """First intake rule that fails, NULL when the upload is fine."""
    return first_reason(
        [
            ("empty_file", size == 0),
            ("file_too_large", size > max_bytes),
            ("unsupported_media_type", kind.isNull()),
            ("image_too_large", pixels > max_pixels),
            ("invalid_image", undecodable),
        ]
    )


def difference_verdict(low: Column, high: Column) -> Column:
    """Reading of a confidence interval of (deployed - other)."""
    return (
        F.when((low < 0) & (high > 0), "no clear difference")
        .when(low > 0, "deployed better")
        .otherwise("deployed worse")
    )
