"""All registered queries."""

from sievemark.plans import (  # noqa: F401  (importing registers)
    collection,
    comparisons,
    duplicates,
    evaluation,
    gating,
    streams,
)
from sievemark.plans.registry import ORACLES, QUERIES  # noqa: F401
