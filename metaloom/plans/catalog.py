"""All registered queries."""

from . import cleaning, edges, matching, profiling, records, shaping, sourcing, streams  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
