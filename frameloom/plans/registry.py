"""All catalogue queries and their SQL."""

from frameloom.plans import catalogue, convert, films, flows, media, progress, state, stores, text  # noqa: F401  (they register their queries)
from frameloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
