"""All queries of the library outside `llm`, with their SQL twins."""

from __future__ import annotations

from codeweft.operators import heavy, intervals, nesting, paths, postings, references, rendering, scalars, search, trees, typesearch, versions  # noqa: F401
from codeweft.plans.register import ORACLES, QUERIES
from codeweft.sources import extract, ingest  # noqa: F401
from codeweft.streaming import hits  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
