"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from codeweft.llm import oracles, queries

QUERIES = {name: getattr(queries, name) for name in dir(queries) if name.startswith("op") and name[2].isdigit()}
ORACLES = oracles.SQL
