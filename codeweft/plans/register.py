"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers (spark, root) -> DataFrame under `name`; `sql` may use the views of `views.py`."""

    def put(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = f"{VIEWS}\n{sql}"
        return function

    return put


VIEWS = r"""WITH RECURSIVE refs AS (
  SELECT CAST(l_orderkey % 200 % 2 AS INT) AS realm, l_suppkey AS source_artifact_id, l_orderkey % 200 AS source_file_id, l_partkey AS target,
    ascii(l_returnflag) - 64 + CASE WHEN l_linestatus = 'O' THEN 20 ELSE 0 END AS type, CAST(l_quantity AS INT) AS line, l_linenumber AS ref_id,
    l_discount = 0 AS duplicate FROM lineitem),
bindings AS (
  SELECT p_partkey AS binding_id, CAST(p_partkey % 200 % 2 AS INT) AS realm, p_partkey % 200 % 10 AS artifact_id,
    CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_partkey % 200 END AS source_file_id, p_size > 25 AS include_in_type_search,
    'com.' || lower(p_type) || '.' || upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || upper(split_part(p_name, ' ', 2)[1])
      || substr(split_part(p_name, ' ', 2), 2) || CAST(p_partkey % 40 AS VARCHAR) AS binding, p_size AS modifiers,
    CASE WHEN p_partkey < 10 THEN NULL ELSE p_partkey // 10 END AS parent FROM part),
artifacts AS (
  SELECT s_suppkey AS artifact_id, lower(r_name) || '/' || lower(n_name) AS coordinate,
    CAST(s_suppkey % 12 AS VARCHAR) || '.' || CAST(s_suppkey % 7 AS VARCHAR) || '.' || CAST(s_suppkey AS VARCHAR) || CASE WHEN s_suppkey % 5 = 0 THEN '-rc' ELSE '' END AS version
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
files AS (
  SELECT CAST(page_id % 2 AS INT) AS realm, page_id % 10 AS artifact_id, page_id AS source_file_id, regexp_replace(url, '^[a-z]+://', '') AS path,
    (page_id * 7919) % 1000003 AS hash FROM pages)"""
