"""URL filters: a trie over reversed host labels, then path segments, is sent to every executor.

A rule is (verdict, host, path). Hosts are compared in ASCII lower case, a rule's as a URL's; the rule
is named as it was given. It fits its host and every subdomain when the path of the URL starts with the rule's path (a prefix of characters, so the rule's last segment may be partial).
Of all rules that fit, the longest wins, counted in characters of host and path; between equally
long ones the longer host wins, then `block`. Rules come as a driver-side list; each trie holds
`RULES_PER_TRIE` rules at most, which bounds a broadcast to some tens of MB. Longer lists become
several tries that are consulted one after another in the same task: no shuffle, so no skew. A list of
over `RULES` rules is refused, so all tries together have a bound too.

Nulls: a null URL, or one without `://`, has an empty host and path, and only the default verdict.
Added columns replace input columns of the same name; rows are neither added nor dropped. An empty
table stays empty; without rules every URL has the default verdict.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import LOWER, UPPER, ascii_lower

RULES_PER_TRIE, RULES = 100_000, 1_000_000
Rule = tuple[str, str, str]
FOLD = str.maketrans(UPPER, LOWER)


def build(rules: Sequence[Rule]) -> dict:
    """Node: labels and segments lead on; "?" holds last path segments, to be matched as prefixes."""
    root: dict = {"next": {}, "paths": None}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.translate(FOLD).split(".")) if host else ():
            node = node["next"].setdefault(label, {"next": {}, "paths": None})
        node["paths"] = node["paths"] or {"next": {}, "last": {}}
        *whole, last = path.split("/")
        at = node["paths"]
        for segment in whole:
            at = at["next"].setdefault(segment, {"next": {}, "last": {}})
        rank = (len(host) + len(path), len(host), verdict == "block")
        at["last"][last] = max(at["last"].get(last, ((-1,), "", "")), (rank, host + path, verdict))
    return root


def find(trie: dict, host: str, path: str):
    """The best (rank, rule, verdict) that fits, or None."""
    best, node, segments = None, trie, path.split("/")
    for label in [None, *reversed(host.split("."))]:
        if label is not None:
            node = node["next"].get(label)
            if node is None:
                break
        at = node["paths"]
        for segment in segments:
            if at is None:
                break
            for last, entry in at["last"].items() if len(at["last"]) <= len(segment) else ():
                if segment.startswith(last) and (best is None or entry > best):
                    best = entry
            if len(at["last"]) > len(segment):
                for end in range(len(segment) + 1):
                    entry = at["last"].get(segment[:end])
                    if entry is not None and (best is None or entry > best):
                        best = entry
            at = at["next"].get(segment)
    return best


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def judge(frame: DataFrame, rules: Sequence[Rule], *, url: str = "url", default: str = "allow") -> DataFrame:
    """`frame` with host, path, rule (null where none fits) and verdict."""
    if len(rules) > RULES:
        raise ValueError(f"at most {RULES} rules")
    context = frame.sparkSession.sparkContext
    tries = [context.broadcast(build(rules[i : i + RULES_PER_TRIE])) for i in range(0, len(rules), RULES_PER_TRIE)]

    @F.pandas_udf("rule string, verdict string")
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            found = []
            for host, path in zip(hosts, paths, strict=True):
                hits = [hit for trie in tries if (hit := find(trie.value, host, path)) is not None]
                found.append(max(hits)[1:] if hits else (None, default))
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    split = frame.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    judged = split.withColumn("__judged", decide("host", "path"))
    return judged.withColumns({"rule": F.col("__judged.rule"), "verdict": F.col("__judged.verdict")}).drop("__judged")
