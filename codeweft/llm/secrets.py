"""Secret scans over an incremental blob ledger. DataFrame operations only.

Every version of every file is addressed by the SHA-256 of its text. A ledger keeps, for each blob
and version of the rule set, the findings; a scan reads only blobs that the ledger lacks for the
current rule version, once each however many paths hold them, and joins findings back to all paths.
Copies of a blob are folded map-side before the one shuffle of texts, so a hot blob costs one text
a task. Positions come from the gaps between matches: no Python.

A finding is kind:start:end in code points, end exclusive. A rule's matches are the leftmost
non-overlapping ones; those that fail its length test are dropped after matching. Spans come from
prefix sums in blocks, so the work is linear in the text and in its matches (but for a share of
1/`BLOCK`), however long the text.

Nulls: a null text is the empty blob, without findings; null paths are kept; repeated rows stay
repeated. An empty table has no findings. Input columns of any name, `blob` or `findings` included,
are left as they are. Matching columns of the ledger by name, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import cut, whole_text


@dataclass(frozen=True)
class Rule:
    """`group` and `least`: the group of the pattern that must have so many characters."""

    kind: str
    pattern: str
    group: int
    least: int


# The kinds in their listed order, their patterns and least lengths.
RULES = (
    Rule("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    # The next two hold the least length already: a run is matched whole or not at all, so spans are the same.
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
VERSION = "base-1"
BLOCK = 256
FINDING = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """values[0], join(values[0], values[1]), ...: non-negative integers, in blocks of BLOCK."""

    def grown(own: Column) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(join(acc["at"], x))).alias("out"))
        return F.aggregate(own, empty, step, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        ends = grown(F.transform(blocks, lambda b: F.element_at(b, -1)))
        before = F.concat(F.array(F.lit(0)), ends)
        return F.flatten(F.transform(blocks, lambda b, i: let(F.element_at(before, i + 1), lambda start: F.transform(b, lambda x: join(start, x)))))

    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK))
    return let(F.transform(starts, lambda at: grown(F.slice(values, at, BLOCK))), lambda blocks: let(blocks, joined))


def matches(text: Column, rule: Rule, number: int) -> Column:
    """Findings of one rule: the i-th match ends after i+1 gaps and i+1 matches."""

    def spans(found: Column) -> Column:
        gaps = F.split(text, rule.pattern, -1)
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, hit: F.length(gap) + F.length(hit))
        every = F.zip_with(running(steps, lambda a, b: a + b), found, lambda end, hit: F.struct((end - F.length(hit)).alias("start"), F.lit(number).alias("kind"), end.alias("end"), hit.alias("hit")))
        size = lambda x: F.length(F.regexp_extract(x["hit"], rule.pattern, rule.group) if rule.group else x["hit"])
        return F.transform(F.filter(every, lambda x: size(x) >= rule.least), lambda x: F.struct(x["start"], x["kind"], x["end"]))

    return let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), spans)


def findings(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All findings of a text by start, then kind as listed."""
    none = F.array().cast(FINDING)
    each = [F.coalesce(F.when(text.rlike(rule.pattern), matches(text, rule, i)), none).cast(FINDING) for i, rule in enumerate(rules)]
    return F.array_sort(F.concat(*each))


def scan(
    versions: DataFrame, *, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = VERSION
) -> tuple[DataFrame, DataFrame]:
    """(path, blob, findings) for every row of `versions`, and the rows that the ledger lacks.

    The ledger has (blob binary, rule_version string, findings); append the second frame to it.
    """
    body = whole_text(text)
    address = F.unhex(F.sha2(body, 256))
    blobs = versions.select(address.alias("blob"), body.alias("body")).groupBy("blob").agg(F.first("body").alias("body"))
    known = None
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == version).select("blob", "findings")
        blobs = blobs.join(known.select("blob").distinct(), "blob", "left_anti")
    # Written before it is joined: each blob is scanned once, and the true size of the hits decides their join.
    fresh = cut(blobs.select("blob", F.lit(version).alias("rule_version"), findings(F.col("body"), rules).alias("findings")))
    every = fresh.select("blob", "findings")
    if known is not None:
        every = every.unionByName(known.dropDuplicates(["blob"]))
    hits = cut(every.where(F.size("findings") > 0))
    paths = versions.select(F.col(path).alias("path"), address.alias("address"))
    found = paths.join(hits.select(F.col("blob").alias("of"), "findings"), F.col("address") == F.col("of"), "left")
    return found.select(F.col("path").alias(path), F.col("address").alias("blob"), F.coalesce("findings", F.array().cast(FINDING)).alias("findings")), fresh


def scan_history(commits: list[DataFrame], *, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> tuple[DataFrame, DataFrame]:
    """`scan` of one commit after another with the ledger so far: findings of all paths, and the whole ledger."""
    every = ledger = None
    for commit in commits:
        found, fresh = scan(commit, path=path, text=text, ledger=ledger, rules=rules, version=version)
        every = found if every is None else every.unionByName(found)
        ledger = fresh if ledger is None else ledger.unionByName(fresh)
    return every, ledger


def written(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Findings as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with the union of its findings replaced by a mark; `found` is in order of start."""

    def marked(reach: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(reach, i - 1), F.lit(0))
            return F.when(x["start"] < before, F.lit("")).otherwise(F.concat(F.substring(text, before + 1, x["start"] - before), F.lit(mark)))

        rest = F.substring(text, F.element_at(reach, -1) + 1, F.length(text))
        return F.concat(F.array_join(F.transform(found, piece), ""), rest)

    return F.when(F.size(found) == 0, text).otherwise(let(running(F.transform(found, lambda x: x["end"]), F.greatest), marked))


def without_secrets(docs: DataFrame, *, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The documents with secrets replaced by a mark (and `chars`, if there is one, set anew where that changed a text)."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    body = names[docs.columns.index(text)]
    inner = docs.toDF(*names)
    _, fresh = scan(inner, path=body, text=body)
    hits = cut(fresh.where(F.size("findings") > 0).select("blob", "findings"))  # its true size decides the join
    found = inner.join(hits, F.unhex(F.sha2(whole_text(body), 256)) == F.col("blob"), "left")
    clean = F.col("findings").isNull()
    found = found.withColumn(body, F.when(clean, F.col(body)).otherwise(redacted(F.col(body), F.col("findings"))))
    if chars in docs.columns:
        count = names[docs.columns.index(chars)]
        found = found.withColumn(count, F.when(clean, F.col(count)).otherwise(F.length(body)).cast(inner.schema[count].dataType))
    return found.select(*names).toDF(*docs.columns)
