"""Chat formatting: a record's schema fingerprint selects the mapping to canonical turns.

A record is a JSON object. Its fingerprint is a hash of the sorted set of its nested field paths
(`messages[].role`; names that hold `.`, `[`, `]` or a backslash are escaped), restricted to paths
that some mapping knows, so that fields no mapping knows change nothing. The fingerprint selects one
declarative mapping: the one with just these fields, or else the first listed one whose fields are all
there (so messages win over a `prompt` beside them). A record without one, or with a message that is
not an object, has null turns; no record raises an error.

The template writes `<|im_start|>role NEWLINE text<|im_end|>NEWLINE` for each turn. Inside texts and
roles a backslash is doubled and `<|` becomes `<\\|` (a newline in a role becomes `\\n`), so control
strings cannot occur there and reading back gives the very texts. The loss mask lists the ranges
(code points of the formatted string) of assistant texts.

Nulls: a null role, text or field value is empty; a null record, or one that is not an object, has
no mapping. Turns of a conversation are ordered by turn (null first), then role, then text; equal
rows all count. A conversation is one output value and is gathered in one task. Half pairs of
surrogates in JSON escapes become U+FFFD. An empty table gives an empty result; other columns of any
name are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, TARGET = "<|im_start|>", "<|im_end|>", "assistant"

# The layouts. "each": a list of messages and its role and text fields; "turns": role and field, in order.
MAPPINGS = [
    {"name": "messages", "each": ("messages", "role", "content")},
    {"name": "turn texts", "each": ("turns", "role", "text")},
    {"name": "shared conversations", "each": ("conversations", "from", "value"), "roles": {"human": "user", "gpt": "assistant"}},
    {"name": "prompt", "turns": [("user", "prompt"), ("assistant", "response")]},
    {"name": "completion", "turns": [("user", "prompt"), ("assistant", "completion")]},
    {"name": "question", "turns": [("user", "question"), ("assistant", "answer")]},
    {"name": "system question", "turns": [("system", "system"), ("user", "question"), ("assistant", "answer")]},
    {"name": "instruction", "turns": [("user", "instruction"), ("assistant", "output")]},
    {"name": "instruction with input", "turns": [("user", ("instruction", "input")), ("assistant", "output")]},
]


def fields(mapping: dict) -> set[str]:
    if "each" in mapping:
        name, role, text = mapping["each"]
        return {f"{name}[].{role}", f"{name}[].{text}"}
    return {f for _, x in mapping["turns"] for f in ([x] if isinstance(x, str) else x)}


def digest(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


KNOWN = set().union(*map(fields, MAPPINGS))
BY_FINGERPRINT = {digest(fields(m)): m for m in MAPPINGS}


def paths(value, at: str = "") -> Iterator[str]:
    """Nested field paths of a JSON value; lists contribute what their elements have."""
    if isinstance(value, dict):
        for k, v in value.items():
            name = re.sub(r"[\\.\[\]]", lambda m: "\\" + m[0], k)
            yield from paths(v, f"{at}.{name}" if at else name)
    elif isinstance(value, list):
        for v in value:
            yield from paths(v, at + "[]")
    else:
        yield at


def string(value) -> str:
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    try:
        text.encode()
    except UnicodeEncodeError:
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def selected(known: set[str]) -> dict | None:
    """The mapping of a record with these known paths."""
    return BY_FINGERPRINT.get(digest(known)) or next((m for m in MAPPINGS if fields(m) <= known), None)


def turns(record: str | None) -> tuple[str | None, list[tuple[str, str]] | None, dict | None]:
    """The fingerprint of a record, its canonical turns, or None, and their mapping."""
    try:
        value = json.loads(record) if record is not None else None
        known = {p for p in paths(value) if p in KNOWN} if isinstance(value, dict) else None
    except (ValueError, RecursionError):
        known = None
    if known is None:
        return None, None, None
    mark, mapping = digest(known), selected(known)
    if mapping is None:
        return mark, None, None
    if "each" in mapping:
        name, role, text = mapping["each"]
        if not all(isinstance(m, dict) for m in value[name]):
            return mark, None, None
        names = mapping.get("roles", {})
        said = [(string(m.get(role)), string(m.get(text))) for m in value[name]]
        return mark, [(names.get(r, r), t) for r, t in said], mapping
    take = lambda x: string(value[x]) if isinstance(x, str) else "\n\n".join(filter(None, (string(value[f]) for f in x)))
    return mark, [(r, take(x)) for r, x in mapping["turns"]], mapping


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def formatted(said: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The template over turns, and the ranges under the loss mask."""
    parts, mask, at = [], [], 0
    for role, text in said:
        head, body = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        if role == TARGET:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), mask


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    said = []
    for part in text.split(START)[1:]:
        role, _, body = part.partition("\n")
        said.append((unescape(role), unescape(body[: body.rindex(END)])))
    return said


def format_records(records: DataFrame, *, key: str = "key", record: str = "record") -> DataFrame:
    """(key, fingerprint, layout, formatted, mask): a row a record; the last three null without a mapping."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for one in batch.column(1).to_pylist():
                mark, said, mapping = turns(one)
                text, mask = formatted(said) if said is not None else (None, None)
                rows.append({"fingerprint": mark, "layout": mapping and mapping["name"], "formatted": text, "mask": mask and [{"start": s, "end": e} for s, e in mask] if mask is not None else None})
            made = pa.Table.from_pylist(rows, schema=OUT).to_batches()[0] if rows else pa.RecordBatch.from_pylist([], schema=OUT)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=["key", *OUT.names])

    rows = records.select(F.col(key).alias("key"), F.col(record).cast("string").alias("record"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, fingerprint string, layout string, formatted string, mask array<struct<start:long,end:long>>")
    return out.withColumnRenamed("key", key)


OUT = pa.schema([("fingerprint", pa.string()), ("layout", pa.string()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def conversation_records(rows: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, record): conversations as JSON, dealt over all layouts that can hold them by a hash of the key."""
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("content"))
    gathered = rows.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(said)).alias("said"))
    roles, at, dealt = F.col("said.role"), lambda i: F.col("said")[i]["content"], F.pmod(F.xxhash64("key"), F.lit(12))

    def flat(*names: tuple[str, Column]) -> Column:
        return F.to_json(F.struct(*[value.alias(name) for name, value in names]))

    def listed(name: str, role: str, text: str, roles: dict[str, str]) -> Column:
        renamed = lambda r: reduce(lambda out, x: F.when(r == x[1], F.lit(x[0])).otherwise(out), roles.items(), r)
        return F.to_json(F.struct(F.transform("said", lambda x: F.struct(renamed(x["role"]).alias(role), x["content"].alias(text))).alias(name)))

    pair = (F.size("said") == 2) & (roles[0] == "user") & (roles[1] == "assistant")
    three = (F.size("said") == 3) & (roles[0] == "system") & (roles[1] == "user") & (roles[2] == "assistant")
    head, tail = F.substring_index(at(0), "\n\n", 1), F.expr("substring(said[0].content, length(substring_index(said[0].content, '\\n\\n', 1)) + 3)")
    record = (
        F.when(pair & (dealt % 5 == 0), flat(("prompt", at(0)), ("response", at(1))))
        .when(pair & (dealt % 5 == 1), flat(("prompt", at(0)), ("completion", at(1))))
        .when(pair & (dealt % 5 == 2), flat(("question", at(0)), ("answer", at(1))))
        .when(pair & (dealt % 5 == 3) & (head != "") & (tail != ""), flat(("instruction", head), ("input", tail), ("output", at(1))))
        .when(pair & (dealt % 5 == 3), flat(("instruction", at(0)), ("output", at(1))))
        .when(three & (dealt % 2 == 0), flat(("system", at(0)), ("question", at(1)), ("answer", at(2))))
        .when((dealt % 3 == 0) & ~F.exists(roles, lambda r: r.isin("human", "gpt")), listed("conversations", "from", "value", {"human": "user", "gpt": "assistant"}))
        .when(dealt % 3 == 1, listed("turns", "role", "text", {}))
        .otherwise(listed("messages", "role", "content", {}))
    )
    return gathered.select(F.col("key").alias(key), record.alias("record"))


def digests(formatted_rows: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """What is read back from formatted strings and their masks, as digests."""
    schema = pa.schema([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                said = read_back(text or "")
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask or ())
                turn_bytes = "".join(f"{r}\n{t}\n" for r, t in said).encode("utf-8", "surrogatepass")
                made = (len(said), hashlib.sha256(turn_bytes).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text or ""))
                for column, value in zip(columns, made, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, schema, strict=True))], names=["key", *schema.names])

    rows = formatted_rows.select(F.col(key).alias("key"), "formatted", "mask")
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("key", key)
