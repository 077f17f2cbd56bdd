"""Quality classifier by co-training of two views.

Text view: which of the selected hashed words a text contains. Metadata view: language, source,
length and layout (lines, kinds of characters, repeated words) without any word's identity. For each
head (low quality; toxic) both views fit logistic models on labelled documents. Over `ROUNDS`, each
view hands its most confident predictions on unlabelled documents to the other view as labels. Each
view is then calibrated on labelled documents held out from training, where a logistic model also
learns how to combine both. All documents are scored whole; a document is kept if both combined
probabilities stay below one half.

Bounds: training takes `LABELLED` labelled and `POOL` unlabelled documents at most, chosen by a hash
of the id; what executors get is `BUCKETS` weights a head. Scoring maps documents, without shuffle.

Nulls: a null text is empty; null language or source is a value of its own. Rows with a null label
do not train; of repeated labels the worst counts. Without labels of both kinds a head is constant:
all documents pass it. Repeated and null ids are scored like others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.decontaminate import FOLD
from codeweft.llm.sequences import Words, pieces

LABELLED, POOL, ROUNDS = 8000, 4000, 4
BITS, SELECTED = 18, 384
BUCKETS = 1 << BITS
#: Classes of bytes for layout features: lower, upper, digit, blank, newline, punctuation, bar, non-ASCII.
_CLASS = np.array([7 if b >= 128 else 0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 4 if b == 10 else 3 if b in (9, 11, 12, 13, 32) else 6 if b == 124 else 5 for b in range(256)])
NAMED = 32
META = 8 + 6 + 2 * NAMED
HEADS = ("low", "toxic")


def text_features(texts: list[str | None], wanted: np.ndarray | None = None) -> list[np.ndarray]:
    """The distinct buckets of each text's words, of `wanted` (a mask over buckets) only if given."""
    out = []
    for _, part in pieces(texts):
        held = Words(FOLD, part)
        bucket = (held.rolling.every(1) >> np.uint64(64 - BITS)).astype(np.int64)
        owner = held.text_of.astype(np.int64)
        if wanted is not None:
            keep = wanted[bucket]
            bucket, owner = bucket[keep], owner[keep]
        both = np.unique(owner * BUCKETS + bucket)
        cuts = np.searchsorted(both, np.arange(1, len(part)) * BUCKETS)
        out += [x % BUCKETS for x in np.split(both, cuts)]
    return out


def meta_features(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    row = np.zeros(META, np.float32)
    n = max(1, len(raw))
    row[:8] = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / n * 4
    words = raw.split()
    many = max(1, len(words))
    lines = raw.count(b"\n") + 1
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    ends = sum(1 for w in words if w[-1:] in b".!?")
    row[8:14] = (np.log1p(len(raw)) / 5, np.log1p(many / lines) / 3, len(set(words)) / many, repeats / many * 4, ends / many * 4, len(raw) / many / 8)
    for at, value in ((14, lang), (14 + NAMED, source)):
        row[at + zlib.crc32(("" if value is None else "=" + value).encode()) % NAMED] = 1
    return row


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (the last is the intercept), by Newton steps with a ridge penalty."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, weight = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (y - p)) - ridge * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def select(rows: list[np.ndarray], y: np.ndarray, most: int = SELECTED) -> np.ndarray:
    """Buckets whose presence tells most about y (chi-square with a continuity correction)."""
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    in1, in0 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row, label in zip(rows, y, strict=True):
        (in1 if label else in0)[row] += 1
    n, has = n1 + n0, in1 + in0
    gap = np.maximum(0, np.abs(in1 * (n0 - in0) - in0 * (n1 - in1)) - n / 2)
    score = gap**2 * n / np.maximum(1, has * (n - has) * n1 * n0)
    score[has < 3] = 0
    best = np.argsort(-score, kind="stable")[:most]
    return np.sort(best[score[best] > 3.84])


def presence(rows: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, row in enumerate(rows):
        x[i, np.flatnonzero(np.isin(chosen, row, assume_unique=True))] = 1
    return x


def cotrain(words: list[np.ndarray], meta: np.ndarray, y: np.ndarray, pool_words: list[np.ndarray], pool_meta: np.ndarray) -> dict:
    """One head: the models of both views, each calibrated, and their combination."""
    held_out = np.arange(len(y)) % 5 == 4
    fit = ~held_out
    if y[fit].min(initial=1) == y[fit].max(initial=0) or y[held_out].min(initial=1) == y[held_out].max(initial=0):
        return {"constant": True}
    fit_words = [w for w, f in zip(words, fit, strict=True) if f]
    chosen = select(fit_words, y[fit])
    views = [presence(fit_words, chosen), meta[fit]]
    pools = [presence(pool_words, chosen), pool_meta]
    extra: list[dict[int, int]] = [{}, {}]
    for turn in range(ROUNDS + 1):
        models = []
        for v in (0, 1):
            rows = list(extra[v])
            x = np.vstack([views[v], pools[v][rows]]) if rows else views[v]
            labels = np.concatenate([y[fit], [extra[v][r] for r in rows]]) if rows else y[fit]
            weight = np.concatenate([np.ones(fit.sum()), np.full(len(rows), 0.5)])
            models.append(logistic(x, labels, weight, penalty=(2.0, 0.5)[v]))
        if turn == ROUNDS or not len(pool_words):
            break
        for v in (0, 1):
            p = sigmoid(margin(pools[v], models[v]))
            share = y[fit].mean()
            for label, sure, many in ((1, p, int(len(p) * share / 8)), (0, 1 - p, int(len(p) * (1 - share) / 8))):
                fresh = [i for i in np.argsort(-sure, kind="stable")[: many * (turn + 1)].tolist() if sure[i] > 0.95]
                extra[1 - v].update((i, label) for i in fresh if i not in extra[1 - v])
    margins = np.stack([margin(presence([w for w, h in zip(words, held_out, strict=True) if h], chosen), models[0]), margin(meta[held_out], models[1])], axis=1)
    calibrated = [logistic(margins[:, [v]], y[held_out], penalty=1e-2) for v in (0, 1)]
    both = np.stack([margin(margins[:, [v]], calibrated[v]) for v in (0, 1)], axis=1)
    final = logistic(both, y[held_out], penalty=1e-1)
    weights = np.zeros(BUCKETS, np.float32)
    weights[chosen] = models[0][:-1]
    return {"constant": False, "words": weights, "bias": models[0][-1], "meta": models[1], "calibrated": calibrated, "final": final, "chosen": chosen}


def probability(head: dict, buckets: list[np.ndarray], meta: np.ndarray) -> np.ndarray:
    if head["constant"]:
        return np.zeros(len(buckets))
    text = np.array([head["words"][b].sum(dtype=np.float64) for b in buckets]) + head["bias"]
    sides = [text, margin(meta.astype(np.float64), head["meta"])]
    both = np.stack([margin(s[:, None], c) for s, c in zip(sides, head["calibrated"], strict=True)], axis=1)
    return sigmoid(margin(both, head["final"]))


def _featured(docs: DataFrame, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs, sources = (batch.column(i).to_pylist() for i in range(3))
            words = [w.astype(np.int32) for w in text_features(texts)]
            meta = [meta_features(*x) for x in zip(texts, langs, sources, strict=True)]
            made = [pa.array(words, pa.list_(pa.int32())), pa.array(meta, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *made], names=[*columns, "words", "meta"])

    rows = docs.select("text", "lang", "source", *columns)
    schema = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in columns)
    return rows.mapInArrow(run, schema + "words array<int>, meta array<float>")


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id") -> list[dict]:
    """A model for each head, from bounded samples of labelled and unlabelled documents."""
    known = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col(key).cast("long").alias("id")).agg((1 - F.min("quality")).alias("low"), F.max("toxic").alias("toxic"))
    place = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20))

    def sampled(frame: DataFrame, most: int) -> DataFrame:
        total = frame.count()
        return frame.where(place < int(min(1.0, 0.95 * most / max(1, total)) * (1 << 20))).limit(most)

    body = docs.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    some = sampled(known, LABELLED)  # bounded: small enough for Spark to broadcast by its own size check
    rows, words, meta = _gathered(_featured(body.join(some, "id"), ["id", "low", "toxic"]))
    if not len(words):
        return [{"constant": True} for _ in HEADS]
    _, pool_words, pool_meta = _gathered(_featured(sampled(body.where(F.col("id").isNotNull()), POOL).join(known.select("id"), "id", "left_anti"), ["id"]))
    return [cotrain(words, meta, rows.column(h).to_numpy().astype(np.int64), pool_words, pool_meta) for h in HEADS]


def _gathered(featured: DataFrame) -> tuple[pa.Table, list[np.ndarray], np.ndarray]:
    """The rows of a bounded sample in a fixed order: as Arrow, their words, their metadata."""
    found = featured.toArrow().combine_chunks()
    if not found.num_rows:
        return found, [], np.zeros((0, META), np.float32)
    lists = found.column("words").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
    meta = pa.concat_arrays([c.flatten() for c in found.column("meta").chunks]).to_numpy().reshape(-1, META)
    ids = found.column("id").to_numpy()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], cuts[i + 1] - cuts[i], meta[i].tobytes()))
    return found.select([c for c in found.column_names if c not in ("words", "meta")]).take(order), [flat[cuts[i] : cuts[i + 1]] for i in order], meta[order]


def _judged(docs: DataFrame, models: list[dict], columns: list[str]) -> DataFrame:
    """`columns` as k0, k1, ... with p_low, p_toxic and keep."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    own = columns.index("text") if "text" in columns else -1  # a text that is kept is sent once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = sent.value
        wanted = np.zeros(BUCKETS, bool)
        for head in heads:
            if not head["constant"]:
                wanted[head["chosen"]] = True
        for batch in batches:
            kept = batch.columns[: len(columns)]
            texts = batch.column(own).to_pylist()
            langs, sources = (batch.column(len(columns) + i).to_pylist() for i in range(2))
            buckets = text_features(texts, wanted)
            meta = np.array([meta_features(*x) for x in zip(texts, langs, sources, strict=True)], np.float32).reshape(len(texts), META)
            found = [probability(head, buckets, meta) for head in heads]
            keep = (found[0] < 0.5) & (found[1] < 0.5)
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, found), pa.array(keep)], names=[*(f"k{i}" for i in range(len(columns))), "p_low", "p_toxic", "keep"])

    more = [F.col("lang").cast("string").alias("__lang"), F.col("source").cast("string").alias("__source")] + ([F.col("text").cast("string").alias("__text")] if own < 0 else [])
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)], *more)
    schema = "".join(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(columns)))
    return rows.mapInArrow(run, schema + "p_low double, p_toxic double, keep boolean")


def score(docs: DataFrame, models: list[dict], columns: list[str]) -> DataFrame:
    """`columns` of docs with p_low, p_toxic and keep (which replace columns so named): a row a document."""
    made = ["p_low", "p_toxic", "keep"]
    columns = [c for c in columns if c.lower() not in made]
    return _judged(docs, models, columns).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(columns)], *made)


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns."""
    passed = _judged(docs, train(docs, labels), docs.columns).where("keep")
    return passed.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
