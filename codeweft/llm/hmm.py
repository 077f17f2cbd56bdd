"""Hidden Markov language model: exact sequence likelihoods from counts gathered over the whole corpus.

Events. A text is its words (A-Z lower-cased, between ASCII white space), then one end. Words that are
more than one in `HEADS` of all training tokens, and the end, are events of their own: fewer than `HEADS`,
so their table has a bound at any size of the corpus. All other words fall into `TAILS` classes by their
last three characters. Within a class a known word has its count, and all unknown words together the
class's number of words seen once (one at least), over the sum of both. So every state gives the known
words, and one unknown event a class, probabilities that add up to one.

Training is Baum-Welch. Texts are written once as blocks of some `BLOCK` tokens: a list of distinct words
and the texts as places in it. A round maps blocks to expected counts of starts, transitions and
emissions (one row an event and task), sums them over partitions and refits; emissions are smoothed towards the counts
of all tokens. Blocks are dealt into `LOTS` lots. Each of the first rounds refits to the next lots, so that all of
them together run over every training text (more than once where blocks are few); `rounds` rounds over all
training texts at once follow. Forward sums are scaled at every step. A group of texts holds some `GATHER` tokens; a longer text is run in windows of so many, backward from
stored forward sums, so what is held does not grow with its length.

Scoring. Counts of words go back to the blocks that hold them, one row a distinct word and block, and
there meet the texts in a cogroup by block. A scaled forward recursion over the whole text gives its
likelihood under the classes; the words within their classes add the rest.

Nulls: a null text is empty, and still has its end. A row whose `trains` is null trains. Repeated ids are
rows of their own; the ids of a result may be null. A very long text is a block of its own, held as 4
bytes a token. Without training rows every event of a state has the same probability. An empty table gives
an empty result. Other columns of any name are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import LOWER, UPPER, cut

HEADS, TAILS, BLOCK, LOTS, GATHER = 60_000, 1024, 1 << 21, 10, 1 << 18
#: A block is a row group of its own: neither the writer nor the reader holds more than one, however many a task has.
ONE_BLOCK = {"compression": "zstd", "parquet.block.row.count.limit": "1"}
#: No word holds a space.
END = " "
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
BLOCKS = "words array<string>, seen array<int>, ids array<long>, held array<boolean>, sizes array<int>, codes binary"
SCORES = "id long, held boolean, n_tokens long, n_known long, base_score double, score double"


def planes(codes: np.ndarray) -> bytes:
    """Numbers byte by byte: first all lowest bytes, then all next ones; the high ones compress to nothing."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def encoded(docs: DataFrame, key: str, text: str, trains: Column) -> DataFrame:
    """Blocks of texts: words from frequent to rare with their training occurrences, and texts as places in that list."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("body"), (~F.coalesce(trains, F.lit(True))).alias("held"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)  # a small table is one split, and would be one block

    def block(texts: list, ids: list, held: list, index: dict) -> pa.RecordBatch:
        codes, sizes = np.concatenate(texts), np.array([len(t) for t in texts], np.int32)
        every = np.bincount(codes, minlength=len(index))
        order = np.argsort(-every, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes = place[codes]
        seen = np.bincount(codes[np.repeat(~np.array(held), sizes)], minlength=len(order)).astype(np.int32)
        words = pa.array(list(index), pa.binary()).take(pa.array(order)).cast(pa.string())
        one = lambda x, kind=None: pa.array([x], pa.list_(kind)) if kind else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([one(words), one(pa.array(seen)), one(ids, pa.int64()), one(held, pa.bool_()), one(pa.array(sizes)), pa.array([planes(codes)], pa.binary())], names=["words", "seen", "ids", "held", "sizes", "codes"])

    def encode(batches):
        index: dict = defaultdict()
        index.default_factory = index.__len__
        texts, ids, held, size = [], [], [], 0
        for batch in batches:
            for one, raw, out in zip(batch.column("id").to_pylist(), batch.column("body").cast(pa.binary()), batch.column("held").to_pylist(), strict=True):
                words = (raw.as_py() or b"").translate(FOLD).split()
                if texts and size + len(words) >= BLOCK:
                    yield block(texts, ids, held, index)
                    index.clear()
                    texts, ids, held, size = [], [], [], 0
                words.append(END.encode())
                texts.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
                ids.append(one)
                held.append(out)
                size += len(words)
        if texts:
            yield block(texts, ids, held, index)

    made = rows.mapInArrow(encode, BLOCKS).withColumn("block", F.monotonically_increasing_id())
    # Partition and place in it: the blocks of one task, and the first blocks of all tasks, differ in lot.
    lot = F.pmod(F.shiftright("block", 33) + F.col("block").bitwiseAND((1 << 33) - 1), F.lit(LOTS)).cast("int")
    return cut(made.withColumn("lot", lot), **ONE_BLOCK)


def pairs(blocks: DataFrame) -> DataFrame:
    """(block, at, word, seen): one row a distinct word and block."""
    return blocks.select("block", F.posexplode(F.arrays_zip("words", "seen")).alias("at", "x")).select("block", "at", F.col("x.words").alias("word"), F.col("x.seen").alias("seen"))


def counts(blocks: DataFrame) -> DataFrame:
    """(word, c): the training occurrences of every word."""
    return cut(pairs(blocks).where("seen > 0").groupBy("word").agg(F.sum("seen").alias("c")))


def tail_class(word: str) -> int:
    return zlib.crc32(word[-3:].encode()) % TAILS


@dataclass
class Model:
    """Events: heads, then tail classes. start: states; move: states x states; emit: events x states."""

    heads: dict[str, int]
    known: np.ndarray  # training tokens of each tail class
    unknown: np.ndarray  # weight of its unknown words
    tokens: int
    types: int
    share: np.ndarray  # of all tokens, by event
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def events(self, words: list[str]) -> np.ndarray:
        heads, n = self.heads, len(self.heads)
        return np.array([heads[w] if w in heads else n + tail_class(w) for w in words], np.int64)

    def within(self, events: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of each word's share of its event."""
        tail = events - len(self.heads)
        i = np.maximum(tail, 0)
        part = np.where(c > 0, c, self.unknown[i]) / (self.known[i] + self.unknown[i])
        return np.where(tail < 0, 0.0, np.log10(part))


def prepared(counted: DataFrame, states: int, seed: int = 11) -> Model:
    """Events and their shares; states differ at first by random factors and tend to stay."""
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    frequent = (F.col("c") * HEADS > total["n"]) | (F.col("word") == END)
    heads = {r.word: r.c for r in counted.where(frequent).collect()}  # HEADS rows at most
    heads.setdefault(END, 1)
    names = sorted(heads, key=lambda w: (-heads[w], w))
    tail = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(TAILS)).alias("tail")
    rare = counted.where(~frequent).groupBy(tail).agg(F.sum("c").alias("c"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect()  # TAILS rows
    known, unknown = np.zeros(TAILS), np.ones(TAILS)
    for r in rare:
        known[r.tail], unknown[r.tail] = r.c, max(1, r.once)
    share = np.concatenate([[heads[w] for w in names], known + unknown]).astype(float)
    share /= share.sum()
    rng = np.random.default_rng(seed)
    emit = share[:, None] * np.exp(rng.normal(size=(len(share), states)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(dict(zip(names, range(len(names)), strict=True)), known, unknown, total["n"], total["v"], share, np.full(states, 1 / states), move, emit / emit.sum(axis=0))


class Lines:
    """Some sequences side by side, longest first, laid out step by step: step t holds the places
    offset[t] ... offset[t+1] of `obs`, one for each sequence that lasts so long, always in the same order."""

    def __init__(self, obs: np.ndarray, sizes: np.ndarray):
        order = np.argsort(-sizes, kind="stable")
        alive = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(int(sizes.max())), side="right")
        self.offset = np.concatenate([[0], np.cumsum(alive)])
        self.row = np.arange(self.offset[-1]) - np.repeat(self.offset[:-1], alive)
        self.obs = obs[(np.cumsum(sizes) - sizes)[order][self.row] + np.repeat(np.arange(len(alive)), alive)]
        self.order = order

    def windows(self) -> list[tuple[int, int]]:
        """Runs of steps of GATHER places at most, or of one step."""
        out, begin = [], 0
        while begin < len(self.offset) - 1:
            end = max(begin + 1, int(np.searchsorted(self.offset, self.offset[begin] + GATHER, side="right")) - 1)
            out.append((begin, end))
            begin = end
        return out

    def forward(self, m: Model, begin: int, end: int, last: np.ndarray | None, out: np.ndarray) -> np.ndarray:
        """Turns `out`, the emissions of these steps, into scaled forward sums, from the sums before; gives the scales."""
        offset, scales = self.offset - self.offset[begin], np.empty((len(out), 1), out.dtype)
        for t in range(begin, end):
            here = out[offset[t] : offset[t + 1]]
            np.multiply(here, m.start if last is None else last[: len(here)] @ m.move, out=here)
            scale = here.sum(axis=1, keepdims=True)
            np.divide(here, scale, out=here)
            scales[offset[t] : offset[t + 1]] = scale
            last = here
        return scales


def grouped(obs: np.ndarray, sizes: np.ndarray) -> Iterator[Lines]:
    """Sequences of about the same length together, some GATHER places each; a longer sequence is alone."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    part = (np.cumsum(sizes[order], dtype=np.int64) - 1) // GATHER
    for at in np.split(np.arange(len(order)), np.flatnonzero(np.diff(part)) + 1):
        n = sizes[order[at]]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield Lines(obs[np.repeat(starts[at], n) + within], n)


def likelihoods(m: Model, obs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log probability of each sequence of events."""
    total = np.zeros(len(sizes))
    if not len(sizes):
        return total
    lines, last = Lines(obs, sizes), None
    for begin, end in lines.windows():
        places = slice(lines.offset[begin], lines.offset[end])
        sums = m.emit[lines.obs[places]]
        scales = lines.forward(m, begin, end, last, sums)
        total += np.bincount(lines.row[places], np.log(scales[:, 0]), minlength=len(sizes))
        last = sums[lines.offset[end - 1] - lines.offset[begin] :].copy()
    out = np.empty(len(sizes))
    out[lines.order] = total
    return out


class Expected:
    """Expected counts of Baum-Welch, and the log likelihood they come from; recursions in single precision, sums in double."""

    def __init__(self, m: Model):
        k = len(m.start)
        self.m = Model(m.heads, m.known, m.unknown, m.tokens, m.types, m.share, *(x.astype(np.float32) for x in (m.start, m.move, m.emit)))
        self.start, self.move, self.emit, self.loglik = np.zeros(k), np.zeros((k, k)), np.zeros(m.emit.shape), 0.0

    def add(self, obs: np.ndarray, sizes: np.ndarray) -> None:
        for lines in grouped(obs, sizes):
            self.group(lines)

    def group(self, lines: Lines) -> None:
        """Most groups are one window; a long sequence keeps the sums before each window and runs them again, last window first."""
        m, offset, windows = self.m, lines.offset, lines.windows()
        before: list[np.ndarray | None] = [None]
        for begin, end in windows[:-1]:
            sums = m.emit[lines.obs[offset[begin] : offset[end]]]
            lines.forward(m, begin, end, before[-1], sums)
            before.append(sums[offset[end - 1] - offset[begin] :].copy())
        coming = np.zeros((0, len(m.start)), np.float32)  # what the step after the window gives back
        for (begin, end), last in zip(reversed(windows), reversed(before), strict=True):
            obs = lines.obs[offset[begin] : offset[end]]
            given = m.emit[obs]
            sums = given.copy()
            scales = lines.forward(m, begin, end, last, sums)
            self.loglik += float(np.log(scales, dtype=np.float64).sum())
            given /= scales
            beta, at = np.ones_like(sums), offset - offset[begin]
            back = m.move.T.copy()
            for t in range(end - 1, begin - 1, -1):
                if len(coming):
                    beta[at[t] : at[t] + len(coming)] = coming @ back
                coming = given[at[t] : at[t + 1]]
                np.multiply(coming, beta[at[t] : at[t + 1]], out=coming)
            # transitions into each step of the window, the first from the sums before it
            if last is not None:
                self.move += m.move * (last[: at[begin + 1]].T @ given[: at[begin + 1]])
            inner = at[begin + 1]
            if end - begin > 1:
                sizes = np.diff(at[begin + 1 : end + 1])
                previous = np.repeat(at[begin : end - 1], sizes) + lines.row[offset[begin] + inner : offset[end]]
                self.move += m.move * (sums[previous].T @ given[inner:])
            sums *= beta
            if begin == 0:
                self.start += sums[:inner].sum(axis=0, dtype=np.float64)
            for k in range(sums.shape[1]):
                self.emit[:, k] += np.bincount(obs, sums[:, k], minlength=len(self.emit))


def refit(m: Model, start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: float) -> Model:
    """The model of expected counts; emissions lean on the shares of all tokens like `prior` tokens a state."""
    emit = emit + prior * m.share[:, None]
    move, start = move + 0.1, start + 0.1
    return Model(m.heads, m.known, m.unknown, m.tokens, m.types, m.share, start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def training_texts(batch: pa.RecordBatch, m: Model) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Events and sizes of the training texts of each block."""
    for words, held, sizes, codes in zip(*(batch.column(c) for c in ("words", "held", "sizes", "codes")), strict=True):
        sizes, trains = sizes.values.to_numpy(), ~held.values.to_numpy(zero_copy_only=False)
        if trains.any():
            obs = from_planes(codes.as_py())[np.repeat(trains, sizes)]
            yield m.events(words.values.to_pylist())[obs], sizes[trains]


def baum_welch(blocks: DataFrame, m: Model, prior: float) -> tuple[Model, float]:
    """One round over all training texts of the blocks, and their log likelihood before it."""
    events, states = m.emit.shape
    sent = blocks.sparkSession.sparkContext.broadcast(m)  # fewer than HEADS + TAILS rows of `states` numbers
    names = [f"s{k}" for k in range(states)]

    def expect(batches):
        sums = Expected(sent.value)
        for batch in batches:
            for obs, sizes in training_texts(batch, sent.value):
                sums.add(obs, sizes)
        rest = np.zeros((1, states))
        rest[0, 0] = sums.loglik
        every = np.concatenate([sums.emit, sums.move, sums.start[None, :], rest])
        rows = np.flatnonzero(every.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *(pa.array(every[rows, k]) for k in range(states))], names=["row", *names])

    found = blocks.select("words", "held", "sizes", "codes").mapInArrow(expect, ", ".join(["row int", *(f"{n} double" for n in names)]))
    total = found.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    every = np.zeros((events + states + 2, states))
    every[total.column("row").to_numpy()] = np.stack([total.column(n).to_numpy() for n in names], axis=1)
    if not every[-2].any():
        return m, 0.0  # these blocks have no training text
    return refit(m, every[-2], every[events : events + states], every[:events], prior), float(every[-1, 0])


def shares(blocks: DataFrame, warm: int) -> list[DataFrame]:
    """The blocks in parts of whole lots, each read alone: as many as divide LOTS, at most `warm` and not more than there are blocks."""
    most = min(warm, blocks.count())
    parts = max((d for d in range(1, LOTS + 1) if LOTS % d == 0 and d <= most), default=1)
    return [blocks.where(F.col("lot").isin(list(range(i, LOTS, parts)))) if parts > 1 else blocks for i in range(parts)]


def fit(blocks: DataFrame, counted: DataFrame, *, states: int = 12, warm: int = 10, rounds: int = 2, prior: float = 50.0, told: Callable[[float], None] | None = None) -> Model:
    """The model after `warm` rounds over parts in turn and `rounds` rounds over all; `told` gets each round's log likelihood."""
    m = prepared(counted, states)
    if m.tokens:
        parts = shares(blocks, warm)
        for at in range(warm + rounds):
            m, before = baum_welch(parts[at % len(parts)] if at < warm else blocks, m, prior)
            if told:
                told(before)
    return m


def score(blocks: DataFrame, counted: DataFrame, m: Model) -> DataFrame:
    """(id, held, n_tokens, n_known, base_score, score) of every text: log10 probabilities of smoothed counts and of the model."""
    back = pairs(blocks).join(counted, "word").select(F.col("block").alias("block"), "at", "c")
    sent = blocks.sparkSession.sparkContext.broadcast(m)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        m = sent.value
        out: list[pa.Table] = []
        for ids, words, held, sizes, codes in zip(*(left.column(c).combine_chunks() for c in ("ids", "words", "held", "sizes", "codes")), strict=True):
            codes, sizes, words = from_planes(codes.as_py()), sizes.values.to_numpy(), words.values.to_pylist()
            c = np.zeros(len(words), np.int64)
            c[right.column("at").to_numpy()] = right.column("c").to_numpy()
            events = m.events(words)
            base = np.log10(c + 1) - np.log10(m.tokens + m.types + 1)
            starts = np.cumsum(sizes) - sizes
            per_text = lambda x: np.add.reduceat(x[codes], starts)
            whole = likelihoods(m, events[codes], sizes) / np.log(10) + per_text(m.within(events, c))
            out.append(pa.table([ids.values, held.values, pa.array(sizes.astype(np.int64)), pa.array(per_text((c > 0).astype(np.int64))), pa.array(per_text(base)), pa.array(whole)], names=["id", "held", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], k) for n, k in (("id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})

    texts = blocks.select("block", "ids", "words", "held", "sizes", "codes")
    return texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(judge, SCORES)


def held_out(key: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    """Rows whose id, as text, has this CRC-32 remainder; null ids have none."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))
