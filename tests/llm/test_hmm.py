"""The hidden Markov model against sums over all ways through the states, and against plain counting."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from codeweft.llm import hmm
from codeweft.llm.common import table

SCHEMA = "doc_id long, text string, held string, n_tokens int"
SMALL = "/root/testdata/sf0.001"


def model(states, events, seed):
    rng = np.random.default_rng(seed)
    draw = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s) + 0.05)
    return hmm.Model({hmm.END: 0}, np.zeros(hmm.TAILS), np.ones(hmm.TAILS), 1, 1, draw(events), draw(states), draw(states, states), draw(states, events).T.copy())


def ways(m, obs):
    for path in itertools.product(range(len(m.start)), repeat=len(obs)):
        p = m.start[path[0]] * m.emit[obs[0], path[0]]
        for t in range(1, len(obs)):
            p *= m.move[path[t - 1], path[t]] * m.emit[obs[t], path[t]]
        yield path, p


@pytest.mark.parametrize("gather", [1, 2, 5, 7, 1000])
@pytest.mark.parametrize("seed", range(2))
def test_likelihoods_and_expected_counts(seed, gather, monkeypatch):
    monkeypatch.setattr(hmm, "GATHER", gather)
    m = model(3, 4, seed)
    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, 4, n) for n in (1, 5, 2, 6, 1, 3, 7)]
    obs, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    want = [sum(p for _, p in ways(m, t)) for t in texts]
    assert np.allclose(hmm.likelihoods(m, obs, sizes), np.log(want))
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for text, total in zip(texts, want, strict=True):
        for path, p in ways(m, text):
            start[path[0]] += p / total
            for t, k in enumerate(path):
                emit[text[t], k] += p / total
                if t:
                    move[path[t - 1], k] += p / total
    found = hmm.Expected(m)
    found.add(obs, sizes)
    assert np.allclose(found.start, start, rtol=1e-4) and np.allclose(found.move, move, rtol=1e-4) and np.allclose(found.emit, emit, rtol=1e-4)
    assert math.isclose(found.loglik, np.log(want).sum(), rel_tol=1e-5)


def test_planes():
    codes = np.array([0, 1, 255, 256, 70_000, 2**31])
    assert np.array_equal(hmm.from_planes(hmm.planes(codes)), codes)


TEXTS = [
    (1, "The cat, the cat\x0bTHE dog"), (2, None), (3, ""), (4, "unseen words here"), (None, "the the"), (4, "the cat"), (5, "ÄRGER the Straße"),
    (6, "cat " * 3000), (7, "\n\t the"), (8, "rare1 rare2 rare1"), (2, None),
]


def plain(text):
    low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), " "]


@pytest.mark.parametrize("block", [hmm.BLOCK, 4])
def test_base_scores(spark, monkeypatch, block):
    monkeypatch.setattr(hmm, "BLOCK", block)
    frame = spark.createDataFrame([(i, t, "mine", 7) for i, t in TEXTS], SCHEMA).repartition(3)
    blocks = hmm.encoded(frame, "doc_id", "text", ~hmm.held_out())
    counted = hmm.counts(blocks)
    m = hmm.fit(blocks, counted, states=2, warm=1, rounds=1)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    assert any(held(i) for i, _ in TEXTS)
    c = Counter(w for i, t in TEXTS if not held(i) for w in plain(t))
    n, v = sum(c.values()), len(c)
    assert (m.tokens, m.types) == (n, v) and {r.word: r.c for r in counted.collect()} == c
    want = sorted((str(i), held(i), len(plain(t)), sum(c[w] > 0 for w in plain(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in plain(t)), 6)) for i, t in TEXTS)
    found = hmm.score(blocks, counted, m).collect()
    assert sorted((str(r.id), r.held, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_every_state_gives_one(spark, monkeypatch):
    """Known words and one unknown event a class add up to 1; the score is the very sum of its parts."""
    monkeypatch.setattr(hmm, "HEADS", 40)
    frame = table(spark, SMALL, "documents")
    blocks = hmm.encoded(frame, "doc_id", "text", ~hmm.held_out())
    counted = hmm.counts(blocks)
    said = []
    m = hmm.fit(blocks, counted, states=3, warm=3, rounds=3, told=said.append)
    assert 0 < len(m.heads) < 42
    words = {r.word: r.c for r in counted.collect()}
    events = np.concatenate([m.events(list(words)), len(m.heads) + np.arange(hmm.TAILS)])  # the unknown of each class
    c = np.array([*words.values(), *[0] * hmm.TAILS])
    inside = 10 ** m.within(events, c)
    assert np.allclose(np.bincount(events, inside, minlength=len(m.share)), 1)
    assert np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.move.sum(axis=1), 1) and math.isclose(m.start.sum(), 1)
    assert said[1] < said[2] and said[3] < said[4] < said[5]  # each table's own likelihood rises
    texts = {r.doc_id: r.text for r in frame.collect()}
    for r in hmm.score(blocks, counted, m).limit(20).collect():
        text = plain(texts[r.id])
        events = m.events(text)
        want = hmm.likelihoods(m, events, np.array([len(text)]))[0] / math.log(10) + m.within(events, np.array([words.get(w, 0) for w in text])).sum()
        assert math.isclose(r.score, want, rel_tol=1e-9)


def test_better_than_counts_on_held_out(spark):
    frame = table(spark, "/root/testdata/sf0.01", "documents")
    blocks = hmm.encoded(frame, "doc_id", "text", ~hmm.held_out())
    counted = hmm.counts(blocks)
    found = [r for r in hmm.score(blocks, counted, hmm.fit(blocks, counted)).collect() if r.held]
    assert sum(r.score for r in found) > 0.9 * sum(r.base_score for r in found)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    only_held = spark.createDataFrame([(i, "a b", "x", 1) for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2], SCHEMA)
    for frame, rows in ((empty, 0), (only_held, only_held.count())):
        blocks = hmm.encoded(frame, "doc_id", "text", ~hmm.held_out())
        counted = hmm.counts(blocks)
        found = hmm.score(blocks, counted, hmm.fit(blocks, counted)).collect()
        assert len(found) == rows and all((r.n_tokens, r.n_known, r.base_score) == (3, 0, 0.0) and math.isfinite(r.score) for r in found)


def test_classes_agree_with_spark(spark):
    words = ["a", "ab", "abc", "xxéüß", "日本語です", "-"]
    got = spark.createDataFrame([(w,) for w in words], "word string").selectExpr(f"pmod(crc32(substring(word, -3, 3)), {hmm.TAILS})").collect()
    assert [r[0] for r in got] == [hmm.tail_class(w) for w in words]


def test_every_training_text_is_in_one_part_and_every_block_in_its_own_row_group(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK", 30)
    frame = spark.createDataFrame([(i, f"w{i} " * 9, "x", 1) for i in range(400)], SCHEMA).repartition(4)
    blocks = hmm.encoded(frame, "doc_id", "text", ~hmm.held_out())
    parts = hmm.shares(blocks, 10)
    ids = [sorted(i for r in part.select("ids").collect() for i in r.ids) for part in parts]
    assert len(parts) == 10 and all(ids) and sorted(sum(ids, [])) == list(range(400))
    groups = [pq.ParquetFile(re.sub("^file:/+", "/", r[0])).metadata for r in blocks.select("_metadata.file_path").distinct().collect()]
    assert max(m.num_row_groups for m in groups) > 10 and all(m.num_rows == m.num_row_groups for m in groups)
    assert len(hmm.shares(blocks, 1)) == 1 and len(hmm.shares(blocks.limit(3), 10)) == 2
