"""Repeated windows (suffix array, doubling) against brute force, and the index on its own."""

import hashlib
import random

import numpy as np
import pytest

from codeweft.llm import bwt, doubling, repeats

SCHEMA = "doc_id long, text string, clash string, n_words int"


def corpus(seed, unit):
    """Random texts with copied passages, repeated rows, nulls, empties and one long run."""
    rng = random.Random(seed)
    alphabet = ["ab", "c", "é", "dd", "e\u2003f"] if unit == "word" else list("abé")
    texts = [" ".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(25)]
    texts += [texts[0][:20] + " x " + texts[1], texts[2] + "\n" + texts[3], texts[4], texts[4], None, "", "   ", "z " * 40]
    return [(i if i % 9 else None, t, "c", 1) for i, t in enumerate(texts)]


def brute(sequences, window):
    """Covered positions of each sequence."""
    count = {}
    for s in sequences:
        for i in range(len(s) - window + 1):
            count[s[i : i + window]] = count.get(s[i : i + window], 0) + 1
    out = []
    for s in sequences:
        gone = set()
        for i in range(len(s) - window + 1):
            if count[s[i : i + window]] > 1:
                gone.update(range(i, i + window))
        out.append(gone)
    return out


@pytest.mark.parametrize("seed, window", [(1, 6), (2, 9), (3, 12), (4, 16), (5, 33)])
def test_words(spark, seed, window):
    rows = corpus(seed, "word")
    words = [tuple((t or "").encode().split()) for _, t, *_ in rows]
    want = []
    for (doc, *_), w, gone in zip(rows, words, brute(words, window), strict=True):
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((str(doc), len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    got = doubling.remove_repeats(spark.createDataFrame(rows, SCHEMA), window=window, texts=True).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)


@pytest.mark.parametrize("seed, window, hot, waiting", [(1, 8, 1000, 1 << 18), (2, 12, 1, 1 << 18), (3, 20, 1000, 1 << 18), (4, 8, 1000, 3), (5, 12, 1000, 1)])
def test_bytes(spark, monkeypatch, seed, window, hot, waiting):
    """Hot anchors, by their runs or by the rows that wait, take the way of single windows."""
    monkeypatch.setattr(repeats, "WAITING", waiting)
    rows = corpus(seed, "byte")
    raw = [(t or "").encode() for _, t, *_ in rows]
    want = []
    for (doc, *_), b, gone in zip(rows, raw, brute(raw, window), strict=True):
        spans = sum(1 for i in gone if i - 1 not in gone)
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        want.append((str(doc), len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = bwt.remove_repeats(spark.createDataFrame(rows, SCHEMA), window=window, hot=hot).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert doubling.remove_repeats(empty).count() == 0
    assert bwt.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("waiting", [1 << 18, 4, 1])
def test_judged_runs_in_any_batches(monkeypatch, waiting):
    """However rows are cut into batches, a run is told whole if it occurs twice and open if its anchor has others."""
    import pyarrow as pa

    monkeypatch.setattr(repeats, "WAITING", waiting)
    rng = np.random.default_rng(waiting)
    for _ in range(60):
        rows = sorted({(int(rng.integers(0, 4)), int(rng.integers(0, 4)), int(rng.integers(0, 9))) for _ in range(rng.integers(1, 40))})
        many = [bool(rng.integers(0, 2)) for _ in rows]
        batch = pa.RecordBatch.from_pydict({"a": [r[0] for r in rows], "c": [r[1] for r in rows], "g": [r[2] for r in rows], "many": many})
        cuts = sorted({0, len(rows), *rng.integers(0, len(rows) + 1, 4).tolist()})
        parts = [batch.slice(s, e - s) for s, e in zip(cuts, cuts[1:], strict=False)]
        got = [row for b in repeats.judged_runs(iter(parts), 1000, 16) for row in b.to_pylist()]
        size, twice = {}, {}
        for (a, c, _), m in zip(rows, many, strict=True):
            size.setdefault(a, set()).add(c)
            twice[a, c] = twice.get((a, c), 0) + 1 + m
        want = {(a, c, g): twice[a, c] > 1 for a, c, g in rows if len(size[a]) > 1 or twice[a, c] > 1}
        assert {(r["a"], r["c"], r["g"]): (r["kind"] & 3) != repeats.OPEN for r in got} == want and len(got) == len(want)
        for a, c in {k[:2] for k, whole in want.items() if whole and len(size[k[0]]) > 1}:
            assert sum((r["kind"] & 3) == repeats.SPEAKER for r in got if (r["a"], r["c"]) == (a, c)) == 1
        assert all(len({r["kind"] & 16 for r in got if r["a"] == a}) <= 1 for a in size)


@pytest.mark.parametrize("window", [3, 8, 20])
def test_index(window):
    rng = np.random.default_rng(window)
    for _ in range(40):
        runs = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(window, 60)).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
        runs += [runs[0][: window + 2]] * int(rng.integers(0, 2))
        flat = np.frombuffer(b"\0".join(runs) + b"\0", np.uint8).astype(np.int16) + 1
        ends = np.cumsum([len(r) + 1 for r in runs]) - 1
        flat[ends] = 0
        got = bwt.repeated_starts(flat, window)
        count = {}
        for r in runs:
            for i in range(len(r) - window + 1):
                count[r[i : i + window]] = count.get(r[i : i + window], 0) + 1
        for end, r in zip(ends, runs, strict=True):
            for i in range(len(r) - window + 1):
                assert got[end - len(r) + i] == (count[r[i : i + window]] > 1)


def colliding(size=1024):
    """Two words whose rolling hashes agree modulo a power of two whatever the base."""
    bits = [bin(i).count("1") & 1 for i in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_with_equal_rolling_hashes_are_told_apart(spark):
    x, y = colliding()
    words = [f"w{i}" for i in range(40)]
    one, other = list(words), list(words)
    one[5] = one[30] = x
    other[5] = other[30] = y
    docs = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(other)), (3, " ".join(words)), (4, " ".join(words))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in doubling.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 40, 4: 40}


def test_lengths_of_the_levels():
    assert doubling.lengths(35) == [18, 9] and doubling.lengths(4) == [2] and doubling.lengths(64) == [32, 16, 8]


def test_bytes_of_the_whole_small_table(spark):
    """Every 400-byte window of sf0.01, told apart by Python's own hash of its bytes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in bwt.remove_repeats(docs).collect()}
    raws = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    seen = {}
    for _, raw in raws:
        for at in range(len(raw) - 399):
            h = hash(raw[at : at + 400])
            seen[h] = seen.get(h, 0) + 1
    assert len(got) == len(raws)
    for doc, raw in raws:
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - 399):
            if seen[hash(raw[at : at + 400])] > 1:
                gone[at : at + 400] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        assert (got[doc].n_bytes, got[doc].n_removed, got[doc].kept_sha256) == (len(raw), int(gone.sum()), hashlib.sha256(kept).hexdigest())


def test_only_runs_of_hot_anchors_are_judged_by_window():
    """Hashing every window costs most of all: runs of other anchors, and those that repeat as a whole, are left out."""
    anchor, content = np.array([1, 2, 2, 3, 4]), np.array([10, 20, 21, 30, 40])
    whole = np.array([False, False, True, False, False])
    asked = bwt.by_window(anchor, content, whole, np.array([2, 2, 3]), np.array([20, 21, 31]))
    assert asked.tolist() == [1]
    assert not len(bwt.by_window(anchor, content, whole, np.array([], int), np.array([], int)))
