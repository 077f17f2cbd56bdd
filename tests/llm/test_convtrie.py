"""The conversation trie against a dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from codeweft.llm import convtrie as C

SCHEMA = "conv_id long, turn long, role string, text string, base string, depth int"


def brute(rows, family=5, shared=9):
    held = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            held.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    for said in held.values():
        said.sort()
    rebuilt = {}
    for c in held:
        h = zlib.crc32(str(c).encode()) % shared
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        rebuilt[c] = [t[1:] for t in held.get(base, [])[:h] + held[c][h:]]
    nodes = {}
    for c, said in rebuilt.items():
        for d in range(len(said) + 1):
            nodes.setdefault(tuple(said[:d]), []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)

    def below(path):
        leaves, saved = int(path not in kids), (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        for k in kids.get(path, []):
            more = below(k)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids.get(path, [])), *below(path), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, split=3, **kw):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(split)
    return sorted((tuple(r) for r in C.build(frame, **kw).collect()), key=str)


def made(n, seed, longest=12, words=2):
    rng = random.Random(seed)
    rows = []
    for c in range(-n // 3, n):
        if rng.random() < 0.8:
            rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["é" * k for k in range(words)] + [None]), "x", 1) for t in range(rng.randint(1, longest))]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rows = made(40, seed)
    rows += [(None, 0, "user", "lost", "x", 1), rows[0], rows[0]]  # no id; repeated rows
    assert got(spark, rows) == brute(rows)


def test_long_conversations_and_small_pieces(spark, monkeypatch):
    """Paths beyond the head, segments, several families in a block, several pieces of one list of ends."""
    monkeypatch.setattr(C, "HEAD", 10)
    monkeypatch.setattr(C, "SEGMENT", 4)
    monkeypatch.setattr(C, "FAMILIES", 2)
    monkeypatch.setattr(C, "CHUNK", 2)
    rows = made(24, 7, longest=40, words=1)  # few different turns: long shared prefixes
    rows += [(c, t, "user", "same", "x", 1) for c in range(100, 130) for t in range(14)]
    assert got(spark, rows, split=7) == brute(rows)


def test_only_the_root(spark):
    """Ids whose own turns all fall into a prefix that no base gives."""
    c = next(i for i in range(1000) if i % 5 and zlib.crc32(str(i).encode()) % 9 >= 2)
    assert got(spark, [(c, 1, "user", "a", "", 0)]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_empty(spark):
    assert got(spark, []) == [] == got(spark, [(None, 1, "user", "a", "", 0)])


def test_hot_conversation_is_many_tasks(spark):
    rows = [(5, t, "user", str(t), "", 0) for t in range(9000)] + [(6, 1, "user", "0", "", 0)]
    found = C.build(spark.createDataFrame(rows, SCHEMA).repartition(4))
    # n_convs is 2 on what both share; every other node has one member, so depths are all there once
    assert found.count() == 9001 + (len(brute([r for r in rows if r[0] == 6 or r[1] < 20])) - 21)


def test_other_families(spark):
    rows = made(20, 3)
    assert got(spark, rows, family=3, shared=4) == brute(rows, 3, 4)
