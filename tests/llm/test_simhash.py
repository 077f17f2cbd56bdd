"""Fingerprints and links against brute force."""

import re

import numpy as np
import xxhash

from codeweft.llm import simhash
from codeweft.llm.graph import components


def slow_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


TEXTS = ["The quick brown fox jumps", "the QUICK brown fox jumps", "one two", "Ünd ÄB c\x0bd", None, "", " \n", "a " * 50, "a b c d e f g h i j k l m n o p", "x"]


def test_fingerprint():
    for t in TEXTS:
        assert simhash.fingerprint(t, 3).hex() == f"{slow_fingerprint(t):016x}"
    assert len(simhash.fingerprint("a b c", 3, lanes=4)) == 32


def test_pieces_do_not_change_the_fingerprint(monkeypatch):
    text = " ".join(map(str, range(1000)))
    want = simhash.fingerprint(text, 3, 2)
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text, 3, 2) == want


def forest(x, most):
    parent = list(range(len(x)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(1, len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]).reshape(i, -1).sum(axis=1) <= most):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(x)):
        groups.setdefault(find(i), set()).add(i)
    return sorted(map(sorted, groups.values()))


def near_random(rng, n):
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return np.unique(np.concatenate([base, base ^ flip(), base ^ flip() ^ flip(), base ^ flip() ^ flip() ^ flip()]))


def test_links_in_a_node():
    rng = np.random.default_rng(3)
    for n in (1, 4, 40, 400):
        x = near_random(rng, n)
        rng.shuffle(x)
        groups = {}
        for i, root in enumerate(simhash.links(x[:, None], 2)):
            groups.setdefault(int(root), set()).add(i)
        assert sorted(map(sorted, groups.values())) == forest(x[:, None], 2)


def test_components_over_the_index(spark, monkeypatch):
    """With small tiles, large top nodes are searched in pairs of tiles: no link may be lost."""
    monkeypatch.setattr(simhash, "TILE", 5)
    rng = np.random.default_rng(5)
    x = near_random(rng, 60)
    x = np.unique(np.concatenate([x, (np.uint64(7) << np.uint64(50)) + np.arange(40, dtype=np.uint64) * np.uint64(3)]))
    fps = spark.createDataFrame([(int(v).to_bytes(8, "big"),) for v in x], "fp binary")
    found = components(simhash.edges(fps, 2, simhash.bands(64, 3))).collect()
    groups = {}
    for r in found:
        groups.setdefault(bytes(r.root), set()).add(bytes(r.node))
    place = {int(v).to_bytes(8, "big"): i for i, v in enumerate(x)}
    assert sorted(sorted(place[n] for n in g) for g in groups.values()) == [g for g in forest(x[:, None], 2) if len(g) > 1]


def test_components_of_a_long_chain(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("900", "901"), ("901", "900"), ("950", "950")]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert all(got[f"{i:03d}"] == "000" for i in range(61)) and got["901"] == "900" and "950" not in got


def test_near_duplicates(spark):
    rows = [(i if i != 4 else None, t, "x", "y") for i, t in enumerate(TEXTS)] + [(20, TEXTS[8], "x", "y"), (20, TEXTS[8], "x", "y")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string, component string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].component == 0 and by[20].component == 8 and by[6].component == by[5].component == 5
    assert by[None].component == 5  # a null text is like an empty one; the least id that is not null
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_keeps_one_of_each(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, 300)) for _ in range(6)]
    near = [b.replace(" w7 ", " other ").rsplit(" ", 1)[0] + " end" for b in base[:3]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*base, *near, base[5], base[5]])] + [(99, None, None, None, None), (98, "", "en", "s", 0)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 98]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
