"""Vector codes against a plain loop over rows, parts and entries."""

import hashlib
import math

import numpy as np
import pytest

from codeweft.llm import vectorcodes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, parts, entries, rounds):
    kept = [(i, v, label) for i, v, label, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = []
    for _, v, _ in kept:
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        whole += [0] * (-len(whole) % parts)
        n = len(whole) // parts
        cut.append([whole[p * n : (p + 1) * n] for p in range(parts)])
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        fresh = []
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for row in cut:
                mine[near(p, row[p])[1]].append(row[p])
            fresh.append([[sum(xs) // len(xs) for xs in zip(*m, strict=True)] if m else old for m, old in zip(mine, books[p], strict=True)])
        books = fresh
    out = []
    for (i, _, label), row in zip(kept, cut, strict=True):
        found = [near(p, part) for p, part in enumerate(row)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    flat = [str(x) for book in books for entry in book for x in entry]
    return sorted(out, key=str), hashlib.sha256(",".join(flat).encode()).hexdigest()


def made(n, dim, seed):
    rng = np.random.default_rng(seed)
    return [(int(i), rng.normal(size=dim).round(2).tolist(), None if i % 5 == 0 else int(i % 3), "mine") for i in rng.permutation(n)]


@pytest.mark.parametrize("dim, parts, entries, rounds", [(8, 4, 6, 2), (6, 4, 5, 3), (4, 1, 3, 0), (5, 5, 64, 2)])
def test_against_brute_force(spark, dim, parts, entries, rounds):
    rows = made(60, dim, dim)
    rows += [rows[3], (rows[3][0], [9.0] * dim, 1, None), (None, [0.5] * dim, None, None)]  # a repeated row, a repeated id, a null id
    rows += [(900, None, 1, None), (901, [None] + [1.0] * (dim - 1), 1, None), (902, [float("nan")] * dim, 1, None), (903, [float("inf")] * dim, 2, None), (904, [], 1, None), (905, [1.0] * (dim + 1), 1, None)]
    for split in (1, 7):
        coded, digest, _ = V.compress(spark.createDataFrame(rows, SCHEMA).repartition(split), parts=parts, entries=entries, rounds=rounds)
        got = sorted([(r.id, r.label, r.code, r.error) for r in coded.collect()], key=str)
        want, theirs = brute([r for r in rows if not r[1] or len(r[1]) == dim], parts, entries, rounds)
        assert got == want and digest == theirs


def test_unused_entries_stay(spark):
    rows = [(i, [1.0, 1.0], 0, None) for i in range(3)] + [(9, [5.0, 5.0], 0, None)]
    coded, _, books = V.compress(spark.createDataFrame(rows, SCHEMA), parts=2, entries=4)
    assert {r.code for r in coded.collect()} == {"0000", "0303"}  # the first of equal entries
    assert books[:, :, 0].tolist() == [[256, 256, 256, 1280]] * 2


def test_label_error_sums_equal_labels(spark):
    rows = made(200, 4, 1)
    coded, _, _ = V.compress(spark.createDataFrame(rows, SCHEMA), parts=2, entries=3)
    found = V.with_label_error(coded).collect()
    total = {}
    for r in found:
        total[r.label] = total.get(r.label, 0) + r.error
    assert len(found) == 200 and None in total and all(r.label_error == total[r.label] for r in found)


def test_empty_huge_and_slices(spark, monkeypatch):
    coded, digest, _ = V.compress(spark.createDataFrame([(1, None, 1, None)], SCHEMA))
    assert coded.count() == 0 and V.with_label_error(coded).count() == 0 and digest == hashlib.sha256(b"").hexdigest()
    # Beyond the bound components are held at it: distances stay exact, nothing overflows.
    coded, _, books = V.compress(spark.createDataFrame([(i, [s * 3e38] * 16, 1, None) for i, s in enumerate((1, -1, 1))], SCHEMA), entries=1, rounds=0)
    assert books.max() == V.bound(16) and [r.error for r in coded.orderBy("id").collect()] == [0, 16 * (2 * V.bound(16)) ** 2, 0]
    block = np.arange(40, dtype=np.int32).reshape(4, 10)
    monkeypatch.setattr(V, "SLICE", 3)
    assert np.array_equal(np.concatenate(list(V.slices(block.tobytes(), 4)), axis=1), block)


def test_entries_fit_two_digits(spark):
    with pytest.raises(ValueError):
        V.compress(spark.createDataFrame([], SCHEMA), entries=257)
