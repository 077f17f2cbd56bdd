"""Vector search recall, and the classifier's held-out accuracy."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from codeweft.llm import ann, quality
from codeweft.llm.common import table


def exact(ids, x, q, own, k):
    s = (x * q).sum(axis=1)
    order = [j for j in np.lexsort([ids, -s]) if ids[j] != own]
    return [(int(ids[j]), float(s[j])) for j in order[:k]]


@pytest.mark.parametrize("block, asked", [(16_384, 512), (50, 7)])
def test_search(spark, monkeypatch, block, asked):
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "ASKED", asked)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 10)).astype(np.float32)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    x[100:160] = x[100]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(1000, None), (1020, [0.0] * 10), (1040, [float("nan")] + [1.0] * 9), (1060, [None] + [1.0] * 9), (1080, [1.0] * 3), (None, [0.01] * 10), (1100, [float("inf")] * 10)]
    frame = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in ann.search(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert all(f[1] is not None for found in got.values() for f in found)  # its products are small
    ids, wide = np.arange(900), x.astype(np.float64)
    hits = total = 0
    assert set(got) == set(range(0, 900, 20))
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        want = exact(ids, wide, wide[q], q, 20)
        assert all(abs(f[2] - (wide[f[1]] * wide[q]).sum()) < 1e-12 for f in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len({f[1] for f in found} & {w[0] for w in want})
        total += 20
    assert hits / total >= 0.9
    assert [f[1] for f in got[120]] == [i for i in range(100, 160) if i != 120][:20]


def test_search_small_and_empty(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = ann.search(frame, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0), (2, 0.0)]
    assert ann.search(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.search(frame, F.col("vec_id") == 9).count() == 0


def test_search_tells_rows_apart_not_ids(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.9, 0.1]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (None, [0.5, 0.5]), (None, [0.2, 0.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    found = sorted(zip([r["rank"] for r in got], [r.vec_id or 0 for r in got], [round(r.score, 6) for r in got], strict=True))
    one = [(1, 20, 0.9), (2, 1, 0.5), (3, 1, 0.5), (4, 0, 0.5), (5, 0, 0.2)]
    two = [(1, 20, 0.9), (2, 1, 0.5), (3, 1, 0.5), (4, 0, 0.5), (5, 0, 0.18)]
    assert found == sorted(one + two) and {r.query_id for r in got} == {20}


@pytest.mark.parametrize("kind", ["offset", "norms", "clusters", "copies", "huge"])
def test_search_misses_nothing_on_other_rows(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    if kind == "offset":
        x = 0.01 * x + 5  # all products are nearly equal
    elif kind == "norms":
        x *= np.exp(3 * rng.normal(size=(3000, 1)))
    elif kind == "clusters":
        x = 0.02 * x + rng.normal(size=(7, 24))[rng.integers(0, 7, 3000)]
    elif kind == "copies":
        x[500:2500] = x[500]
    elif kind == "huge":
        x *= 1e60
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 100))
    for q, found in got.items():
        assert found == exact(np.arange(3000), x, x[q], q, 20)


def test_search_probes_on_until_k_are_found(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(400, 6)))]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=300, probes=1, shortlist=400)
    assert got.groupBy("query_id").count().select("count").distinct().collect()[0][0] == 300


def test_classifier_on_held_out_labels(spark):
    root = SMALL.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, root, "documents"), table(spark, root, "labels")
    known = labels.where("doc_id % 3 <> 0")
    models = quality.train(docs, known)
    held = quality.score(docs, models, ["doc_id"]).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    right = sum((r.p_low >= 0.5) == (r.quality == 0) for r in held)
    assert right / len(held) > 0.93
    clean = [r for r in held if r.quality == 1 and r.toxic == 0]
    assert sum(r.keep for r in clean) / len(clean) > 0.9


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (1, "a b", "en", "s", 3, 1)], "doc_id long, text string, lang string, source string, n_chars long, keep int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    models = quality.train(docs, none)
    assert all(r.keep for r in quality.score(docs, models, ["doc_id"]).collect())
    assert quality.kept(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.kept(docs, one).count() == 3
