"""The near-duplicate stage against brute-force Jaccard."""

import numpy as np

from codeweft.llm import simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def similarity(a, b, k=5):
    cut = lambda t: (lambda w: {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())(t.lower().split())
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def kept(spark, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    return sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, COLUMNS)).collect())


def brute(texts):
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and similarity(texts[i], texts[j]) >= 0.8:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return sorted(set(group))


def edited(rng, n, edits):
    """A text of n words and one with words replaced far apart: each edit changes five shingles."""
    base = [f"b{x}" for x in rng.integers(0, 1 << 40, n)]
    other = list(base)
    for at in np.linspace(5, n - 6, edits).astype(int):
        other[at] = f"e{rng.integers(0, 1 << 40)}"
    return " ".join(base), " ".join(other)


def test_every_pair_at_the_bound_and_none_below(spark):
    rng = np.random.default_rng(2)
    pairs = [edited(rng, n, e) for n in (94, 124, 184, 274, 404) for e in range(1, n // 15) for _ in range(2)]
    near = [s for a, b in pairs if 0.8 <= (s := similarity(a, b)) <= 0.85]
    below = [s for a, b in pairs if 0.7 <= (s := similarity(a, b)) < 0.8]
    assert len(near) > 10 and len(below) > 10 and 0.8 in near
    texts = [t for p in pairs for t in p]
    want = sorted([*range(0, len(texts), 2), *[2 * i + 1 for i, (a, b) in enumerate(pairs) if similarity(a, b) < 0.8]])
    assert kept(spark, texts) == want


def test_short_texts_chains_and_a_common_passage(spark):
    rng = np.random.default_rng(3)
    line = " ".join(f"c{i}" for i in range(12))
    short = [" ".join(rng.choice(list("abc"), n)) for n in rng.integers(1, 14, 40)]
    common = [f"{line} " + " ".join(f"u{x}" for x in rng.integers(0, 1 << 40, n)) for n in range(30)]
    chain = [[f"k{i}" for i in range(104)]]
    for step in range(6):
        chain.append([*chain[-1][: 10 * step + 9], f"x{step}", *chain[-1][10 * step + 10 :]])
    texts = ["", " ", *short, *common, *[" ".join(c) for c in chain]]
    assert kept(spark, texts) == brute(texts)


def test_a_text_of_two_shingles_is_not_an_empty_one(spark):
    """Few set bits are near to the fingerprint of an empty text, but the texts are not alike."""
    six = next(t for i in range(100_000) if np.unpackbits(np.frombuffer(simhash.fingerprint(t := f"p{i} q r s t u", 5, 4), np.uint8)).sum() <= 44)
    assert kept(spark, ["", six]) == [0, 1]


def test_groups_of_near_copies_and_columns_of_any_name(spark):
    """Random groups around a base, at distances on both sides of the bound; columns clash with those inside."""
    rng = np.random.default_rng(5)
    texts = []
    for n in (9, 30, 60, 200):
        base = [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
        for _ in range(25):
            one = list(base)
            for at in rng.integers(0, n, rng.integers(0, 1 + n // 25)):
                one[at] = f"v{rng.integers(0, 1 << 40)}"
            texts.append(" ".join(one))
    rows = [(i, t, i * 2, i * 3, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long, row long, key string")
    found = simhash.one_of_each(docs)
    assert found.columns == docs.columns
    got = sorted(found.collect())
    assert [r.doc_id for r in got] == brute(texts)
    assert all(r.node == r.doc_id * 2 and r.row == r.doc_id * 3 for r in got)


def test_empty_table_and_nulls(spark):
    assert simhash.one_of_each(spark.createDataFrame([], COLUMNS)).count() == 0
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "a b c d e f", "en", "s", 11), (None, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11)]
    kept_ = simhash.one_of_each(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted((r.doc_id is None, r.text or "") for r in kept_) == [(True, ""), (True, "a b c d e f")]
