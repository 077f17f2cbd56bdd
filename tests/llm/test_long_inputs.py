"""Very long texts and conversations, whose results are known by how they are made."""

import hashlib
import random

import pytest

from codeweft.llm import bwt, chat, decontaminate, doubling, hmm, jaccard, quality, secrets, simhash

N = 60_000


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    word = lambda: f"{rng.getrandbits(40):010x}"
    shared = [word() for _ in range(100)]
    long = [word() for _ in range(N)]
    long[30_000:30_100] = shared
    short = [word() for _ in range(50)] + shared + [word() for _ in range(50)]
    return " ".join(long), " ".join(short), " ".join(shared)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(1, texts[0], "en", "s", 0), (2, texts[1], "en", "s", 0), (3, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")


def test_repeats(docs, texts):
    got = {r.doc_id: r for r in doubling.remove_repeats(docs).collect()}
    assert (got[1].n_words, got[1].n_removed, got[2].n_removed, got[3].n_words) == (N, 100, 100, 0)
    assert got[2].kept_sha256 == hashlib.sha256(" ".join(texts[1].split()[:50] + texts[1].split()[150:]).encode()).hexdigest()
    got = {r.doc_id: r for r in bwt.remove_repeats(docs).collect()}
    # the passage with the blanks around it, and what happens to agree beyond
    assert got[1].n_removed == got[2].n_removed and 0 <= got[1].n_removed - len(texts[2]) - 2 <= 4 and (got[1].n_spans, got[3].n_removed) == (1, 0)


def test_windows_of_a_benchmark(spark, docs, texts):
    items = spark.createDataFrame([(7, " ".join(texts[2].split()[20:60]))], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.decontaminate(docs, items, keep=["doc_id"]).collect()}
    assert got == {1: (N, 40, ["7"]), 2: (200, 40, ["7"]), 3: (0, 0, [])}


def test_near_copies(spark, docs, texts):
    words = texts[0].split()
    words[10] = words[50_000] = "other"
    more = docs.unionByName(spark.createDataFrame([(9, " ".join(words), "en", "s", 0)], docs.schema))
    assert sorted(r.doc_id for r in jaccard.one_of_each(more).collect()) == [1, 2, 3]
    assert simhash.near_duplicates(more).count() == 4


def test_secrets_and_scores(spark, docs):
    held, _ = secrets.scan_history([docs])
    assert held.count() == 3
    blocks = hmm.encoded(docs, "doc_id", "text", ~hmm.held_out())
    counted = hmm.counts(blocks)
    found = {r.id: r for r in hmm.score(blocks, counted, hmm.fit(blocks, counted, states=2, warm=1, rounds=1)).collect()}
    assert found[1].n_tokens == N + 1 and found[3].n_tokens == 1 and all(r.score < 0 for r in found.values())


def test_labelled_ids_that_repeat(spark, docs, texts):
    """All rows of a labelled id train, and every row is scored."""
    rows = [(i % 40, f"{'bad' if i % 2 else 'good'} words {i} " * 5, "en", "s", 0) for i in range(400)]
    many = spark.createDataFrame(rows, docs.schema).unionByName(docs)
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(40)] + [(0, 1, 0)] * 5, "doc_id long, quality int, toxic int")
    assert quality.score(many, quality.train(many, labels), ["doc_id"]).count() == 403


def test_a_conversation_of_thousands_of_turns(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"<|im_end|> {t}") for t in range(5000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.digests(chat.format_records(chat.conversation_records(frame), key="conv_id")).first()
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
    assert got.n_turns == 5000 and got.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got.loss_sha256 == hashlib.sha256("".join(t for _, _, r, t in rows if r == "assistant").encode()).hexdigest()
