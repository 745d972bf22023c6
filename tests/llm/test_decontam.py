import random
import re
import time

import numpy as np
import pytest

from tarnloom.llm import decontam


def own_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items, window=10):
    wins = {}
    for ident, text in items:
        w = own_words(text)
        for j in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[j : j + window]), set()).add(ident)
    out = []
    for doc, text in docs:
        w = own_words(text)
        hit, ids = set(), set()
        for n in {len(x) for x in wins}:
            for j in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    ids |= found
        out.append((doc, len(w), len(hit), sorted(str(i) for i in ids if i is not None)))
    return out


@pytest.mark.parametrize(("bits", "most"), [(1 << 28, 16 << 20), (1 << 20, 0)])
def test_against_brute_force(spark, monkeypatch, bits, most):
    monkeypatch.setattr(decontam, "MOST_BITS", bits)
    monkeypatch.setattr(decontam, "MOST_HITS", most)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)] + ["é", "日本", "a1", "😀x"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 5, 9, 10, 11, 14, 40]))) for i in range(25)] + [(100, None), (101, " ... "), (3, "same item twice w1 w2"), (3, "same item twice w1 w2"), (None, "no id here at all")]
    docs = [(i, "; ".join(rng.choice(items)[1] or "" if rng.random() < 0.5 else say(rng.randint(0, 30)) for _ in range(4)).upper()) for i in range(60)]
    docs += [(70, None), (71, ""), (72, items[0][1]), (72, items[0][1]), (None, "x no id here at all"), (73, "w1 " * 3000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int").repartition(3)
    got = decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = sorted(brute(docs, items), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.hit_items) for r in got), key=str) == want
    assert all(r.contaminated == (r.n_hit > 0) for r in got)
    assert all(a.end < b.begin for r in got for a, b in zip(r.hit_runs, r.hit_runs[1:]))


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(i, say(rng.randint(1, 60))) for i in range(40)]
    docs = [(i, say(rng.randint(0, 200))) for i in range(60)]
    monkeypatch.setattr(decontam.Bitmap, "has", lambda self, h: np.ones(len(h), bool))
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.hit_items) for r in got) == sorted(brute(docs, items))


def test_one_word_repeated_is_no_product_of_lengths(spark):
    began = time.time()
    docs = spark.createDataFrame([(1, "again " * 20_000), (2, "a b " * 10_000)], "doc_id long, text string")
    items = spark.createDataFrame([("x", "again " * 20_000), ("y", "b a " * 10_000)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.hit_items) for r in decontam.contamination(docs, items).collect()}
    assert got == {1: (20_000, ["x"]), 2: (20_000, ["y"])}
    assert time.time() - began < 60


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontam.contamination(docs, none).first().contaminated
    assert decontam.contamination(docs.limit(0), none).count() == 0


def test_a_shared_window_has_one_fingerprint():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 1 << 63, 10).astype(np.uint64)
    want = decontam.fingerprints(shared, 10, 5)
    for _ in range(200):
        x = rng.integers(0, 9)
        a = np.concatenate([rng.integers(0, 1 << 63, x).astype(np.uint64), shared, rng.integers(0, 1 << 63, rng.integers(0, 9)).astype(np.uint64)])
        assert decontam.fingerprints(a, 10, 5)[x] == want[0]


def test_items_with_equal_ids_keep_their_hits(spark):
    texts = [" ".join(f"{x}{i}" for i in range(12)) for x in "abcde"]
    items = spark.createDataFrame([("first", texts[0]), (None, texts[1]), (None, texts[2]), ("x", texts[3]), ("x", texts[4])], "item_id string, text string").repartition(3)
    docs = spark.createDataFrame([(1, " and ".join(texts)), (1, " and ".join(texts)), (2, "none")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_hit, r.hit_items) for r in decontam.contamination(docs, items).collect())
    assert got == [(1, 60, ["first", "x"])] * 2 + [(2, 0, [])]
