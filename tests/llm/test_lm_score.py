import math
import random
from collections import Counter

import numpy as np

from tarnloom.llm import lm_score

ROWS = [(1, "the cat sat on the mat"), (2, "The dog sat"), (3, None), (4, ""), (5, "a b c the the"), (6, "zzz the cat"), (6, "zzz the cat"), (None, "the cat sat"), (7, "a"), (8, " \x0b ")]


def brute(rows, good, weight):
    """Each model's counts are made anew for each document, from all other documents."""
    docs = [(i, (t or "").lower().split()) for i, t in rows]
    vocabulary = len({w for _, own in docs for w in own})
    out = []
    for k, (i, own) in enumerate(docs):
        losses = []
        for target in (True, False):
            word, context, pair = Counter(), Counter(), Counter()
            for j, (other, text) in enumerate(docs):
                if j != k and (not target or other in good):
                    word.update(text)
                    context.update([None, *text][: len(text)])
                    pair.update(zip([None, *text], text))
            total = sum(word.values())
            p = [(pair[b, w] + weight * (word[w] + 1) / (total + vocabulary)) / (context[b] + weight) for b, w in zip([None, *own], own)]
            losses.append(-sum(map(math.log, p)) / len(p) if p else None)
        out.append((i, len(own), *losses))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[1], r[2] or 0)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2]
        if w[1]:
            assert math.isclose(g[2], w[2], rel_tol=1e-9) and math.isclose(g[3], w[3], rel_tol=1e-9) and math.isclose(g[4], w[2] - w[3], abs_tol=1e-9)
        else:
            assert g[2:] == (None, None, None)


def test_against_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, "x", 5) for r in ROWS], "doc_id long, text string, lm_score string, tokens int").coalesce(2)
    good = spark.createDataFrame([(1,), (1,), (6,), (None,), (99,)], "doc_id long")
    for chunk, per_range, most in ((lm_score.CHUNK, lm_score.RANGE, lm_score.MOST_IDS), (150, 4, 2)):
        monkeypatch.setattr(lm_score, "MOST_IDS", most)
        out = lm_score.score(docs, good, weight=2.0, chunk=chunk, per_range=per_range)
        assert out.columns == ["doc_id", "text", "tokens", "n_tokens", "loss_target", "loss_background", "lm_score"]
        got = out.collect()
        assert sorted(map(str, ((r[0], r[1], r[2]) for r in got))) == sorted(map(str, ((*r, 5) for r in ROWS)))
        same([(r[0], *r[3:]) for r in got], brute(ROWS, {1, 6}, 2.0))


def test_random_documents_in_many_chunks(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("abcdefghijÉß") * rng.randint(1, 3) for _ in range(n))
    rows = [(i, say(rng.randint(0, 40))) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows[:20]]
    good = {i for i in range(0, 110, 3)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = lm_score.score(docs, spark.createDataFrame([(i,) for i in good], "i long"), chunk=1000, per_range=50, keep=["doc_id"])
    assert got.columns[0] == "doc_id" and len(got.columns) == 5
    same([tuple(r) for r in got.collect()], brute(rows, good, 5.0))


def test_documents_that_occur_twice_score_apart(spark):
    rng = random.Random(3)
    say = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(80))
    rows = [(i, say()) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    out = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(200, 260)], "i long"))
    by = {r.doc_id: r.lm_score for r in out.collect()}
    assert min(by[i] for i in [*range(20), *range(1000, 1020)]) > max(by[i] for i in range(20, 300))


def test_no_rows_and_no_target(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert lm_score.score(docs.limit(0), none).count() == 0
    got = lm_score.score(docs, none).filter("n_tokens > 0").collect()
    vocabulary = len({w for _, t in ROWS for w in (t or "").lower().split()})
    assert got and all(np.isclose(r.loss_target, math.log(vocabulary)) for r in got)
