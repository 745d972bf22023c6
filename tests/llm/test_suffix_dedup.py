import hashlib
import random

import numpy as np
import pytest

from tarnloom.llm import suffix_dedup as sd


def brute(rows, length):
    """rows: (id, text) in order; per row the kept bytes and the number of removed runs."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        cover = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            w = hashlib.md5(data[i : i + length]).digest()
            if w in seen:
                cover[i : i + length] = True
            seen.add(w)
        runs = int((np.diff(cover.astype(int), prepend=0) == 1).sum())
        out.append((bytes(b for b, c in zip(data, cover) if not c), runs))
    return out


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [say(rng.randint(12, 60)) for _ in range(8)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            out.append(rng.choice(out))
        elif out and kind < 0.35:
            w = rng.choice(out).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = "edit"
            out.append(" ".join(w))
        else:
            out.append(" ".join(say(rng.randint(0, 40)) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randint(1, 6))))
    return [*out, "", None, "a" * 700, "xyz" + "a" * 300, "ab" * 400, "\0" * 250 + "q" + "\0" * 250, "ba" * 200, "é" * 120]


@pytest.mark.parametrize(("seed", "max_group", "share"), [(1, 4000, 3 << 20), (2, 2, 3 << 20), (3, 4000, 20_000)])
def test_against_brute_force(spark, seed, max_group, share):
    rows = list(enumerate(texts(seed)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(5)
    got = {r.doc_id: r for r in sd.remove_repeats(docs, max_group=max_group, share_bytes=share).collect()}
    for (i, text), (kept, runs) in zip(rows, brute(rows, 100)):
        r = got[i]
        assert (bytes(r.kept), r.n_spans) == (kept, runs), i
        assert (r.n_bytes, r.n_removed) == (len((text or "").encode()), len((text or "").encode()) - len(kept))


def test_a_passage_in_many_documents(spark):
    """Every edge of the passage is an anchor with as many different contexts as there are documents."""
    rng = random.Random(6)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = say(260)
    rows = [(i, say(rng.randint(0, 120)) + passage + say(rng.randint(0, 120))) for i in range(300)]
    rows += [(1000 + i, t[: 150 + i]) for i, t in rows[:40]]
    got = {r.doc_id: r for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), max_group=20).collect()}
    for (i, _), (kept, runs) in zip(rows, brute(rows, 100), strict=True):
        assert (bytes(got[i].kept), got[i].n_spans) == (kept, runs), i


def test_pieces_hold_each_window_once():
    text = bytes(range(256)) * 3
    for at in range(0, 69):
        for windows in range(1, at + 2):
            cuts = sd.cut_up(text, 100, windows, at, 100)
            assert [w for _, first, n in cuts for w in range(first, first + n)] == list(range(100, 100 + windows))
            whole = {first + j: key for key, first, n in sd.cut_up(text, 100 + 0, at + 1, at, 100) for j in range(n)}
            assert all(whole[first + j] == key for key, first, n in cuts for j in range(n))


def test_repeated_and_null_ids(spark):
    p = " ".join(f"w{i}" for i in range(60))
    rows = [(2, p), (2, p), (None, p + " z"), (1, "y " + p), (2, "q " + p)]
    got = sorted((str(r.doc_id), r.n_removed > 0) for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", False), ("2", True), ("2", True), ("2", True), ("None", True)]
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(0)
    for alphabet, n in ((2, 300), (4, 500), (200, 400), (1, 150), (3, 1), (3, 2)):
        data = rng.integers(97, 97 + alphabet, n).astype(np.uint8) if alphabet < 100 else rng.integers(0, 256, n).astype(np.uint8)
        raw = data.tobytes()
        wanted = rng.random(n) < 0.7
        order = sd.suffix_order(data, wanted, n + 1)
        assert order.tolist() == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: raw[i:]) or alphabet >= 100
        most = 24
        for k, (a, b) in zip(sd.common_prefixes(data, order, most), zip(order, order[1:])):
            x, y = raw[a:] + b"\0" * most, raw[b:] + b"\0" * most
            assert k == next((i for i in range(most) if x[i] != y[i]), most)
        small = [raw[i:] < raw[i + 1 :] for i in range(n)]
        assert sd.types(data).tolist() == small
