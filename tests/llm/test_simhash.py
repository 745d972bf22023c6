import random
import re

import xxhash

from tarnloom.llm import simhash
from tarnloom.llm.components import components


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """fps: (id, fingerprint); the smallest id reachable, for each row."""
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                label[root(i)] = root(j)
    smallest = {}
    for i, (doc, _) in enumerate(fps):
        smallest[root(i)] = min(smallest.get(root(i), doc), doc)
    return [smallest[root(i)] for i in range(len(fps))]


def test_fingerprints():
    for text in ["", " \t ", "One", "one two", "A b c d e f", "Ünï côde\x0bÀB x\xa0y z", "a  b\n\nc " * 500]:
        got = simhash.fingerprint(text.encode()) & (1 << 64) - 1
        assert got == brute_fingerprint(text), text


def test_links_against_all_pairs(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(6):
        fps += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in rng.sample(fps, 60)]
    fps = sorted({*fps, 0, 1, (1 << 64) - 1, (1 << 64) - 2, 1 << 63})
    signed = [simhash.np.uint64(x).astype("int64").item() for x in fps]
    got = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    of = {r.node: r.component for r in got}
    groups = {}
    for x, label in zip(signed, brute_components([(i, x) for i, x in enumerate(fps)])):
        groups.setdefault(label, []).append(x)
    for members in groups.values():
        assert {of.get(x, x) for x in members} == {min(members)}


def test_near_duplicates_of_hard_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base.upper()), (9, base + " tail"), (7, None), (8, ""), (2, " \n"), (1, "other words here"), (1, "other words here"), (None, base), (4, "x" * 100000)]
    docs = spark.createDataFrame([(a, b, 1.5) for a, b in rows], "doc_id long, text string, fp double")
    got = simhash.near_duplicates(docs).collect()
    fps = [(10**9 if a is None else a, brute_fingerprint(b)) for a, b in rows]
    want = sorted((str(a), f, c) for (a, _), (_, f), c in zip(rows, fps, brute_components(fps)))
    assert sorted((str(r.doc_id), r.fingerprint & (1 << 64) - 1, r.component) for r in got) == want
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5000, 5000), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_similar_documents_link(spark):
    rng = random.Random(8)
    say = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(4000)) for _ in range(n)]
    rows, jaccard = [], {}
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    for i in range(120):
        base = say(rng.choice([60, 200, 500]))
        edits = rng.choice([0.005, 0.01, 0.02, 0.06])
        copy = [say(1)[0] if rng.random() < edits else w for w in base]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        jaccard[i] = len(shingles(base) & shingles(copy)) / len(shingles(base) | shingles(copy))
    docs = spark.createDataFrame([*rows, (500, None), (501, " "), (502, "one two")], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component for r in simhash.near_duplicates(docs, similarity=0.8).collect()}
    near = [i for i, j in jaccard.items() if j >= 0.8]
    assert sum(got[2 * i + 1] == 2 * i for i in near) >= 0.9 * len(near) > 20
    assert all(got[2 * i + 1] == 2 * i + 1 for i, j in jaccard.items() if j < 0.65)
    assert all(got[2 * i] == 2 * i for i in jaccard) and got[501] == got[500] == 500 and got[502] == 502


def test_band_plan_grows_slowly():
    (b1, n1), (b2, n2) = simhash.band_plan(10**5, 0.8), simhash.band_plan(10**9, 0.8)
    assert b1 == 21 and b2 == 34 and n1 < n2 < 10 * n1
    assert simhash.bit_agreement(1.0) == 1.0 and abs(simhash.bit_agreement(0.0) - 0.5) < 1e-9


def test_copies_in_a_mixed_group_link(spark):
    """Near copies that share their bands with many texts which are like neither: no end of the group is near them."""
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = say(150)
    rows = [(i, " ".join(shared + say(50))) for i in range(1500)]
    for i in range(60):
        w = shared + say(50)
        w2 = ["other" if j in (160, 175, 190) else x for j, x in enumerate(w)]
        rows += [(2000 + 2 * i, " ".join(w)), (2001 + 2 * i, " ".join(w2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component for r in simhash.near_duplicates(docs, similarity=0.8).collect()}
    assert [i for i in range(2000, 2120, 2) if got[i] != got[i + 1]] == []


def test_similarity_is_exact_at_its_border(spark):
    """Sets of shingles just over and just under the similarity, far closer to it than an estimate could tell."""
    rng = random.Random(4)
    rows = []
    for i in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(364)]  # 360 shingles
        rows += [(10 * i, w), (10 * i + 1, w[40:] + [f"x{j}" for j in range(40)]), (10 * i + 1000, w[41:] + [f"y{j}" for j in range(41)])]
    docs = spark.createDataFrame([(a, " ".join(b)) for a, b in rows], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component for r in simhash.near_duplicates(docs.filter("doc_id % 10 < 2 AND doc_id < 1000"), similarity=0.8).collect()}
    assert got == {i: i // 10 * 10 for i in got}
    got = {r.doc_id: r.component for r in simhash.near_duplicates(docs.filter("doc_id % 10 = 0"), similarity=0.8).collect()}
    assert got == {i: i for i in got}
