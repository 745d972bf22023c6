import numpy as np

from tarnloom.llm import ann


def brute(rows, k=20):
    """rows: (id, vector or None); the k nearest of each query, by sequential double sums."""
    fine = [(i, v) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    ids, x = np.array([i for i, _ in fine]), np.array([v for _, v in fine], np.float64)
    out = {}
    for i, v in fine:
        if i % 20 == 0:
            s = np.zeros(len(x))
            for d in range(x.shape[1]):  # in the order of the components, so that equal vectors have equal scores
                s = s + float(v[d]) * x[:, d]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out.setdefault(i, []).extend((int(ids[j]), float(s[j])) for j in order)
    return out


def test_chi_square():
    assert abs(ann.chi_square_cdf(15.507, 8) - 0.95) < 1e-4
    assert abs(ann.chi_square_point(0.95, 8) - 15.507) < 1e-2


def test_hard_rows_and_ties(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((30, 8)).astype(np.float32).tolist()
    rows = [(i, base[i % 30]) for i in range(400)]  # every vector many times
    rows += [(400, None), (420, [0.0] * 8), (440, [1.0] * 7 + [None]), (460, [float("nan")] * 8), (480, [1.0] * 3), (None, base[0]), (500, (np.array(base[3]) * 2).tolist())]
    df = spark.createDataFrame(rows + rows[:5], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, lambda i: i % 20 == 0, block_rows=16, chunk=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute([(i, v) for i, v in rows if v is None or len(v) == 8])
    assert got == want


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:4] for r in ann.nearest(df, lambda i: i % 20 == 0).collect()] == [(0, 1, 1, 4.0)]
    assert ann.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0
    assert ann.nearest(df.filter("vec_id = 0"), lambda i: i % 20 == 0).count() == 0


def found(df, **kw):
    got, work = {}, {}
    for r in ann.nearest(df, lambda i: i % 20 == 0, **kw).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        work[r.query_id] = r.verified
    return got, work


def recall(got, want):
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    return np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want])


def test_clustered_vectors_verify_few(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 32))
    x = centres[rng.integers(0, 60, 6000)] + 0.3 * rng.standard_normal((6000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, work = found(df, block_rows=512)
    assert recall(got, brute(rows)) >= 0.9
    assert np.mean(list(work.values())) <= 0.2 * len(rows)


def test_the_stopping_test_stops_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    got, work = found(df)
    assert recall(got, brute(rows)) >= 0.9
    assert np.mean(list(work.values())) <= 0.6 * len(rows)


def test_cells_of_several_blocks(spark, monkeypatch):
    """With few cells each has many blocks: none is larger than asked, and nothing is lost."""
    monkeypatch.setattr(ann, "MOST_CELLS", 2)
    rng = np.random.default_rng(3)
    rows = list(enumerate(rng.standard_normal((500, 12)).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, _ = found(df, block_rows=40, confidence=0.9999)
    assert recall(got, brute(rows)) >= 0.99


def test_ties_at_the_border_go_to_the_smaller_id(spark):
    """A hundred different vectors with the very same product."""
    rows = [(0, [1.0, 0.0])] + [(i, [0.5, float(101 - i)]) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, lambda i: i == 0, confidence=1 - 1e-12).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21))
