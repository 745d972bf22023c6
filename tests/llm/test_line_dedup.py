import collections

from pyspark.sql import functions as F

from tarnloom.llm import line_dedup

WS = " \t\n\x0b\x0c\r"


def brute(texts, least, min_chars=1):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WS))
    found = collections.Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or found[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_against_brute_force(spark):
    texts = [f"Head er\n  shared LINE\t\n\nown {i}\n{'Ünï' if i % 2 else 'ünï'}\nrare{i % 7}" for i in range(12)] + [None, "", "\n", "shared line\nshared line\x85", "x" * 50000 + "\nSHARED line"]
    for least, min_chars, fanout in ((10, 1, 3), (2, 4, 2), (1, 1, 2)):
        rows = [(i, t, "n", 1) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, hits int").repartition(3)
        out = line_dedup.drop_frequent_lines(df, least, min_chars, batches=5, fanout=fanout)
        assert out.columns == ["doc_id", "text", "hits", "n_lines", "n_dropped"]
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out.collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, least, min_chars)


def test_repeated_and_null_ids(spark):
    texts = ["a\nb", "a\nc", "a\nd", "d\na"]
    df = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3])], "doc_id long, text string")
    got = sorted(r.text for r in line_dedup.drop_frequent_lines(df, 4).collect())
    assert got == ["b", "c", "d", "d"]
    assert line_dedup.drop_frequent_lines(df.limit(0), 4).count() == 0


def test_one_text_under_many_ids(spark):
    """A third of the rows has no id, and many rows one text."""
    texts = ["a\nb"] * 30 + [f"own {i}\na" for i in range(30)] + [None, ""]
    rows = [(None if i % 3 == 0 else i % 5, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_frequent_lines(df, 30).collect())
    assert got == sorted(brute(texts, 30))


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    for _ in range(5):
        runs.add(spark.createDataFrame([(bytearray(b"k"), 1), (bytearray(b"big"), 3)], line_dedup.RUN))
    assert all(len(level) < 2 for level in runs.levels) and len(runs.levels) == 3
    total = {bytes(r.h): r.n for r in runs.merged(runs.runs()).collect()}
    assert total == {b"k": 4, b"big": 3}  # once a run proves them frequent they are counted no more
    assert {bytes(r.h) for r in runs.frequent().collect()} == {b"k", b"big"}
    runs.close()
    assert not runs.runs()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_merged_in_their_buckets(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=9)
    for x in range(3):
        runs.add(spark.createDataFrame([(bytearray(b"%d" % (x + i)), i) for i in range(200)], line_dedup.RUN))
    two = plan(runs.merged(runs.runs()[:2]))
    assert "Exchange" not in two and two.count("SortMergeJoin") == 1
    batch = spark.createDataFrame([(bytearray(b"k"), 1)], line_dedup.RUN).groupBy("h").agg({"n": "sum"})
    anti = plan(runs.unknown(batch))
    assert anti.count("LeftAnti") == 3 and "Broadcast" not in anti and anti.count("Exchange hash") == 1
    runs.close()


def test_hits_are_merged_at_any_size(spark):
    """A plan that changes with the number of hits makes what is shuffled jump, from none of the texts to all of them."""
    df = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("same\nown "), "id").alias("text"))
    out = line_dedup.drop_frequent_lines(df, 10)
    assert "BroadcastHashJoin" not in plan(out) and plan(out).count("SortMergeJoin") == 1
    assert sorted(r.text for r in out.collect()) == sorted(f"own {i}" for i in range(20))
