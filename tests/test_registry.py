import gzip
import random

import pytest
from pyspark.sql import functions as F

from tarnloom import plans
from tarnloom.functions import codes
from tarnloom.operators import audit, bulk, lookup, similar, submit, summary, sync, tree
from tarnloom.sources import dump, fixtures
from tarnloom.sources.similarity import SimilarityIndex
from tarnloom.sources.store import Registry
from tarnloom.streaming import publisher


def at():
    """A fixed time."""
    return F.timestamp_seconds(F.lit(1000))


def entries(spark, n, limit_code=None):
    df = dump.generated(spark, n)
    return fixtures.with_partition(df.select("seq", "key", F.sha2("value", 256).alias("content_hash"), F.lit(5).cast("long").alias("size"), at().alias("created_at"), F.lit(limit_code).cast("long").alias("content_code")))


def test_batch_outcomes(spark):
    rows = spark.createDataFrame([(1, "x", "h1"), (2, "y", "h2"), (3, "x", "h1"), (4, "x", "h3"), (5, "z", "h9")], "seq long, key string, content_hash string")
    index = spark.createDataFrame([("z", "h0")], "key string, content_hash string")
    got = {r.seq: (r.outcome, r.existing_hash) for r in submit.classify(rows, index).collect()}
    assert got == {1: ("queued", None), 2: ("queued", None), 3: ("duplicate", "h1"), 4: ("conflict", "h1"), 5: ("conflict", "h0")}
    assert [tuple(r) for r in submit.enqueue(submit.classify(rows, index), 7).collect()] == [(7, "x"), (8, "y")]
    assert submit.classify(rows.limit(0), index).count() == 0
    with pytest.raises(ValueError):
        submit.check_batch(501)


def test_dump_lines(spark, tmp_path):
    lines = [f'{{"key":"k{i}","value":{{"b":{i},"a":1}}}}' for i in range(50)]
    text = "\n\n".join(lines[:10]) + "\n  \nnot json\n" + "\n".join(lines[10:]) + '\n{"key":5,"value":{}}\n{"key":"s","value":"{\\"q\\":  1}"}\n'
    with open(f"{tmp_path}/a.json.gz", "wb") as f:  # two members
        f.write(gzip.compress(text[:300].encode()) + gzip.compress(text[300:].encode()))
    with open(f"{tmp_path}/b.json", "w") as f:
        f.write(text)
    for name in ("a.json.gz", "b.json"):
        got = dump.read_dump(spark, f"{tmp_path}/{name}").orderBy("seq").collect()
        assert [r.seq for r in got] == list(range(1, 54))
        assert got[10].error == "bad_json" and got[51].error == "bad_json" and got[52].value == '{"q":  1}' and got[0].value == '{"a":1,"b":0}'
        some = dump.lines(spark, f"{tmp_path}/{name}", 5, 8).orderBy("ordinal").collect()
        assert [r.ordinal for r in some] == list(range(6, 14))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert [r.line for r in dump.lines(spark, f"{tmp_path}/b.json").orderBy("ordinal").collect()] == [x for x in text.split("\n") if x.strip()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_denylist(spark, tmp_path):
    (tmp_path / "deny").write_text("# no\n\n  a \nb\na\n")
    assert sorted(r.key for r in dump.denylist(spark, f"{tmp_path}/deny").collect()) == ["a", "b"]
    assert dump.denylist(spark, f"{tmp_path}/none").count() == 0


def test_bulk_ingest_and_retimestamp(spark, tmp_path):
    k = ["f01551220" + f"{i:02x}" * 32 for i in range(4)]
    lines = [f'{{"key":"{k[0]}","value":{{"timestamp":1000}}}}', f'{{"key":"{k[1]}","value":{{"v":1}}}}', f'{{"key":"{k[0]}","value":{{"timestamp":1000}}}}', f'{{"key":"{k[0]}","value":{{"timestamp":2000}}}}', "junk", '{"key":"bad","value":{}}', f'{{"key":"{k[2]}","value":[]}}']
    (tmp_path / "d.json").write_text("\n".join(lines))
    records, rejects, counts = bulk.ingest(spark, f"{tmp_path}/d.json", ingested_at=at())
    assert counts.first().asDict() == {"lines_read": 7, "new_records": 2, "duplicates": 1, "conflicts": 1, "invalid": 3}
    assert sorted((r.seq, r.error) for r in rejects.collect()) == [(5, "bad_json"), (6, "invalid_key"), (7, "bad_value")]
    assert {r.key: r.created_at.timestamp() for r in records.collect()} == {k[0]: 1.0, k[1]: 1000.0}
    again, c = bulk.retimestamp(records, dump.read_dump(spark, f"{tmp_path}/d.json"))
    assert c.first().asDict() == {"lines": 7, "updated": 3, "missing": 0, "no_timestamp": 2}
    assert {r.key: r.created_at.timestamp() for r in again.collect()}[k[0]] == 2.0


def test_tree_is_the_same_whatever_the_order(spark):
    rows = entries(spark, 300)
    nodes, roots = bulk.build(rows, 4)
    other = bulk.build(rows.orderBy(F.rand(3)).repartition(5), 4)[1]
    assert sorted(map(tuple, roots.collect())) == sorted(map(tuple, other.collect()))
    assert nodes.filter("kind = 'leaf'").count() and nodes.agg(F.max("depth")).first()[0] <= 2
    changed = rows.withColumn("content_hash", F.when(F.col("seq") == 7, F.lit("0")).otherwise(F.col("content_hash")))
    assert len({*map(tuple, bulk.build(changed, 4)[1].collect())} - {*map(tuple, roots.collect())}) == 1
    for r in nodes.limit(20).collect():
        kind, parts = tree.decoded(r.bytes)
        assert kind == r.kind and parts
    for bad in ("", "X\na", "L\na\tb", "I\nzz"):
        if bad != "":
            with pytest.raises(ValueError):
                tree.decoded(bad)


def test_tree_shape_limits(spark):
    rows = entries(spark, 200).withColumn("partition_id", F.lit(1))
    shape = tree.shape(rows, 3).collect()
    assert sum(r.n_entries for r in shape if r.kind == "leaf") == 200
    assert all(r.n_entries <= 3 for r in shape if r.kind == "leaf") and all(r.n_entries > 3 for r in shape if r.kind == "intermediate")
    assert tree.shape(rows.limit(0), 3).count() == 0


def test_hamming_join_is_brute_force(spark):
    rng = random.Random(42)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(24))) for x in base]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    left = spark.createDataFrame([(f"q{i}", signed(x)) for i, x in enumerate(base)] + [("twin", signed(base[0])), ("none", None)], "query_key string, query_code long")
    right = spark.createDataFrame([(f"e{i}", signed(x)) for i, x in enumerate(near)] + [("e0", signed(near[0])), ("n", None)], "key string, content_code long").distinct()
    pairs = lambda df: sorted(tuple(r) for r in df.select("query_key", "key", F.col("distance").cast("int")).collect())
    for radius in (0, 3, 7, 8, 15, 16, 20):
        assert pairs(similar.hamming_join(left, right, radius)) == pairs(similar.brute_force(left, right, radius))


def test_verified_keeps_the_nearest_code(spark):
    c = spark.createDataFrame([("a", 5, 3), ("a", 9, 3), ("a", 1, 7), ("b", 2, 0), ("c", 2, 9)], "key string, content_code long, distance int")
    assert [tuple(r) for r in similar.verified(c, 8).collect()] == [("b", 2, 0), ("a", 5, 3)]
    with pytest.raises(ValueError):
        similar.check_radius(17)


def test_banded_search_and_probe(spark):
    code = 0x0123456789ABCDEF
    spread = code ^ sum(1 << (8 * i) for i in range(8))
    df = spark.createDataFrame([("same", code), ("near", code ^ 3), ("spread", spread), ("far", ~code)], "key string, content_code long").withColumn("partition_id", F.lit(0))
    assert [r.key for r in similar.banded(df, code, 16, 0).collect()] == ["same", "near"]
    assert [r.key for r in similar.banded(df, code, 16, 1).collect()] == ["same", "near", "spread"]
    assert [r.key for r in similar.exact(df, code, 99, 2).collect()] == ["same", "near"]


def test_reads(spark):
    rows = entries(spark, 100).withColumn("status", F.lit("published"))
    key = rows.orderBy("key").first().key
    assert lookup.get(rows, key).count() == 1
    assert lookup.found(rows, "nothing").first().found is False
    assert lookup.page(rows, 0, 0).count() == 0 and lookup.page_count(10, 0) == 10 and lookup.page_count(10, 4) == 3
    with pytest.raises(ValueError):
        lookup.page(rows, 0, 1, 256)
    wanted = spark.createDataFrame([(2, key), (1, "no"), (3, key)], "pos int, key string")
    assert [(r.pos, r.found) for r in lookup.get_many(wanted, rows).collect()] == [(1, False), (2, True), (3, True)]
    assert [r.code for r in lookup.listing(rows, most=2).collect()] == ["-", "-"]


def test_summary_of_nothing(spark):
    r = summary.summary(entries(spark, 5).limit(0)).first()
    assert (r.total, r.readable, r.empty, r.estimate, r.code_percent) == (0, 0, 256, 0, 0.0)


def test_garbage_needs_a_snapshot(spark):
    blobs = spark.createDataFrame([("a",), ("b",)], "hash string")
    live = blobs.filter("hash = 'a'")
    assert [r.hash for r in audit.collect_garbage(blobs, live, 3, False).collect()] == ["b"]
    for snapshot, writing in ((None, False), (3, True)):
        with pytest.raises(RuntimeError):
            audit.collect_garbage(blobs, live, snapshot, writing)


def test_named_roots(spark):
    log = spark.createDataFrame([("a", "0" * 64, 1), ("a", "1" * 64, 2), ("b", "short", 1)], "name string, root string, version long")
    assert sync.named_root(log, "a").first().root == "1" * 64
    assert sync.named_root(log, "c").count() == 0
    with pytest.raises(Exception, match="not a hash"):
        sync.named_root(log, "b").collect()
    nodes = bulk.build(entries(spark, 3), 4)[0]
    good = nodes.first().node_hash
    assert sync.set_root(log, "a", good, nodes, 3).first().root == good
    with pytest.raises(ValueError):
        sync.set_root(log, "a", "f" * 64, nodes, 3)


def test_due():
    assert sync.due(1000, 0) and sync.due(1, 30) and not sync.due(0, 99) and not sync.due(999, 29)


def test_registry_replays_and_survives_half_batches(spark, tmp_path):
    rows = dump.generated(spark, 40)
    registry = Registry(spark, f"file://{tmp_path}/r")
    assert registry.committed() is None and registry.records().count() == 0
    first = registry.submit(rows, 1, at()).groupBy("outcome").count().collect()
    assert [tuple(r) for r in first] == [("queued", 40)]
    denied = rows.filter("seq < 5").select("key")
    assert registry.publish(2, at(), denied) == 40
    state = sorted(map(str, registry.records().collect()))
    registry.publish(2, at(), denied)  # again
    assert sorted(map(str, registry.records().collect())) == state
    again = registry.submit(rows, 3, at())
    assert {r.outcome for r in again.collect()} == {"duplicate"}
    assert registry.records().groupBy("status").count().orderBy("status").collect()[0]["count"] == 5
    # what a failed batch has written isn't seen until its version is committed
    registry._write(registry.records(), "records", 9, True)
    assert registry.records().count() == 40 and registry.committed() == 3
    assert registry.root_log().count() == len({r.partition_id for r in registry.records().filter("status = 'published'").collect()})


def test_compaction_changes_nothing_that_is_read(spark, tmp_path):
    rows = dump.generated(spark, 20)
    registry = Registry(spark, f"file://{tmp_path}/r", folders=True)
    registry.submit(rows.filter("seq < 10"), 1, at())
    registry.publish(2, at())
    registry.submit(rows, 3, at())
    state = sorted(map(str, registry.records().collect()))
    registry.compact(4)
    assert sorted(map(str, registry.records().collect())) == state and registry.committed() == 4
    assert [p.name for p in (tmp_path / "r/records").iterdir() if p.name.startswith("version")] == ["version=4"]
    assert registry.publish(5, at()) == 10


def test_stream_equals_batch(spark, tmp_path):
    rows = dump.generated(spark, 30)
    rows.filter("seq < 20").coalesce(1).write.json(f"{tmp_path}/in")
    registry = Registry(spark, f"file://{tmp_path}/stream")
    landed = lambda: publisher.landed(spark, f"{tmp_path}/in")
    publisher.run(registry, landed(), f"{tmp_path}/cp", drain=True, at=at()).awaitTermination()
    rows.filter("seq >= 15").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    publisher.run(registry, landed(), f"{tmp_path}/cp", drain=True, at=at()).awaitTermination()
    batch = Registry(spark, f"file://{tmp_path}/batch")
    batch.submit(rows, 1, at())
    batch.publish(2, at())
    fields = ("key", "content_hash", "status", "partition_id")
    assert sorted(map(str, registry.records().select(*fields).collect())) == sorted(map(str, batch.records().select(*fields).collect()))
    publisher.watch(spark, f"{tmp_path}/stream", f"{tmp_path}/cp2", f"{tmp_path}/seen").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/seen").count() == registry.root_log().count()


def test_codes_from_submission_reach_the_records(spark, tmp_path):
    key = "f01551220" + "ab" * 32
    rows = spark.createDataFrame([(1, key, '{"iscc":"ISCC:EAAQCAIBABYAEAQE"}')], "seq long, key string, value string")
    registry = Registry(spark, f"file://{tmp_path}/r")
    registry.submit(rows, 1, at())
    r = registry.records().select(codes.shown(F.col("content_code")).alias("c")).first()
    assert r.c == "0x0101010070020204"
    assert lookup.with_values(registry.records(), registry.blobs()).first().value == '{"iscc":"ISCC:EAAQCAIBABYAEAQE"}'


def _codes(n: int, salt: int, spread: int = 64):
    """Codes of `spread` random bits, every tenth a near copy of the one before it, some repeated and some null."""
    rng = random.Random(salt)
    out = []
    for i in range(n):
        x = rng.getrandbits(spread) if i % 10 or not out else out[-1] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(16)))
        out.append(out[i // 2] if i % 37 == 36 else x)
    return [x - (1 << 64) if x >= 1 << 63 else x for x in out]


def _sides(spark, n: int, spread: int = 64):
    left = spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(_codes(n, 1, spread))] + [("none", None)], "query_key string, query_code long")
    right = spark.createDataFrame([(f"e{i}", x) for i, x in enumerate(_codes(n, 1, spread)[: n // 2] + _codes(n, 2, spread))] + [("n", None)], "key string, content_code long")
    return left, right


def _found(df):
    return sorted(tuple(r) for r in df.select("query_key", "key", "query_code", "content_code", "distance").collect())


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize(("spread", "radius", "work"), [(64, 15, 10_000), (12, 2, 100_000)])
def test_candidates_are_compared_in_blocks(spark, monkeypatch, spread, radius, work):
    """hamming_pairs_banded: no row a candidate pair; also where one bucket holds most members, blocks are many and short."""
    left, right = _sides(spark, 200, spread)
    want = _found(similar.brute_force(left, right, radius))
    df = similar.hamming_join(left, right, radius, probe=1)
    assert _found(df) == want and len(want) > 100
    assert "bit_count" not in _plan(df) and "MapInArrow" in _plan(df)
    for name, value in (("BLOCK", 16), ("SLAB", 64), ("FLUSH", 8), ("TASK_WORK", work)):
        monkeypatch.setattr(similar, name, value)
    df = similar.hamming_join(left, right, radius, probe=1)
    assert _found(df) == want and df.rdd.getNumPartitions() > 1
    assert _found(similar.hamming_join(left.limit(0), right, radius)) == []


def test_the_plan_does_not_multiply_queries_by_hundreds_of_masks(spark):
    """hamming_pairs_planned: from some 11,000 vectors four bands of 697 masks each were chosen, and broadcast."""
    assert all(plans.bands_for(n, 12) == 8 for n in (10_000, 20_000, 100_000, 1_000_000))
    assert all(len(codes.probe_masks(64 // b, codes.exact_probe(r, b))) <= plans.MOST_MASKS for r in (7, 12, 15) for n in (10**4, 10**9, 10**12) for b in [plans.bands_for(n, r)])
    rows = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"), F.xxhash64("id").alias("content_code"))
    df = similar.hamming_join(rows.toDF("query_key", "query_code"), rows, 12, 4)
    joins = [x for x in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in x and "band_index" in x]
    assert joins and not any("Broadcast" in x for x in joins)
    assert len(_found(df)) == similar.brute_force(rows.toDF("query_key", "query_code"), rows, 12).count()


def test_a_probe_makes_no_rows_of_candidates(spark):
    """probe_pairs_p1: only pairs that share a band but for one bit, each once."""
    left, right = _sides(spark, 150)
    df = similar.hamming_join(left, right, 22, probe=1)
    near = lambda a, b: any(((a ^ b) >> 8 * i & 255).bit_count() <= 1 for i in range(8))
    every = _found(similar.brute_force(left, right, 22))
    assert _found(df) == [r for r in every if near(r[2], r[3])] and len(every) > 150
    assert "bit_count" not in _plan(df)


def test_a_bucket_of_any_size_is_dealt_out(spark, monkeypatch):
    """banded_pairs_p0: members that share all their bands are many blocks, whose comparisons are shared by several tasks."""
    monkeypatch.setattr(similar, "BLOCK", 50)
    monkeypatch.setattr(similar, "TASK_WORK", 10_000)
    rows = spark.range(400).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 3).alias("content_code"))
    made = similar.blocks(similar.bands(rows)).select("band_index", F.size("keys").alias("n")).collect()
    assert max(r.n for r in made) <= 50 and sum(r.n for r in made) == 8 * 400
    df = similar.hamming_join(rows.toDF("query_key", "query_code"), rows, 24, probe=0)
    sizes = df.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 400 * 400 and max(r["count"] for r in sizes) < 400 * 400 / 4


def test_index_search_compares_stored_buckets_in_blocks(spark, tmp_path):
    """index_search: the stored band table is packed as it is."""
    left, right = _sides(spark, 150)
    index = SimilarityIndex(spark, f"file://{tmp_path}/i")
    index.add(right, 1)
    df = index.search(left, 15)
    assert _found(df) == _found(similar.brute_force(left, right, 15))
    assert "bit_count" not in _plan(df)


@pytest.mark.parametrize(("radius", "probe"), [(22, 1), (24, 0)])
def test_comparisons_are_dealt_to_all_cores(spark, radius, probe):
    """probe_pairs_p1, banded_pairs_p0: over 10 million comparisons at a wide radius make 5 million rows, too many for one task."""
    codes_ = sum(F.shiftleft(F.shiftright(F.xxhash64("id"), 2 * i).bitwiseAND(F.lit(3)), 8 * i) for i in range(8))
    rows = spark.range(2400).select(F.concat(F.lit("k"), "id").alias("key"), codes_.alias("content_code"))
    df = similar.hamming_join(rows.toDF("query_key", "query_code"), rows, radius, probe=probe)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    x = F.col("query_code").bitwiseXOR(F.col("content_code"))
    share = [F.bit_count(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255))) <= probe for i in range(8)]
    want = rows.toDF("query_key", "query_code").crossJoin(rows).filter(F.greatest(*share) & (F.bit_count(x) <= radius))
    assert sum(sizes) == want.count() and len(sizes) >= 3 and max(sizes) < 0.7 * sum(sizes)


@pytest.mark.parametrize(("kinds", "radius", "probe"), [(4, 24, 0), (1, 2, 0), (1, 15, 1)])
def test_a_task_returns_few_pairs(spark, monkeypatch, kinds, radius, probe):
    """banded_pairs_p0: pairs cost more than comparisons, so tasks are counted and blocks are cut by pairs too; also where copies of
    one code are a whole block, and each comparison in their first band is a pair."""
    monkeypatch.setattr(similar, "LEAST_WORK", 1 << 60)  # not by cores
    code = sum(F.shiftleft(F.shiftright(F.xxhash64(F.col("id") % (2000 if kinds > 1 else 1)), 2 * i).bitwiseAND(F.lit(kinds - 1)), 8 * i) for i in range(8))
    rows = spark.range(2400).select(F.concat(F.lit("k"), "id").alias("key"), code.alias("content_code"))
    df = similar.hamming_join(rows.toDF("query_key", "query_code"), rows, radius, probe=probe)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    x = F.col("query_code").bitwiseXOR(F.col("content_code"))
    share = [F.bit_count(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255))) <= probe for i in range(8)]
    want = rows.toDF("query_key", "query_code").crossJoin(rows).filter(F.greatest(*share) & (F.bit_count(x) <= radius)).count()
    assert sum(sizes) == want > 4_000_000 and max(sizes) < 2_500_000
    assert df.distinct().count() == want
