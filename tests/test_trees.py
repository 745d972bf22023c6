import os

import pytest
from pyspark.sql import functions as F

from tarnloom import config, plans, queries
from tarnloom.functions import keys
from tarnloom.operators import bulk, lookup, similar, submit, sync, tree
from tarnloom.sources import dump, fixtures, store
from tarnloom.sources.similarity import SimilarityIndex
from tarnloom.sources.store import Registry
from tarnloom.streaming import publisher


def entries(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "key string")
    return rows.select(keys.partition_id(F.col("key"), 3).alias("partition_id"), "key", F.sha2("key", 256).alias("content_hash"), F.length("key").cast("long").alias("size"), F.timestamp_millis(F.lit(1)).alias("created_at"), F.lit(None).cast("long").alias("content_code"))


def roots(nodes):
    return {r.name: r.root for r in tree.roots(nodes).collect()}


def kept(nodes):
    return nodes.sparkSession.createDataFrame(nodes.collect(), nodes.schema)


def test_batches_make_the_bulk_tree(spark):
    """Whatever the cuts: into new partitions, into leaves that split, and one entry alone."""
    names = [f"k{i}" for i in range(300)]
    whole, _ = bulk.build(entries(spark, names), 4)
    nodes, _ = bulk.build(entries(spark, names[:0]), 4)
    for a, b in ((0, 1), (1, 40), (40, 41), (41, 300), (10, 90)):
        nodes = kept(tree.updated(nodes, tree.insert(nodes, entries(spark, names[a:b]), 4)))
    assert sorted(map(str, nodes.collect())) == sorted(map(str, whole.select(*nodes.columns).collect()))
    assert nodes.agg(F.max("depth")).first()[0] >= 1


def test_an_insert_changes_the_paths_of_its_keys_alone(spark):
    names = [f"k{i}" for i in range(200)]
    nodes, _ = bulk.build(entries(spark, names), 4)
    changed = tree.insert(nodes, entries(spark, ["one more"]), 4).collect()
    path = {r.prefix for r in changed}
    assert len({r.partition_id for r in changed}) == 1 and "" in path and len(path) <= 4
    assert tree.insert(nodes, entries(spark, names[:50]), 4).count() == 0
    assert tree.insert(nodes, entries(spark, names[:0]), 4).count() == 0


def test_denied_keys_are_in_no_tree(spark):
    denied = spark.createDataFrame([("blocked",), ("blocked",)], "key string")
    both = entries(spark, ["ok1", "blocked", "ok2"])
    assert roots(bulk.build(both, 2, denied)[0]) == roots(bulk.build(entries(spark, ["ok1", "ok2"]), 2)[0])
    nodes, _ = bulk.build(entries(spark, ["ok1"]), 2)
    assert roots(tree.updated(nodes, tree.insert(nodes, both, 2, denied))) == roots(bulk.build(entries(spark, ["ok1", "ok2"]), 2)[0])


def test_scan_notes_what_it_cannot_read(spark):
    nodes, _ = bulk.build(entries(spark, [f"k{i}" for i in range(100)]), 4)
    found, complete = tree.scanned(nodes)
    assert found.count() == 100 and complete.filter("NOT complete").count() == 0
    rows = [r.key for r in found.filter("partition_id = 1").collect()]
    assert rows == sorted(rows)
    found, complete = tree.scanned(nodes, nodes.filter("partition_id <> 1 OR depth > 0"))
    assert found.filter("partition_id = 1").count() == 0
    assert {r.partition_id: r.complete for r in complete.collect()} == {0: True, 1: False, 2: True}


def at():
    return F.timestamp_millis(F.lit(1_700_000_000_000))


def test_registry_publishes_tree_roots(spark, tmp_path):
    rows = dump.generated(spark, 60)
    registry = Registry(spark, f"file://{tmp_path}/r", limit=2)
    registry.submit(rows.filter("seq < 30"), 1, at())
    assert registry.publish(2, at(), most=10) == 10 and registry.pending().count() == 20
    assert registry.publish(3, at(), most=50) == 20 and registry.pending().count() == 0
    registry.submit(rows, 4, at())
    assert registry.pending().count() == 30 == registry.queue().count()
    assert registry.publish(5, at()) == 30
    published = registry.records().filter("status = 'published'")
    want = {r.name: r.root for r in bulk.build(published, 2)[1].collect()}
    assert {r.name: r.root for r in sync.latest_roots(registry.root_log()).collect()} == want
    name = next(iter(want))
    assert store.wait_for_root(registry.root_log, name, 5) == want[name]
    with pytest.raises(TimeoutError):
        store.wait_for_root(registry.root_log, "partition/none", 0.1, 0.05)
    state = sorted(map(str, registry.nodes().collect()))
    registry.publish(5, at())  # a replay
    assert sorted(map(str, registry.nodes().collect())) == state


def test_requests(spark, tmp_path):
    registry = Registry(spark, f"file://{tmp_path}/r")
    key = "f01551220" + "ab" * 32
    assert registry.submit_one(1, key, '{"a":1}', 1, at()).first().outcome == "queued"
    assert registry.submit_one(2, key, '{"a":2}', 2, at()).first().outcome == "conflict"
    assert registry.submit_one(3, "no key", '{"a":2}', 3, at()).first().error == "invalid_key"
    with pytest.raises(ValueError):
        registry.submit_batch(dump.generated(spark, 11), 4, at(), most=10)
    assert registry.submit_batch(dump.generated(spark, 10), 4, at(), most=10).count() == 10


def test_follower(spark, tmp_path):
    rows = dump.generated(spark, 40)
    registry, state = Registry(spark, f"file://{tmp_path}/r", limit=2), f"file://{tmp_path}/state"
    registry.submit(rows.filter("seq < 20"), 1, at())
    registry.publish(2, at())
    publisher.follow(registry, f"{tmp_path}/cp", state, at=at()).awaitTermination()
    seen = lambda: {r.partition_id: (r.root, r.records, r.stale_error) for r in publisher.synced(spark, state).collect()}
    count = lambda: {r.partition_id: r["count"] for r in registry.records().filter("status = 'published'").groupBy("partition_id").count().collect()}
    assert {k: v[1] for k, v in seen().items()} == count() and all(v[2] is None for v in seen().values())
    before = seen()
    registry.submit(rows, 3, at())
    registry.publish(4, at())
    nodes = registry.nodes()
    assert publisher.sync_pass(registry, state, 1, at(), nodes.limit(0)) > 0  # nothing can be read: the old state is kept
    assert {k: v[:2] for k, v in seen().items() if k in before} == {k: v[:2] for k, v in before.items()}
    assert "incomplete" in {v[2] for v in seen().values()}
    publisher.follow(registry, f"{tmp_path}/cp", state, at=at()).awaitTermination()
    assert {k: v[1] for k, v in seen().items()} == count() and all(v[2] is None for v in seen().values())
    assert publisher.sync_pass(registry, state, 1, at()) == 0
    assert [p for p in os.listdir(tmp_path) if p.startswith("state.")] == []


def test_similarity_index(spark, tmp_path):
    rows = spark.range(400).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.xxhash64(F.col("id") % 350).alias("content_code"))
    near = rows.filter("length(key) = 3").select(F.concat("key", F.lit("n")).alias("key"), F.col("content_code").bitwiseXOR(F.lit(5)).alias("content_code"))
    every = rows.unionByName(near)
    index = SimilarityIndex(spark, f"file://{tmp_path}/i", bands=4)
    assert index.members().count() == 0
    index.add(rows, 1)
    index.add(every, 2)
    index.add(every, 2)  # a replay
    assert index.members().count() == 4 * every.count() and index.members(1).count() == 4 * rows.count()
    queries = near.select(F.col("key").alias("query_key"), F.col("content_code").alias("query_code"))
    got = sorted(map(str, index.search(queries, 7).collect()))
    want = similar.brute_force(queries, every, 7).select("query_key", "key", "query_code", "content_code", "distance")
    assert got == sorted(map(str, want.collect())) and len(got) >= 180
    assert index.segments().agg(F.sum("members")).first()[0] == 4 * every.count()
    assert index.marks().count() > index.segments().select("hash").distinct().count()


def test_bands_follow_the_number_of_entries():
    assert plans.bands_for(1000, 7) >= plans.bands_for(10**9, 7)
    assert plans.hamming_plan(10, 10**6, 7) == "brute" and plans.hamming_plan(10**6, 10**9, 7) == "bands"


def test_brute_force_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(similar, "MOST_QUERIES", 2)
    rows = spark.range(3).select(F.col("id").cast("string").alias("query_key"), F.col("id").alias("query_code"))
    with pytest.raises(ValueError):
        similar.brute_force(rows, rows.toDF("key", "content_code"), 1)


def test_overwriting_and_rebuilding(spark, tmp_path):
    records = spark.createDataFrame([(1, "a", "v", "h1", 1, 0, "pending", None, None, None), (2, "b", "v", "h2", 1, 1, "pending", None, None, None)], "seq long, key string, value string, content_hash string, size long, partition_id int, status string, created_at timestamp, content_code long, published_at timestamp")
    incoming = records.filter("seq = 1").withColumn("content_hash", F.lit("new")).unionByName(records.filter("seq = 1").withColumns({"seq": F.lit(0).cast("long"), "content_hash": F.lit("older")}))
    got = {r.key: (r.content_hash, r.status) for r in bulk.mark_published(records, incoming, at()).collect()}
    assert got == {"a": ("new", "published"), "b": ("h2", "pending")}
    done = records.withColumns({"status": F.lit("published"), "created_at": at()})
    lines = spark.createDataFrame([(1, "a", '{"timestamp":1500000000000}', None), (2, "x", '{"timestamp":5}', None), (3, "b", "{}", None)], "seq long, key string, value string, error string")
    out, new_roots, counts = bulk.rebuilt(spark, done, lines, f"file://{tmp_path}/spill")
    assert {r.key: r.t for r in out.select("key", F.unix_millis("created_at").alias("t")).collect()} == {"a": 1500000000000, "b": 1700000000000}
    assert {r.root for r in new_roots.collect()} == {r.root for r in bulk.build(out)[1].collect()}
    assert counts.first().asDict() == {"lines": 3, "updated": 1, "missing": 1, "no_timestamp": 1}


def test_numbers_in_order_without_one_task(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("seq"), F.lit("k").alias("key"), F.lit("queued").alias("outcome")).repartition(5)
    got = submit.enqueue(rows, 100).orderBy("queue_seq").collect()
    assert [r.queue_seq for r in got] == list(range(100, 1100))
    assert submit.enqueue(rows.limit(0), 1).count() == 0


def test_narrowed_index(spark, monkeypatch):
    index = spark.createDataFrame([(i % 4, f"k{i}", i) for i in range(100)], "partition_id int, key string, n int")
    batch = spark.createDataFrame([(1, "k1"), (1, "k1"), (2, "k2"), (3, "none")], "partition_id int, key string")
    for most in (1, 100):
        monkeypatch.setattr(lookup, "MOST_KEYS", most)
        assert sorted(r.n for r in lookup.narrowed(index, batch).collect()) == [1, 2]


def test_listing_rows(spark):
    df, n = lookup.warm(spark.createDataFrame([(1, "a", None), (2, "b", 5)], "partition_id int, key string, content_code long"))
    assert n == 2 and lookup.cached_or(df, "r", "r", lambda: None) is df and lookup.cached_or(df, "r", "s", lambda: 1) == 1
    assert [r.line for r in lookup.json_rows(lookup.listing(df)).collect()] == ['{"partition_id":1,"key":"a","code":"-"}', '{"partition_id":2,"key":"b","code":"0x0000000000000005"}']
    df.unpersist()


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('max_batch = 7\nhash_algorithm = "blake3"\nauto_sync = false\n')
    assert config.load(None, {}) == config.Config()
    got = config.load(str(path), {"TARNLOOM_MAX_BATCH": "9", "OTHER": "x"})
    assert (got.max_batch, got.hash_algorithm, got.auto_sync, got.bands) == (9, "blake3", False, 8)
    for text in ("max_batch = true", "no_such = 1", 'bands = "x"'):
        path.write_text(text)
        with pytest.raises(ValueError):
            config.load(str(path), {})


def counted(df):
    """df, and an accumulator of the rows that were computed for it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_trees_read_their_entries_once(spark):
    """tree_insert_batch: not once a level and use (a checkpoint may compute what it writes twice)."""
    names = [f"k{i}" for i in range(2000)]
    first, seen = counted(entries(spark, names[:1500]))
    nodes = bulk.build(first, 2)[0]
    assert nodes.agg(F.max("depth")).first()[0] >= 2 and seen.value <= 2 * 1500
    more, seen = counted(entries(spark, names[1000:]))
    nodes = tree.updated(nodes, tree.insert(nodes, more, 2))
    assert nodes.count() and nodes.count() and seen.value <= 2 * 1000
    assert roots(nodes) == roots(bulk.build(entries(spark, names), 2)[0])


def test_a_denylist_is_read_once_an_insert(spark):
    """tree_insert_denied: nor are its keys joined again for each level."""
    names = [f"k{i}" for i in range(1000)]
    denied, seen = counted(entries(spark, names[::5]).select("key"))
    nodes = bulk.build(entries(spark, names[:600]), 2, denied)[0]
    nodes = tree.updated(nodes, tree.insert(nodes, entries(spark, names), 2, denied))
    kept_names = [n for i, n in enumerate(names) if i % 5]
    assert roots(nodes) == roots(bulk.build(entries(spark, kept_names), 2)[0]) and seen.value <= 2 * 2 * 200


def test_grown_trees_read_the_events_once(spark, monkeypatch):
    """tree_insert_denied: not once for each batch and each denylist."""
    d = "/root/testdata/sf0.001"
    events, seen = counted(fixtures.submissions(spark, d))
    want = queries._entries(spark, d).filter("seq % 5 <> 0")
    monkeypatch.setattr(fixtures, "submissions", lambda *_: events)
    got = {(r.name, r.root) for r in queries.tree_insert_denied(spark, d).collect()}
    n = fixtures.table(spark, d, "events").count()
    # the first writes are joined back, so events are read on both sides
    assert n and seen.value <= 2 * 2 * n
    assert got == {(r.name, r.root) for r in bulk.build(want, 2)[1].collect()}
