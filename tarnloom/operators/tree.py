"""The tree that a snapshot's entries form, as tables: its shape, its nodes' bytes and hashes, its roots.

A node is a partition and a prefix of descent bytes. It is a leaf when its subtree holds `limit` entries or fewer; the
shape is that of a bulk build, which depends on the entries alone. insert() writes only the nodes on the paths of new
entries and reads only the leaves that they fall into; what it makes of a tree is what a bulk build makes of all entries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, keys, values
from ..lineage import cut
from ..schema import LEAF_LIMIT

DEPTH_LIMIT = 31
#: A node's columns.
NODE = ("partition_id", "depth", "prefix", "kind", "node_hash", "bytes")


def placed(entries: DataFrame) -> DataFrame:
    """entries plus path: the digest after its first byte, two hex digits a level."""
    return entries.withColumn("path", F.substring(keys.digest(F.col("key")), 3, 62))


def prefix_counts(entries: DataFrame, depth: int) -> DataFrame:
    return placed(entries).groupBy("partition_id", F.left("path", F.lit(2 * depth)).alias("prefix")).agg(F.count("*").alias("n_entries"))


def shape(entries: DataFrame, limit: int = LEAF_LIMIT, base: str | None = None) -> DataFrame:
    """(partition_id, depth, prefix, kind, n_entries): every node. Each level counts only what the level above left too large.

    base: a column with the depth at which an entry's subtree begins, if not at the root.
    """
    rest = placed(entries).select("partition_id", "path", (F.lit(0) if base is None else F.col(base)).alias("base"))
    top, least = (0, 0) if base is None else (x or 0 for x in rest.agg(F.min("base"), F.max("base")).first())
    levels = []
    for depth in range(top, DEPTH_LIMIT + 1):
        here, at = rest.filter(F.col("base") <= depth), F.left("path", F.lit(2 * depth))
        counts = here.groupBy("partition_id", at.alias("prefix")).agg(F.count("*").alias("n_entries"))
        last = depth == DEPTH_LIMIT
        kind = F.lit("leaf") if last else F.when(F.col("n_entries") <= limit, "leaf").otherwise("intermediate")
        counts = cut(counts.withColumns({"depth": F.lit(depth), "kind": kind}))
        levels.append(counts)
        large = counts.filter("kind = 'intermediate'").select("partition_id", "prefix")
        if last or (depth >= least and not large.limit(1).count()):
            break
        # cut, or each level would go through all those above it again
        here = cut(here.withColumn("prefix", at).join(large, ["partition_id", "prefix"], "left_semi").drop("prefix"))
        rest = here if depth >= least else here.unionByName(rest.filter(F.col("base") > depth))
    return reduce(DataFrame.unionByName, levels).select("partition_id", "depth", "prefix", "kind", "n_entries")


def leaf_of(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """entries plus the prefix of the leaf that holds each: the shortest prefix that is a leaf."""
    leaves = nodes.filter("kind = 'leaf'").select("partition_id", "prefix")
    depths = [r.depth for r in nodes.select("depth").distinct().orderBy("depth").collect()]  # DEPTH_LIMIT + 1 at most
    rows = placed(entries).withColumn("prefix", F.explode(F.array(*[F.left("path", F.lit(2 * d)) for d in depths])))
    return rows.join(leaves, ["partition_id", "prefix"], "left_semi").drop("path")


def encoded_leaf(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(partition_id, prefix, bytes): a leaf's entries in key order, tag L. A leaf holds `limit` entries at most."""
    code = F.coalesce(F.format_string("%016x", F.coalesce("content_code", F.lit(0))), F.lit(""))
    code = F.when(F.col("content_code").isNull(), F.lit("-")).otherwise(code)
    line = F.concat_ws("\t", "key", "content_hash", F.col("size").cast("string"), F.unix_millis("created_at").cast("string"), code)
    rows = leaf_of(entries, nodes).groupBy("partition_id", "prefix").agg(F.array_sort(F.collect_list(F.struct("key", line.alias("line")))).alias("e"))
    return rows.select("partition_id", "prefix", F.concat(F.lit("L\n"), F.array_join(F.transform("e", lambda x: x["line"]), "\n")).alias("bytes"))


def children(nodes: DataFrame) -> DataFrame:
    """(partition_id, prefix, slot, node_hash): what intermediate nodes list."""
    line = F.explode(F.split(F.substring("bytes", 3, 1 << 30), "\n")).alias("line")
    rows = nodes.filter("kind = 'intermediate'").select("partition_id", "prefix", line)
    return rows.select("partition_id", "prefix", F.substring_index("line", "\t", 1).alias("slot"), F.substring_index("line", "\t", -1).alias("node_hash"))


def hashes(entries: DataFrame, nodes: DataFrame, algorithm: str = "sha256", old: DataFrame | None = None) -> DataFrame:
    """(partition_id, depth, prefix, kind, node_hash, bytes): from the leaves up, a node's bytes list its children by slot.

    old: the tree that these are parts of; an intermediate node of it keeps the children that have not been made anew.
    """
    leaves = encoded_leaf(entries, nodes).select("partition_id", (F.length("prefix") / 2).cast("int").alias("depth"), "prefix", F.lit("leaf").alias("kind"), "bytes")
    level = cut(leaves.withColumn("node_hash", values.content_hash(F.col("bytes"), algorithm)))
    done = [level]
    deepest = level.agg(F.max("depth")).first()[0] or 0
    above = level.limit(0)
    for depth in range(deepest, 0, -1):
        made = level.filter(F.col("depth") == depth).unionByName(above.filter(F.col("depth") == depth))
        made = made.select("partition_id", F.left("prefix", F.lit(2 * (depth - 1))).alias("prefix"), F.right("prefix", F.lit(2)).alias("slot"), "node_hash")
        if old is not None:
            touched = old.filter(F.col("depth") == depth - 1).join(made.select("partition_id", "prefix").distinct(), ["partition_id", "prefix"], "left_semi")
            made = made.unionByName(children(touched).join(made, ["partition_id", "prefix", "slot"], "left_anti"))
        own = made.groupBy("partition_id", "prefix").agg(F.array_sort(F.collect_list(F.struct("slot", "node_hash"))).alias("c"))
        text = F.concat(F.lit("I\n"), F.array_join(F.transform("c", lambda x: F.concat_ws("\t", x["slot"], x["node_hash"])), "\n"))
        parents = own.select("partition_id", F.lit(depth - 1).alias("depth"), "prefix", F.lit("intermediate").alias("kind"), text.alias("bytes"))
        above = cut(parents.withColumn("node_hash", values.content_hash(F.col("bytes"), algorithm)))
        done.append(above)
    return reduce(DataFrame.unionByName, done).select(*NODE)


def entries_of(leaves: DataFrame) -> DataFrame:
    """The entries that leaves hold, from their bytes, with the leaf's prefix."""
    lines = F.transform(F.split(F.substring("bytes", 3, 1 << 30), "\n"), lambda x: F.split(x, "\t"))
    rows = leaves.filter("kind = 'leaf'").select("partition_id", "prefix", F.explode(lines).alias("f"))
    code = F.when(F.col("f")[4] != "-", codes.of_hex(F.col("f")[4]))
    return rows.select("partition_id", "prefix", F.col("f")[0].alias("key"), F.col("f")[1].alias("content_hash"), F.col("f")[2].cast("long").alias("size"), F.timestamp_millis(F.col("f")[3].cast("long")).alias("created_at"), code.alias("content_code"))


def without(entries: DataFrame, denylist: DataFrame | None) -> DataFrame:
    """entries without the denylist's keys."""
    return entries if denylist is None else entries.join(denylist.select("key").distinct(), "key", "left_anti")


def firsts(entries: DataFrame) -> DataFrame:
    """One entry a key, the first: by created_at, then hash, size and code."""
    first = F.min(F.struct("created_at", "content_hash", "size", "content_code")).alias("f")
    return entries.groupBy("partition_id", "key").agg(first).select("partition_id", "key", "f.*")


def insert(nodes: DataFrame, entries: DataFrame, limit: int = LEAF_LIMIT, denylist: DataFrame | None = None, algorithm: str = "sha256") -> DataFrame:
    """The nodes (NODE) that change when entries are added to the trees: those on the paths of the new keys, roots included.

    A key that a tree has already, or that is denylisted, changes nothing, as does an empty batch. nodes: the newest node of
    each partition and prefix; updated() puts the changes on top of them. A batch of one entry is an insert of one.
    """
    new = cut(placed(firsts(without(entries, denylist))))
    depths = range((nodes.agg(F.max("depth")).first()[0] or 0) + 1)  # DEPTH_LIMIT + 1 at most
    way = new.select("partition_id", "key", F.explode(F.array(*[F.left("path", F.lit(2 * d)) for d in depths])).alias("prefix"))
    met = way.join(nodes.select("partition_id", "prefix", "kind"), ["partition_id", "prefix"])
    last = met.groupBy("partition_id", "key").agg(F.max(F.struct(F.length("prefix").alias("n"), "kind")).alias("m"))
    # a key falls into the leaf on its way, or into an empty slot below the last node on it
    digits = F.when(F.col("m").isNull(), 0).when(F.col("m.kind") == "leaf", F.col("m.n")).otherwise(F.col("m.n") + 2)
    new = cut(new.join(last, ["partition_id", "key"], "left").withColumn("target", F.left("path", digits)).drop("path", "m"))
    into = new.select("partition_id", F.col("target").alias("prefix")).distinct()
    old = entries_of(nodes.join(into, ["partition_id", "prefix"], "left_semi")).withColumnRenamed("prefix", "target")
    new = new.join(old.select("partition_id", "key"), ["partition_id", "key"], "left_anti")
    old = old.join(new.select("partition_id", "target").distinct(), ["partition_id", "target"], "left_semi")
    both = cut(old.unionByName(new.select(*old.columns)).withColumn("base", (F.length("target") / 2).cast("int")))
    return hashes(both, shape(both, limit, "base"), algorithm, nodes)


def updated(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """nodes with the changed ones in their places. They are written once: the next insert reads them some times a level."""
    return cut(nodes.select(*NODE).join(changed.select("partition_id", "prefix"), ["partition_id", "prefix"], "left_anti").unionByName(changed.select(*NODE)))


def scanned(nodes: DataFrame, readable: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries by key, completeness): the entries of all leaves that can be read, and (partition_id, complete).

    readable: the (node_hash) that can be read in time; a node that can't hides what is below it.
    """
    ok = nodes if readable is None else nodes.join(readable.select("node_hash").distinct(), "node_hash", "left_semi")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    seen = cut(ok.filter("depth = 0"))
    reached = [seen]
    for depth in range(1, deepest + 1):  # a node is reached through its parent
        parent = F.left("prefix", F.lit(2 * (depth - 1)))
        below = ok.filter(F.col("depth") == depth).withColumn("up", parent)
        seen = cut(below.join(seen.select("partition_id", F.col("prefix").alias("up")), ["partition_id", "up"], "left_semi").drop("up"))
        reached.append(seen.select(*nodes.columns))
    found = reduce(DataFrame.unionByName, [r.select(*NODE) for r in reached])
    have = found.groupBy("partition_id").agg(F.count("*").alias("have"))
    whole = nodes.groupBy("partition_id").agg(F.count("*").alias("n")).join(have, "partition_id", "left")
    return entries_of(found).drop("prefix").orderBy("partition_id", "key"), whole.select("partition_id", F.col("n").eqNullSafe(F.col("have")).alias("complete"))


def decoded(node_bytes: str) -> tuple[str, list[list[str]]]:
    """(kind, rows) of a node's bytes; ValueError if they are no node."""
    tag, _, rest = node_bytes.partition("\n")
    rows = [line.split("\t") for line in rest.split("\n") if line]
    width = {"L": 5, "I": 2}.get(tag)
    if width is None or any(len(r) != width for r in rows):
        raise ValueError("corrupt node")
    return ("leaf" if tag == "L" else "intermediate"), rows


def roots(nodes: DataFrame) -> DataFrame:
    """(name, root) of each partition, as published."""
    return nodes.filter("depth = 0").select(keys.partition_name(F.col("partition_id")).alias("name"), F.col("node_hash").alias("root"))


def marked(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """(hash): all nodes and all values that the trees reach."""
    return nodes.select(F.col("node_hash").alias("hash")).unionByName(entries.select(F.col("content_hash").alias("hash"))).distinct()
