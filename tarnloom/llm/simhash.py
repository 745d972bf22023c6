"""SimHash near-duplicates: fingerprints, their segment-popcount embedding, a grid range-join, exact links.

A 64-bit fingerprint is embedded as the bit counts of its 16 four-bit segments. The Manhattan distance of two embeddings is
a lower bound of the Hamming distance, and two points of a grid that are 2 apart have a grid point 1 away from both. Each
fingerprint is therefore entered in the 33 cells at distance 1 or less; fingerprints that share no cell are over 2 bits
apart and never meet. What a shared cell proposes needs no product of its members: two fingerprints differ in 2 bits or
fewer if and only if some value is 1 bit or less from both, so the cell's members list the values 1 bit away that lie in
the cell, and of the holders of a value each is a candidate with the smallest. Each candidate pair is then verified by its
Hamming distance. A group of any size costs rows in proportion to its size. From some 10^8 distinct fingerprints on, most
cells are shared and the grid leaves little out; the rows stay 33 a fingerprint.

Two bits are far less than what near copies of prose differ in. Asked for a similarity, the operator also links documents
whose sets of five-word shingles have that Jaccard similarity. Signatures of smallest shingles are cut into bands; a band's
group proposes its members with its smallest and largest. Where that does not join the group, its members outside the main
component meet all others, block by block, and are compared there; a block returns just the links that join what it
has not joined yet, never its pairs. The sets themselves decide.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS, add_columns, fresh, remove, staged, utf8
from .components import components
from .decontam import WordHashes, grams

_TABLE = bytes(0x20 if chr(c) in WS else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
SEGMENTS, BITS = 16, 4
#: Bits in which linked fingerprints differ at most; the grid's cells and the values between are made for this radius.
RADIUS = 2
#: Shingles hashed and counted at once.
_BLOCK = 1 << 16
#: Smallest shingles in a band (a byte each), and bands: sets of Jaccard similarity 0.8 share one with a probability of 0.999.
ROWS, BANDS = 8, 40
#: Members of a mixed group on either side of a block.
CHUNK = 256
_FLIP, _ODD = np.random.default_rng(42).integers(0, 1 << 32, (2, ROWS * BANDS), np.uint32) | np.array([[0], [1]], np.uint32)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text as a signed 64-bit number; 0 without words."""
    words = text.translate(_TABLE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        starts, stops = begins[:1], ends[-1:]
    else:
        starts, stops = begins[:n], ends[shingle - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """docs plus the fingerprint (long). Null, empty and blank texts have fingerprint 0."""

    def run(batch: pa.RecordBatch) -> list:
        return [[fingerprint(t, shingle) for t in utf8(batch.column(text_col))]]

    return add_columns(docs.drop(name), [T.StructField(name, T.LongType())], run)


def counts_of(fp: np.ndarray) -> np.ndarray:
    """The embedding, packed: a four-bit count for each four-bit segment."""
    a, b, one, two = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(1), np.uint64(2)
    pairs = fp - ((fp >> one) & a)
    return (pairs & b) + ((pairs >> two) & b)


def ways(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fp, way, cell): way 0 leads to the fingerprint's own cell, 1 + 2s to one bit more in segment s, 2 + 2s to one less."""
    own = counts_of(fp)
    found = [(fp, np.zeros(len(fp), np.int8), own)]
    for s in range(SEGMENTS):
        shift = np.uint64(BITS * s)
        count, unit = (own >> shift) & np.uint64(15), np.uint64(1) << shift
        for way, can, cell in ((1 + 2 * s, count < BITS, own + unit), (2 + 2 * s, count > 0, own - unit)):
            found.append((fp[can], np.full(int(can.sum()), way, np.int8), cell[can]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def between(fp: np.ndarray, way: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fp, value): the values that lie in the cell of that way, 1 bit from fp at most."""
    own = way == 0
    found = [(fp[own], fp[own])]
    rest, way = fp[~own], way[~own].astype(np.int64) - 1
    segment, down = way // 2, (way % 2).astype(np.uint64)
    for i in range(BITS):
        at = (BITS * segment + i).astype(np.uint64)
        fits = ((rest >> at) & np.uint64(1)) == down
        found.append((rest[fits], rest[fits] ^ (np.uint64(1) << at[fits])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _rows(df: DataFrame, schema: str, fn) -> DataFrame:
    """A map of number columns to the rows that fn makes of their arrays; a batch is cut so that its rows stay few."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                arrays = [c.to_numpy() for c in batch.slice(at, 4096).columns]
                made = fn(*[x.view(np.uint64) if x.dtype == np.int64 else x for x in arrays])
                made = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in made]
                yield pa.RecordBatch.from_arrays(made, names=[f"c{i}" for i in range(len(made))])

    return df.mapInArrow(run, schema)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that join all distinct fingerprints (column fp) at 2 bits or fewer, a star for each value between them."""
    cells = _rows(fps.select("fp"), "c0 long, c1 byte, c2 long", ways).toDF("fp", "way", "cell")
    shared = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell")
    near = cells.join(shared, "cell", "left_semi").select("fp", "way")
    value = staged(_rows(near, "c0 long, c1 long", between).toDF("fp", "value"), "between")
    star = value.groupBy("value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").select("value", "b")
    candidates = value.join(star, "value").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return candidates.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def bit_agreement(similarity: float) -> float:
    """The probability that a bit of two fingerprints agrees, for shingle sets of this Jaccard similarity."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def band_plan(n: int, similarity: float, recall: float = 0.9) -> tuple[int, int]:
    """(bits a band, bands) for n fingerprints: a band's value is shared by chance with one in 16 others at most, and of
    pairs just as similar as asked `recall` share a band at least."""
    bits = max(20, math.ceil(math.log2(max(2, n))) + 4)
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-(bit_agreement(similarity) ** bits)))


def shingle_set(text: bytes, shingle: int, hashes: WordHashes) -> np.ndarray:
    """The distinct hashes of a text's shingles; a text with fewer words is one shingle, without words none."""
    words = [hashes[w] for w in text.translate(_TABLE).split(b" ") if w]
    return np.unique(grams(np.array(words, np.uint64), min(shingle, len(words)))) if words else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> bytes:
    """ROWS * BANDS bytes, each of a hash of the shingle that is smallest under one of as many hash functions: two sets agree
    in a byte with a probability of their Jaccard similarity (and by chance, 1/256)."""
    x = (shingles ^ (shingles >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = ((x ^ (x >> np.uint64(27))) >> np.uint64(16)).astype(np.uint32)
    low = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 128):
        np.minimum(low, ((x[at : at + 128, None] ^ _FLIP) * _ODD).min(axis=0), out=low)
    return ((low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), ROWS * BANDS)


def shared_bands(nodes: DataFrame) -> DataFrame:
    """(key, band, node, first, last, n): the members of each band's group of two nodes or more; first and last are its ends."""

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                value = (_matrix(some.column(1)).view("<u8") ^ np.arange(1, BANDS + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key = ((value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
                band = np.tile(np.arange(BANDS, dtype=np.int8), some.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(band), pa.array(np.repeat(some.column(0).to_numpy(), BANDS))], names=["key", "band", "node"])

    members = nodes.select("node", "sig").mapInArrow(cut, "key long, band byte, node long")
    groups = members.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n")).filter("n > 1")
    return members.join(groups, "key")


def jaccard_at_least(u: np.ndarray, v: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have this Jaccard similarity or more."""
    if min(len(u), len(v)) < similarity * max(len(u), len(v)) - 1e-9:
        return False
    both = len(np.intersect1d(u, v, assume_unique=True))
    return both >= similarity * (len(u) + len(v) - both) - 1e-9


class Joined(dict):
    """Labels joined so far: the one that stands for each."""

    def of(self, x: int) -> int:
        while self.get(x, x) != x:
            x = self[x]
        return x


def mixed_links(shared: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, least: int, similarity: float, shingle: int) -> DataFrame:
    """(a, b): links that join what the members of a group are still apart in, for groups whose labels differ.

    Groups of three have no pair without an end. In a larger one the members outside the most frequent label meet all others,
    in blocks of about CHUNK by CHUNK, so a group of any size is dealt over many tasks. Pairs whose signatures agree in `least`
    bytes or more are compared by their shingles, the likeliest first, unless earlier links of the block have joined
    them; a pair is looked at in its first common band alone. So a block returns fewer links than it has members.
    """
    some = shared.filter("n > 3").join(labels, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("l"))
    of = some.groupBy("key", "l").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "l")).alias("main")).filter("n > main.c")
    some = some.join(of.select("key", F.ceil(F.col("n") / CHUNK).alias("all"), F.ceil((F.col("n") - F.col("main.c")) / CHUNK).alias("outer"), F.col("main.l").alias("main")), "key")
    some = some.join(nodes.select("node", "sig"), "node").join(texts, "node")
    till = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("node", "key"), F.col(n))
    own = ("band", "node", "l", "sig", "text")
    left = some.filter("l <> main").select("key", place("outer").alias("i"), till("all").alias("j"), F.lit(True).alias("is_outer"), *own)
    right = some.select("key", till("outer").alias("i"), place("all").alias("j"), F.lit(False).alias("is_outer"), *own)

    def meet(block: pa.Table, hashes: WordHashes) -> list[tuple[int, int]]:
        outer = block.column("is_outer").to_numpy()
        node, label, band = (block.column(c).to_numpy() for c in ("node", "l", "band"))
        sig, text = _matrix(block.column("sig")), block.column("text")
        bands = np.ascontiguousarray(sig).view("<u8")
        sets: dict[int, np.ndarray] = {}

        def shingles(i: int) -> np.ndarray:
            if node[i] not in sets:
                sets[node[i]] = shingle_set((text[i].as_py() or "").encode(), shingle, hashes)
            return sets[node[i]]

        xs, ys = np.flatnonzero(outer), np.flatnonzero(~outer)
        found: list[tuple[int, int, int]] = []
        for x in xs.tolist():
            same = (sig[ys] == sig[x]).sum(axis=1, dtype=np.int32)
            near = np.flatnonzero((same >= least) & (label[ys] != label[x]))
            first = (bands[ys[near]] == bands[x]).argmax(axis=1) == band[x]
            found += [(-int(same[k]), x, int(ys[k])) for k in near[first]]
        joined, links = Joined(), []
        for _, x, y in sorted(found):
            p, q = joined.of(int(label[x])), joined.of(int(label[y]))
            if p != q and jaccard_at_least(shingles(x), shingles(y), similarity):
                joined[max(p, q)] = min(p, q)
                links.append((int(min(node[x], node[y])), int(max(node[x], node[y]))))
        return links

    def run(batches):
        hashes, held = WordHashes(), None

        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            k, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            at = 0
            for end in cuts.tolist():
                yield out(meet(t.slice(at, end - at), hashes))
                at = end
            held = t.slice(at)
        if held is not None:
            yield out(meet(held, hashes))

    rows = left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(run, "a long, b long").distinct()


def exact_links(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b): the pairs whose sets of shingles have a Jaccard similarity of `similarity` or more."""
    hashes = WordHashes()

    def run(batches):
        known: dict[int, np.ndarray] = {}

        def shingles(node: int, text) -> np.ndarray:
            if node not in known:
                if len(known) >= 100:
                    known.clear()
                known[node] = shingle_set((text.as_py() or "").encode(), shingle, hashes)
            return known[node]

        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                keep.append(jaccard_at_least(shingles(a, x), shingles(b, y), similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    sides = pairs.select("a", "b").join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    return sides.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar_links(nodes: DataFrame, texts: DataFrame, similarity: float, shingle: int, into: list[str]) -> DataFrame:
    """(a, b): links that join all nodes (node, sig, text_hash) that share a band and whose shingles are that similar.

    Proposed are first the pairs of each band's group with the group's ends. Signatures drop pairs that are 4 standard errors
    under the similarity; the rest is compared exactly: first each node's best pair, then all whose ends are not yet joined.
    What is then still apart in a group is settled by mixed_links(). texts: (text_hash, text).
    """
    size = ROWS * BANDS
    least = math.floor(size * similarity - 4 * math.sqrt(size * similarity * (1 - similarity)))
    shared = staged(shared_bands(nodes), "bands", into=into)
    used = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "text_hash")
    # copies are one text before the shuffle; an inner join, as Spark would put a semi-join below the aggregation
    once = texts.groupBy("text_hash").agg(F.first("text").alias("text"))
    texts = staged(once.join(used, "text_hash").select("node", "text"), "texts", into=into)

    def near(batches):
        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1, dtype=np.int32)
                keep = pa.array(same >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(same).filter(keep)], names=["a", "b", "same"])

    def verified(pairs: DataFrame) -> DataFrame:
        best = staged(pairs.groupBy("b").agg(F.max(F.struct("same", "a")).alias("x")).select(F.col("x.a").alias("a"), "b"), "best-pairs", into=into)
        found = staged(exact_links(best, texts, similarity, shingle), "links", into=into)
        label = staged(components(found), "labels", into=into)
        ends = pairs.join(best, ["a", "b"], "left_anti").join(label.toDF("a", "la"), "a", "left").join(label.toDF("b", "lb"), "b", "left")
        open_ = ends.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
        return found.unionByName(staged(exact_links(open_, texts, similarity, shingle), "links", into=into))

    ends = shared.select("node", F.explode(F.array("first", "last")).alias("end")).filter("node <> end")
    star = ends.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()
    sides = star.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
    star = staged(sides.select("a", "b", "x", "y").mapInArrow(near, "a long, b long, same int"), "star-pairs", into=into)
    found = verified(star)
    labels = staged(components(found), "labels", into=into)
    return found.unionByName(staged(mixed_links(shared, labels, nodes, texts, least, similarity, shingle), "mixed-links", into=into))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, similarity: float | None = None, wide_shingle: int = 5) -> DataFrame:
    """(id_col, fingerprint long, component): a row per row of docs; component is the smallest id reachable over links.

    Fingerprints link at 2 bits or fewer, equal ones included; texts without words have fingerprint 0 and link like others.
    With a similarity, documents also link whose sets of wide_shingle words have that Jaccard similarity, compared exactly;
    pairs are proposed by bands of signatures, with a probability of 0.999 at a similarity of 0.8 and surer above it, the same
    for each number of documents. Texts without words have no set.
    A null id can't be the smallest unless its whole component has none; repeated rows are repeated in the result. An empty
    table gives an empty result.
    """
    paths: list[str] = []
    source = docs.select(F.col(id_col), F.col(text_col))
    fp = fresh(source, "fp")
    hashes = WordHashes()

    def widen(batch: pa.RecordBatch) -> list:
        texts = utf8(batch.column(text_col))
        out: list[list] = [[fingerprint(t, shingle) for t in texts]]
        if similarity is not None:
            out += [[], []]
            for t in texts:
                s = shingle_set(t, wide_shingle, hashes)
                out[1].append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                out[2].append(signature(s) if len(s) else None)
        return out

    fields, names = [T.StructField(fp, T.LongType())], [id_col, "fp"]
    if similarity is not None:
        fields += [T.StructField(fresh(source, "node"), T.LongType()), T.StructField(fresh(source, "sig"), T.BinaryType())]
        text_hash = fresh(source, "text_hash")
        source, names = source.withColumn(text_hash, F.xxhash64(text_col)), [id_col, "text_hash", "fp", "node", "sig"]
    own = add_columns(source, fields, widen, drop=(text_col,)).toDF(*names)
    own = staged(own, "fingerprints")
    first = staged(own.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct-fingerprints", into=paths)
    edges = links(first.select("fp"))
    if similarity is not None:
        # a node is a set of shingles; texts with one set can have several fingerprints, and a fingerprint several sets
        sets = own.filter("node IS NOT NULL")
        nodes = staged(sets.groupBy("node").agg(F.min("fp").alias("fp"), F.min("text_hash").alias("text_hash"), F.max("sig").alias("sig")), "nodes", into=paths)
        equal = sets.select("fp", "node").distinct().join(nodes.select("node", F.col("fp").alias("b")), "node").filter("fp <> b").select(F.col("fp").alias("a"), "b")
        texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
        similar = similar_links(nodes, texts, similarity, wide_shingle, paths)
        of = lambda end: nodes.select(F.col("node").alias(end), F.col("fp").alias(f"fp_{end}"))
        similar = similar.join(of("a"), "a").join(of("b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
        edges = edges.unionByName(equal).unionByName(similar)
    groups = components(edges)
    # the smallest id of each group of linked fingerprints, then the group's id for each of its fingerprints
    grouped = first.join(groups, first.fp == groups.node)
    smallest = grouped.groupBy("component").agg(F.min("first").alias("smallest"))
    linked = groups.join(smallest, "component").select(F.col("node").alias("fp"), "smallest")
    final = staged(first.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component")), "components")
    remove(docs.sparkSession, *paths)
    return own.select(id_col, "fp").join(final, "fp").select(F.col(id_col), F.col("fp").alias("fingerprint"), "component")
