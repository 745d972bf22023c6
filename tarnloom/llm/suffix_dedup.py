"""Exact substring dedup with suffix arrays sorted in two stages.

A suffix array of all texts would move each byte a hundred times, so candidates are found first. Every `length`-byte window
has an anchor: the smallest hash of the GRAM-byte strings in it. Equal windows have equal anchors at equal offsets, so only
windows with an anchor seen more than once can repeat. An anchor's context is all bytes of the windows that it stands for.

1. Anchors, as (gram hash, context hash, document, place), are brought together by gram hash. Of equal contexts all but the
   first only repeat it: 128 bits of hashes tell them apart. Contexts that share a gram but differ (where a copied passage
   begins or ends) remain open.
2. The open contexts' bytes are dealt out by gram hash, and each share's windows are put in suffix order in two stages:
   suffixes smaller than their successors are sorted directly, the others are induced by scanning the buckets of first bytes
   in ascending order. Common prefixes of neighbours give the classes of equal windows; all but a class's first are removed.
3. A gram with more than `max_group` open contexts would make its share too large. Its contexts are cut into pieces of STEP
   windows, which have all but STEP - 1 of a window's bytes in common, and dealt out by those bytes instead of the gram
   alone; they are suffix-sorted like the others. Equal pieces of one batch travel once.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, fresh, remove, slices, staged, utf8

GRAM = 32
_BASE = 0x9E3779B97F4A7C15
_MASK = 0xFFFFFFFFFFFFFFFF
#: Bytes of text in one numpy pass (a longer text is one alone); a place must fit the low bits of an anchor's key, as any does in
#: a text that Spark can hold.
CHUNK, _PLACE = 1 << 20, 31
#: Windows of a piece.
STEP = 9
_NONE = np.uint64(_MASK)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, modulo 2^64."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            x = getattr(self, name)
            while len(x) < n:
                x = np.concatenate([x, x * np.uint64(pow(base, len(x), 1 << 64))])
            setattr(self, name, x)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of every GRAM bytes in a row, by doubling."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    while width < GRAM:
        h = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    return _mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` numbers in a row, from minima of blocks' heads and tails."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, _NONE)]).reshape(-1, width)
    heads = np.minimum.accumulate(blocks, axis=1).ravel()
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tails[:n], heads[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], length: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """(text number, gram hash, context hash, first window, last window less first, anchor less first window), for all anchors."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    none = tuple(np.zeros(0, k) for k in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n < length:
        return none
    starts = np.cumsum(sizes) - sizes
    rest = np.repeat(starts + sizes, sizes) - np.arange(n)
    grams = gram_hashes(data)
    place = np.uint64((1 << _PLACE) - 1)
    key = (grams & ~place) | (place - np.arange(len(grams), dtype=np.uint64))
    key[rest[: len(grams)] < GRAM] = _NONE
    low = sliding_min(key, length - GRAM + 1)
    window = np.flatnonzero(rest[: len(low)] >= length)
    if not len(window):
        return none
    at = (place - (low[window] & place)).astype(np.int64)
    new = np.flatnonzero(np.diff(at, prepend=-1))
    first, last = window[new], window[np.append(new[1:], len(window)) - 1]
    at = at[new]
    powers.grow(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.up[:n], out=total[1:])
    end = last + length
    context = (total[end] - total[first]) * powers.down[first]
    context = _mix(context ^ ((at - first).astype(np.uint64) << np.uint64(9)) ^ (last - first).astype(np.uint64))
    text = np.searchsorted(starts + sizes, first, "right")
    return text, grams[at], context, first - starts[text], last - first, at - first


def types(data: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last one is not."""
    n = len(data)
    step = np.sign(np.diff(data.astype(np.int16)))
    # equal neighbours take the answer of the next place where two differ
    where = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(where[::-1])[::-1] if n > 1 else where
    out = np.zeros(n, bool)
    known = nearest < n
    out[:-1][known] = step[nearest[known]] > 0
    return out


def suffix_order(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The places in `wanted` (a mask) in the order of their suffixes, compared over `depth` bytes at least.

    Stage one sorts the smaller-than-successor suffixes directly by their bytes. Stage two goes through the first bytes in
    ascending order and induces the others: those that follow from a smaller bucket by the rank of their successor, then, for
    runs of one byte, those that follow from the bucket itself.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
    small = types(data)
    need = wanted.copy()
    edge = np.flatnonzero(need & ~small)
    while len(edge):  # an induced suffix needs its successor
        edge = edge[edge + 1 < n] + 1
        edge = edge[~need[edge]]
        need[edge] = True
        edge = edge[~small[edge]]
    width = -(-depth // 8) * 8
    direct = np.flatnonzero(need & small)
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")] if len(direct) else direct
    del rows
    induced = np.flatnonzero(need & ~small)
    induced = induced[np.argsort(data[induced], kind="stable")]
    n_small, n_large = np.bincount(data[direct], minlength=256), np.bincount(data[induced], minlength=256)
    base = np.concatenate([[0], np.cumsum(n_small + n_large)])
    rank = np.full(n + 1, -1, np.int64)
    rank[n] = -2  # the end: smaller than all
    at = np.cumsum(n_small) - n_small
    rank[direct] = np.arange(len(direct)) - np.repeat(at, n_small) + np.repeat(base[:-1] + n_large, n_small)
    cut = np.concatenate([[0], np.cumsum(n_large)])
    for c in np.flatnonzero(n_large).tolist():
        own = induced[cut[c] : cut[c + 1]]
        after = np.where(own + 1 < n, padded[own + 1].astype(np.int64), -1)
        ready, rest, to = own[after < c], own[after == c], int(base[c])
        ready = ready[np.argsort(rank[ready + 1], kind="stable")]
        while len(ready):
            rank[ready] = np.arange(to, to + len(ready))
            to += len(ready)
            if not len(rest):
                break
            known = rank[rest + 1] >= 0
            ready, rest = rest[known], rest[~known]
            ready = ready[np.argsort(rank[ready + 1], kind="stable")]
    placed = np.flatnonzero(need)
    order = np.empty(len(placed), np.int64)
    order[rank[placed]] = placed
    return order[wanted[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """How many bytes, `most` at most, each suffix shares with the next one in order."""
    padded = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    words = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    out = np.full(max(0, len(order) - 1), most, np.int64)
    live = np.arange(len(out))
    for at in range(0, most, 8):
        x = words[order[live] + at] ^ words[order[live + 1] + at]
        other = x != 0
        low = x[other] & (~x[other] + np.uint64(1))  # the lowest set bit tells the first byte that differs
        out[live[other]] = np.minimum(most, at + np.floor(np.log2(low.astype(np.float64))).astype(np.int64) // 8)
        live = live[~other]
    return out


def repeats(contexts: list[bytes], count: np.ndarray, doc: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, begin, end) of what windows cover that are equal to an earlier one (by doc, then place).

    contexts: bytes; count: windows in each, the first of which begins at place `first` of document doc.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(contexts)), count)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    wanted = np.zeros(len(data), bool)
    wanted[starts[row] + inside] = True
    order = suffix_order(data, wanted, length)
    same = common_prefixes(data, order, length) >= length
    row = np.searchsorted(starts, order, "right") - 1
    place = first[row] + order - starts[row]
    return later(doc[row], place, np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64), length)


def later(doc: np.ndarray, place: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of windows that are not the first of their group, joined where they touch; group ascends from 0."""
    if not len(doc):
        return doc, place, place
    by = np.lexsort((place, doc))
    seq = np.empty(len(doc), np.int64)
    seq[by] = np.arange(len(doc))
    head = np.minimum.reduceat(seq, np.flatnonzero(np.diff(group, prepend=-1)))[group]
    by = by[(seq != head)[by]]
    return joined(doc[by], place[by], place[by] + length)


def joined(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of equal length that are sorted by (doc, begin), joined where they touch or overlap."""
    if not len(doc):
        return doc, begin, end
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (begin[1:] > end[:-1])))
    return doc[new], begin[new], end[np.append(new[1:], len(doc)) - 1]


def cut_up(text: bytes, first: int, windows: int, at: int, length: int) -> list[tuple[int, int, int]]:
    """(key, first window, windows) of a context's pieces. Window j has its anchor at offset at - j; a piece has the windows
    whose offsets agree in offset // STEP, so that equal windows are in pieces with equal keys."""
    anchor, out, j = first + at, [], 0
    while j < windows:
        group = (at - j) // STEP
        n = min(windows - j, at - j - group * STEP + 1)
        common = anchor - group * STEP  # where the bytes begin that all windows of such a piece have
        key = xxhash.xxh64_intdigest(text[common : common + length - STEP + 1], group) - (1 << 63)
        out.append((key, first + j, n))
        j += n
    return out


def once(pieces: list[tuple]) -> list[tuple]:
    """The pieces (key, doc, first, windows, bytes); of equal ones all but the earliest without their bytes."""
    seen, out = set(), []
    for piece in sorted(pieces, key=lambda p: p[1:3]):
        what = (piece[0], piece[3], piece[4])
        out.append((*piece[:4], None) if what in seen else piece)
        seen.add(what)
    return out


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs with a unique long that is in the order of (id, nulls last; then text hash), and its name.

    That is the id itself where ids are unique and not null. Otherwise rows are numbered over range partitions; rows equal in
    both id and text get the same number: they are one document, and each gets its result.
    """
    n, distinct, known = docs.agg(F.count("*"), F.count_distinct(id_col), F.count(id_col)).first()
    name = fresh(docs, "doc_number")
    if n == distinct == known:
        return docs.withColumn(name, F.col(id_col).cast("long")), name
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    keys = docs.select(F.col(id_col).alias("i"), text.alias("h")).distinct()
    ranged = keys.repartitionByRange(F.asc_nulls_last("i"), F.asc("h")).sortWithinPartitions(F.asc_nulls_last("i"), F.asc("h"))
    kind = keys.schema["i"].dataType

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(np.arange(at, at + b.num_rows))], names=["i", "h", "part", "at"])
            at += b.num_rows

    rows = staged(ranged.mapInArrow(number, T.StructType([T.StructField("i", kind), T.StructField("h", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])), "numbers")
    sizes = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a partition
    base, total = [], 0
    for part, size in sizes:
        base.append((part, total))
        total += size
    starts = F.broadcast(docs.sparkSession.createDataFrame(base, "part int, base long"))
    rows = rows.join(starts, "part").select("i", "h", (F.col("base") + F.col("at")).alias(name))
    return docs.join(rows, docs[id_col].eqNullSafe(rows.i) & (text == rows.h)).drop("i", "h"), name


def free(spark: SparkSession) -> None:
    """Let go of what finished jobs have shuffled: Spark removes it once nothing refers to it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(docs: DataFrame, key: str, text_col: str, length: int, max_group: int, share_bytes: int, paths: list[str]) -> DataFrame:
    """(doc, begin, end): spans of bytes of docs (unique long `key`) to remove; they overlap."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), utf8(batch.column(1))
            for a, b in slices([len(t) for t in texts], CHUNK):
                text, gram, context, first, more, at = anchors(texts[a:b], length, powers)
                doc = ids[a:b][text]
                spot = (first << 16) | (more << 8) | at
                # of equal contexts in this chunk only the first need travel; of the others what they cover
                by = np.lexsort((first, doc, context, gram))
                own = np.append(True, (gram[by][1:] != gram[by][:-1]) | (context[by][1:] != context[by][:-1])) if len(by) else np.zeros(0, bool)
                rest = by[~own]
                by = by[own]
                kind = np.concatenate([np.zeros(len(by), np.int8), np.ones(len(rest), np.int8)])
                # what is settled is dealt out by document, so that no gram draws it
                gram, context = np.concatenate([gram[by], _mix(doc[rest].astype(np.uint64) + first[rest].astype(np.uint64))]), np.concatenate([context[by], np.zeros(len(rest), np.uint64)])
                both = np.concatenate([by, rest])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc[both]), pa.array(spot[both])], names=["kind", "gram", "context", "doc", "spot"])

    names = ["kind", "gram", "doc", "spot"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by gram, context, document, place. Out: 1 for what repeats a context, 2 for open contexts."""
        last_gram = last_context = None
        several, held = False, None  # of the last gram: two contexts seen; its only context so far
        for batch in batches:
            kind, gram, context, doc, spot = (c.to_numpy() for c in batch.columns)
            done = kind == 1
            yield pa.RecordBatch.from_arrays([pa.array(x[done]) for x in (kind, gram, doc, spot)], names=names)
            gram, context, doc, spot = (x[~done] for x in (gram, context, doc, spot))
            if not len(gram):
                continue
            new = np.append(last_gram != gram[0] or last_context != context[0], (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]))
            out = [(np.full(int((~new).sum()), 1, np.int8), gram[~new], doc[~new], spot[~new])]
            g, d, s = gram[new], doc[new], spot[new]
            same = last_gram == gram[0]
            if held is not None:
                if same or not len(g):
                    g, d, s = (np.append(x, y) for x, y in zip(([h] for h in held), (g, d, s), strict=True)) if len(g) else (np.array([h]) for h in held)
                held = None
            if len(g):
                begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                size = np.diff(np.append(begin, len(g)))
                open_ = size > 1
                if several and same:
                    open_[0] |= g[0] == last_gram
                tail_open = bool(open_[-1]) or (g[-1] != gram[-1] and several and same)
                keep = np.repeat(open_, size)
                if not open_[-1] and g[-1] == gram[-1]:
                    held = (g[-1], d[-1], s[-1])
                several = tail_open if g[-1] == gram[-1] else several and same and gram[-1] == last_gram
                out.append((np.full(int(keep.sum()), 2, np.int8), g[keep], d[keep], s[keep]))
            last_gram, last_context = gram[-1], context[-1]
            yield from (pa.RecordBatch.from_arrays([pa.array(x) for x in y], names=names) for y in out if len(y[0]))

    found = docs.select(F.col(key), F.col(text_col)).mapInArrow(find, "kind byte, gram long, context long, doc long, spot long")
    met = found.repartition(F.col("gram")).sortWithinPartitions("gram", "context", "doc", "spot")
    settled = staged(met.mapInArrow(settle, "kind byte, gram long, doc long, spot long"), "anchors", into=paths)
    free(docs.sparkSession)
    place, more = F.shiftright("spot", 16), F.shiftright("spot", 8).bitwiseAND(F.lit(255))
    plain = settled.filter("kind = 1").select("doc", place.alias("begin"), (place + more + length).alias("end"))

    inside = F.col("spot").bitwiseAND(F.lit(255)).cast("int")
    open_ = settled.filter("kind = 2").select("gram", "doc", place.alias("first"), (more + 1).cast("int").alias("windows"), inside.alias("at"))
    size = open_.agg(F.count("*")).first()[0]
    crowded = open_.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > max_group).select("gram", F.lit(True).alias("crowded"))
    each = open_.join(crowded, "gram", "left").groupBy("doc").agg(F.collect_list(F.struct("gram", "first", "windows", "at", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("cuts"))
    texts = docs.select(F.col(key).alias("doc"), F.col(text_col).alias("text")).join(each, "doc")
    # shares of a bounded size, and enough of them for all cores however small the input
    shares = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), round(size * (length + GRAM) / share_bytes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"key": pa.int64(), "doc": pa.int64(), "first": pa.int64(), "windows": pa.int32(), "bytes": pa.binary()}
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in slices([len(t) for t in texts], 1 << 22):
                rows, pieces = [], []
                for doc, text, cuts in zip(batch.column("doc").slice(a, b - a).to_pylist(), texts[a:b], batch.column("cuts").slice(a, b - a).to_pylist(), strict=True):
                    for c in cuts:
                        if c["crowded"]:
                            pieces += [(key, doc, first, n, text[first : first + n - 1 + length]) for key, first, n in cut_up(text, c["first"], c["windows"], c["at"], length)]
                        else:
                            rows.append((c["gram"], doc, c["first"], c["windows"], text[c["first"] : c["first"] + c["windows"] - 1 + length]))
                rows += once(pieces)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))

    # without bytes: an equal piece of the same batch comes earlier
    contexts = staged(texts.mapInArrow(cut, "key long, doc long, first long, windows int, bytes binary"), "contexts", into=paths)
    free(docs.sparkSession)

    def sort(table: pa.Table) -> pa.Table:
        windows = table.column("windows").to_numpy().astype(np.int64)
        doc, begin, end = repeats(table.column("bytes").to_pylist(), windows, table.column("doc").to_numpy(), table.column("first").to_numpy(), length)
        return pa.table({"doc": pa.array(doc), "begin": pa.array(begin), "end": pa.array(end)})

    share = F.pmod(F.xxhash64("key"), F.lit(shares))
    sorted_ = contexts.filter("bytes IS NOT NULL").select(share.alias("share"), "doc", "first", "windows", "bytes").groupBy("share").applyInArrow(sort, "doc long, begin long, end long")
    more_ = contexts.filter("bytes IS NULL").select("doc", F.col("first").alias("begin"), (F.col("first") + F.col("windows") - 1 + length).alias("end"))
    return staged(plain.unionByName(sorted_).unionByName(more_), "spans", into=paths)


def remove_repeats(docs: DataFrame, length: int = 100, max_group: int = 4000, share_bytes: int = 3 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus n_bytes, n_removed, n_spans, kept (binary): each byte is removed that a `length`-byte string covers which also
    starts earlier (in a document with a smaller id, or earlier in its own).

    Texts are UTF-8 bytes, null is empty; strings never cross documents. Rows with equal ids are documents in the order of
    their texts' hashes, rows with null ids come last; rows equal in id and text are one document. An empty table gives an
    empty result. Columns of docs with the added names are replaced. length is GRAM to 224.
    """
    if not GRAM <= length <= 224:
        raise ValueError(f"length must be {GRAM} to 224")
    paths: list[str] = []
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]
    docs = docs.drop(*[f.name for f in fields])
    own, key = numbered(docs, id_col, text_col)
    spans = repeated_spans(own, key, text_col, length, max_group, share_bytes, paths)
    cuts, number = fresh(own, "cuts"), fresh(own, "number")
    grouped = spans.groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias(cuts)).withColumnRenamed("doc", number)
    whole = own.join(grouped, own[key] == grouped[number], "left").drop(number)

    def apply(batch: pa.RecordBatch) -> list:
        n, removed, runs, kept = [], [], [], []
        for text, spans in zip(utf8(batch.column(text_col)), batch.column(cuts), strict=True):
            parts, at, gone, count, end_of_run = [], 0, 0, 0, -1
            if spans.is_valid:
                begin, end = (np.asarray(spans.values.field(i)) for i in (0, 1))
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                    if b > end_of_run:
                        parts.append(text[at:b])
                        count += 1
                        gone += e - b
                    else:
                        gone += e - end_of_run
                    at = end_of_run = e
            parts.append(text[at:])
            n.append(len(text))
            removed.append(gone)
            runs.append(count)
            kept.append(b"".join(parts))
        return [n, removed, runs, kept]

    out = add_columns(whole, fields, apply, drop=(cuts, key))
    remove(docs.sparkSession, *paths[:-1])  # the spans are still read
    return out.select(*docs.columns, *[f.name for f in fields])
