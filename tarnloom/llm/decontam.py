"""Benchmark decontamination by winnowing.

The smallest hash of the k-word grams in a window of `window` words is the window's fingerprint: a function of the window's words,
so that two texts which share the window share the fingerprint, however long their other parts are. Documents' windows
are joined with the items' on the fingerprint and on the words themselves, so a hash alone never decides, and hits are
extended to the whole common run by joining windows that touch or overlap.

Nothing of the items is held in one place: windows of items and documents are tables. Only a bitmap of the items' hashes,
MOST_BITS long at most, is sent to the executors, to leave out windows that can't be in any item before the shuffle; the
fuller it is, the more windows are shuffled for nothing, and the join's result is the same. A document names each different window
once, with all its places, and equal texts are joined once, so repeats make no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, fresh, remove, slices, staged, utf8

#: Bits of the bitmap at most, bits for each hash below that, and bits of one row of it.
MOST_BITS, BITS_EACH, ROW_BITS = 1 << 28, 32, 1 << 20
#: Bytes of hits that are broadcast at most; more are joined by shuffle.
MOST_HITS = 16 << 20

_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters (lower-cased), digits and non-ASCII characters of a UTF-8 text."""
    return text.translate(_TABLE).split()


class WordHashes(dict):
    """A word's 64-bit hash, remembered; the memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _MUL
        out ^= out >> np.uint64(29)
        out += h[j : j + n]
    out *= _MUL
    out ^= out >> np.uint64(32)
    return np.minimum(out, _NONE - np.uint64(1))


def smallest(g: np.ndarray, spread: int) -> np.ndarray:
    """The smallest of every `spread` hashes in a row."""
    low = g[: max(0, len(g) - spread + 1)].copy()
    for j in range(1, spread):
        np.minimum(low, g[j : j + len(low)], out=low)
    return low


class Bitmap:
    """Which hashes there may be: two bits for each."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = np.uint64(bits - 1), data  # bits: a power of two

    @staticmethod
    def places(bits: int, h: np.ndarray) -> np.ndarray:
        last = np.uint64(bits - 1)
        return np.concatenate([h & last, (h >> np.uint64(32)) & last])

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for x in (h, h >> np.uint64(32)):
            at = x & self.bits
            found &= (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return found


class Windows:
    """The windows of texts: for each text its different windows as (fingerprint, words, places)."""

    def __init__(self, window: int, k: int):
        if not 0 < k <= window:
            raise ValueError("k is 1 to window")
        self.window, self.k, self.hashes = window, k, WordHashes()

    def of_texts(self, texts: list[bytes], lengths: list[int], known: Bitmap | None = None) -> list[dict[bytes, tuple[int, list[int]]]]:
        """lengths: of windows shorter than `window` that are asked for as well. known: leaves out windows that aren't in it."""
        docs = [words(t) for t in texts]
        n = np.array([len(w) for w in docs], np.int64)
        begin = np.cumsum(n) - n
        h = np.fromiter((self.hashes[x] for w in docs for x in w), np.uint64, int(n.sum()))
        doc_of = np.repeat(np.arange(len(docs)), n)
        out: list[dict[bytes, tuple[int, list[int]]]] = [{} for _ in docs]
        for length in (self.window, *lengths):
            if len(h) < length:
                continue
            prints = fingerprints(h, length, self.k)
            at = np.flatnonzero(doc_of[: len(prints)] == doc_of[length - 1 :])
            if known is not None:
                at = at[known.has(prints[at])]
                at = at[known.has(whole(h, at, length))]
            for p, f in zip(at.tolist(), prints[at].tolist(), strict=True):
                d = int(doc_of[p])
                x = p - int(begin[d])
                out[d].setdefault(b" ".join(docs[d][x : x + length]), (f, []))[1].append(x)
        return out


def fingerprints(h: np.ndarray, length: int, k: int) -> np.ndarray:
    """Of each `length` words in a row, given their hashes: the smallest hash of k words (of all, if they are fewer)."""
    k = min(k, length)
    return smallest(grams(h, k), length - k + 1)


def whole(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` words from each place."""
    out = np.full(len(at), length, np.uint64)
    for j in range(length):
        out = (out ^ (out >> np.uint64(31))) * _MUL + h[at + j]
    out *= _MUL
    return out ^ (out >> np.uint64(32))


def merged(begin: np.ndarray, end: np.ndarray) -> list[dict]:
    """Runs that touch or overlap as one, ascending."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, begin[1:] > end[:-1])) if len(begin) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(begin)) - 1
    return [{"begin": int(a), "end": int(b)} for a, b in zip(begin[new], end[last], strict=True)]


def item_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """(h, words, n, whole, item): each different window of each item (id, text); an item of fewer words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(window, k)
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in slices([len(t) for t in texts], 1 << 20):
                rows = []
                for i in range(a, b):
                    own = words(texts[i])
                    if own:
                        short = [] if len(own) >= window else [len(own)]
                        rows += [(f, w, i) for w, (f, _) in windows.of_texts([texts[i]], short)[0].items()]
                each = [w.split(b" ") for _, w, _ in rows]
                n = np.array([len(w) for w in each], np.int64)
                h = np.fromiter((windows.hashes[x] for w in each for x in w), np.uint64, int(n.sum()))
                at = np.cumsum(n) - n
                hashes = np.zeros(len(n), np.uint64)
                for length in np.unique(n).tolist():
                    hashes[n == length] = whole(h, at[n == length], length)
                prints = np.array([f for f, _, _ in rows], np.uint64)
                ids = batch.column(0).take(pa.array([i for _, _, i in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array([w for _, w, _ in rows], pa.binary()), pa.array(n.astype(np.int32)), pa.array(hashes.view(np.int64)), ids], names=["h", "words", "n", "whole", "item"])

    return items.mapInArrow(run, "h long, words binary, n int, whole long, item string")


def bitmap(windows: DataFrame) -> Bitmap:
    """The fingerprints and whole hashes of windows, MOST_BITS at most. Its rows are made and joined on the executors."""
    count = windows.count()
    bits = min(MOST_BITS, max(ROW_BITS, 1 << (2 * BITS_EACH * count).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for column in batch.columns:
                at = np.unique(Bitmap.places(bits, column.to_numpy().view(np.uint64)))
                row, inside = at // ROW_BITS, at % ROW_BITS
                for r in np.unique(row).tolist():
                    np.bitwise_or.at(own.setdefault(r, np.zeros(ROW_BITS // 8, np.uint8)), inside[row == r] >> np.uint64(3), np.uint8(1) << (inside[row == r] & np.uint64(7)).astype(np.uint8))
        for r, data in own.items():
            yield pa.RecordBatch.from_pydict({"row": [r], "data": [data.tobytes()]})

    def either(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.zeros(ROW_BITS // 8, np.uint8)
        for t in tables:
            for x in t.column("data"):
                data |= np.frombuffer(x.as_py(), np.uint8)
        yield pa.RecordBatch.from_pydict({"row": [key[0].as_py()], "data": [data.tobytes()]})

    data = np.zeros(bits // 8, np.uint8)
    for r in windows.select("h", "whole").mapInArrow(run, "row long, data binary").groupBy("row").applyInArrow(either, "row long, data binary").collect():
        data[r["row"] * (ROW_BITS // 8) :][: ROW_BITS // 8] = np.frombuffer(r["data"], np.uint8)
    return Bitmap(bits, data)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs plus n_words, hit_runs (array of begin, end in words), n_hit, hit_items (item ids as strings, sorted), contaminated.

    A window is `window` item words in a row, or a whole item with fewer words (but not none). A document word inside any
    occurrence of a window is hit. A null or empty text has no words; null item ids are left out of hit_items but their words
    are hit. Repeated items give their id once. Without items or documents the result has no hits or no rows. Columns of docs
    with these names are replaced.
    """
    spark = docs.sparkSession
    new = ["n_words", "hit_runs", "n_hit", "hit_items", "contaminated"]
    docs = docs.drop(*new)
    paths: list[str] = []
    own = staged(item_windows(items.select(F.col(item_id).cast("string"), F.col(item_text)), window, k), "item-windows", into=paths)
    lengths = sorted(r.n for r in own.filter(F.col("n") < window).select("n").distinct().collect())  # window - 1 at most
    sent = spark.sparkContext.broadcast(bitmap(own))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(window, k)
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in slices([len(t) for t in texts], 1 << 20):
                found = windows.of_texts(texts[a:b], lengths, sent.value)
                rows = [(a + i, f, w, at) for i, x in enumerate(found) for w, (f, at) in x.items()]
                keys = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                prints = pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([keys, prints, pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.list_(pa.int32()))], names=["key", "h", "words", "places"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for x in batch.column(1):
                begin = [np.array(r["places"].as_py(), np.int64) for r in x]
                runs.append(merged(np.concatenate(begin), np.concatenate([p + r["n"].as_py() for p, r in zip(begin, x, strict=True)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, runs_type)], names=["key", "hit_runs"])

    # equal texts have equal hits: the text's digest is the key, and it is all that is joined again
    key = fresh(docs, "text_digest")
    digest = F.unhex(F.md5(F.col(text_col)))
    places = docs.select(digest.alias("key"), F.col(text_col)).filter(F.col(text_col) != "").mapInArrow(find, "key binary, h long, words binary, places array<int>")
    places = places.groupBy("key", "h", "words").agg(F.min("places").alias("places"))
    known = own.groupBy("h", "words", "n").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = staged(places.join(known, ["h", "words"]).select("key", "places", "n", "items"), "hits", into=paths)
    runs_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    runs = hits.groupBy("key").agg(F.collect_list(F.struct("places", "n")).alias("x")).mapInArrow(joined, "key binary, hit_runs array<struct<begin:int,end:int>>")
    ids = hits.select("key", "items").distinct().select("key", F.explode("items").alias("item")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("hit_items"))
    found = staged(runs.join(ids, "key", "left").withColumnRenamed("key", key), "found")
    room = found.agg(F.sum(40 + 16 * F.size("hit_runs") + F.coalesce(F.octet_length(F.concat_ws(",", "hit_items")), F.lit(0)))).first()[0] or 0
    out = docs.withColumn(key, digest).join(F.broadcast(found) if room <= MOST_HITS else found.hint("merge"), key, "left")
    remove(spark, *paths)
    # the same words as words() finds, counted without Python
    n_words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("long")
    hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["begin"])
    out = out.withColumns({"n_words": n_words, "hit_runs": F.coalesce("hit_runs", F.array().cast(found.schema["hit_runs"].dataType)), "hit_items": F.coalesce("hit_items", F.array().cast("array<string>"))})
    return out.withColumn("n_hit", hit).withColumn("contaminated", F.col("n_hit") > 0).select(*docs.columns, *new)
