"""Language-model scoring by cross-entropy difference.

Two bigram models, of a target subset and of the whole corpus (the background), share one vocabulary: all words of the corpus.
They are matched: the same counts, the same smoothing. A document's score is the mean over its tokens of target loss less
background loss: the lower, the more it reads like the target. Its own counts are left out of both models, so that no
document is scored by a model that has seen it; a copy of it elsewhere counts.

Counts are exact, of every word, context and pair of words, and grow with the corpus; nothing of them reaches the driver or
is broadcast. Documents are cut into chunks of some MB. A chunk sends its counts, sorted by key, to ranges of keys; each range
is added up in one task and sends every chunk the totals of just the keys that the chunk has sent, in the same order. A
frequent key is one number per chunk, and ranges of hashed keys are even, so none is hot. Keys are 62-bit hashes of words and
pairs, told apart by kind: among 10^8 of them two collide with a probability of 0.1 %.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, remove, slices, staged

#: Bytes of text in a chunk, about (a longer text is one alone), and counts added up in one range of keys, about.
CHUNK, RANGE = 4 << 20, 1 << 20
#: Ids that are broadcast at most (9 bytes each); more are joined by shuffle.
MOST_IDS = 1 << 20
WORD, CONTEXT, PAIR = 0, 1, 2
_START = np.uint64(0x632BE59BD9B4E019)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: str) -> list[str]:
    return text.lower().split()


def _packed(**arrays: np.ndarray) -> bytes:
    np.savez(out := io.BytesIO(), **arrays)
    return zstandard.compress(out.getvalue(), 1)


def _unpacked(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(zstandard.decompress(blob))) as f:
        return dict(f)


def _steps(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as differences, all their first bytes, then all their second ones: the high ones are zero."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _of_steps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(steps.T).view(np.uint64).ravel(), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(kind: int, h: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Keys of words, of contexts, or of pairs (h, after), with the kind in the two lowest bits."""
    x = h * _A + np.uint64(kind)
    x = _mixed(x if after is None else _mixed(x) + after * _B)
    return (x & ~np.uint64(3)) | np.uint64(kind)


class Numbers(dict):
    """Words by the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        return at


def tokenized(texts: list[str]) -> dict[str, np.ndarray]:
    """tokens: each word of all texts by its number in the chunk; n: words of each text; h: the numbered words' hashes."""
    known = Numbers()
    each = [np.fromiter(map(known.__getitem__, own), np.uint32, len(own)) for own in map(words, texts)]
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
    return {"tokens": np.concatenate(each) if each else np.zeros(0, np.uint32), "n": np.array([len(x) for x in each], np.int64), "h": h}


class Counts(NamedTuple):
    """A chunk's counts. Each of word, context and pair has, per key, its place in `keys` (sorted) and, per (document, key),
    document, number of the key and count."""

    keys: np.ndarray
    both: np.ndarray  # counts of keys, of the target's documents [0] and of all [1]
    of_pair: tuple[np.ndarray, np.ndarray]  # each pair's context and word
    places: tuple[np.ndarray, ...]
    rows: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]


def counted(tokens: np.ndarray, n: np.ndarray, h: np.ndarray, chosen: np.ndarray) -> Counts:
    now = tokens.astype(np.int64)
    start = len(h)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = start
    doc = np.repeat(np.arange(len(n)), n)
    pair, number = np.unique(before * (start + 1) + now, return_inverse=True)
    context, word = pair // (start + 1), pair % (start + 1)

    def by_document(d: np.ndarray, x: np.ndarray, of: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both, at = np.unique(d * of + x, return_inverse=True)
        return both // of, both % of, np.bincount(at, times, len(both))

    d, x, times = pairs = by_document(doc, number, max(1, len(pair)))
    rows = (by_document(d, word[x], start + 1, times), by_document(d, context[x], start + 1, times), pairs)
    with_start = np.append(h, _START)
    keys = [_key(WORD, h), _key(CONTEXT, with_start), _key(PAIR, with_start[context], with_start[word])]
    sizes = [len(k) for k in keys]
    both = np.zeros((2, sum(sizes)))
    for kind, (d, x, c) in enumerate(rows):
        at = slice(sum(sizes[:kind]), sum(sizes[: kind + 1]))
        for m, w in enumerate((c * chosen[d], c)):
            both[m, at] = np.bincount(x, w, sizes[kind])
    whole = np.concatenate(keys)
    order = np.argsort(whole)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Counts(whole[order], both[:, order], (context, word), tuple(np.split(place, np.cumsum(sizes)[:-1])), rows)


def scored(c: Counts, chosen: np.ndarray, n: np.ndarray, total: np.ndarray, sums: np.ndarray, vocabulary: int, weight: float) -> np.ndarray:
    """Each document's summed loss under the target's model [0] and the background's [1]. total: both models' counts in the
    order of c.keys; sums: both models' numbers of tokens."""
    doc, pair, times = c.rows[PAIR]
    out = np.zeros((2, len(n)))
    own = {}
    for kind, of in ((WORD, c.of_pair[1][pair]), (CONTEXT, c.of_pair[0][pair])):
        d, x, k = c.rows[kind]
        width = len(c.places[CONTEXT])
        own[kind] = of, k[np.searchsorted(d * width + x, doc * width + of)]
    for m in (0, 1):
        left = np.where(chosen[doc], 1.0, 0.0) if m == 0 else np.ones(len(doc))  # the target has counted its own documents alone
        (word, in_word), (context, in_context) = own[WORD], own[CONTEXT]
        alone = (total[m, c.places[WORD][word]] - left * in_word + 1) / (sums[m] - left * n[doc] + vocabulary)
        p = (total[m, c.places[PAIR][pair]] - left * times + weight * alone) / (total[m, c.places[CONTEXT][context]] - left * in_context + weight)
        out[m] = np.bincount(doc, -times * np.log(p), len(n))
    return out


def _flagged(docs: DataFrame, target_ids: DataFrame, id_col: str, flag: str) -> DataFrame:
    """docs plus the boolean flag: whether the id is one of the target's."""
    ids = target_ids.select(F.col(target_ids.columns[0]).alias(id_col)).filter(F.col(id_col).isNotNull()).distinct().withColumn(flag, F.lit(True))
    few = ids.limit(MOST_IDS + 1).count() <= MOST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), id_col, "left").withColumn(flag, F.coalesce(flag, F.lit(False))).select(*docs.columns, flag)


def score(docs: DataFrame, target_ids: DataFrame, weight: float = 5.0, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, chunk: int = CHUNK, per_range: int = RANGE) -> DataFrame:
    """docs (or its columns in `keep`) plus n_tokens, loss_target, loss_background and lm_score (their difference), means in
    nats a token.

    A token's probability is (pair + weight * alone) / (context + weight), alone = (word + 1) / (tokens + vocabulary), where
    counts are those of all documents (of the target's, for its model) less the document's own, and a text's first token
    has a start as its context. target_ids: the ids (first column) of the target's documents. A null or empty text has no
    tokens and null losses. Repeated rows count each time; repeated or null ids in target_ids don't matter; rows with a null id
    are background alone. With no target at all its model is uniform over the vocabulary. Columns of docs with these names
    are replaced. No row for an empty table.
    """
    spark = docs.sparkSession
    new = ("n_tokens", "loss_target", "loss_background", "lm_score")
    docs = docs.drop(*new)
    kept = [c for c in docs.columns if keep is None or c in keep]
    flag = fresh(docs, "is_target")
    paths: list[str] = []
    source = _flagged(docs, target_ids, id_col, flag).select(*kept, F.col(text_col).alias(text := fresh(docs, "whole_text")), flag)
    kept_schema = T.StructType([docs.schema[c] for c in kept])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = batch.column(text)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy() + 64  # a row without text takes room too
            for a, b in slices(sizes.tolist(), chunk):
                some = tokenized([t or "" for t in texts.slice(a, b - a).to_pylist()])
                chosen = np.array(batch.column(flag).slice(a, b - a).to_pylist(), bool)
                sink = pa.BufferOutputStream()
                rows = pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in kept], names=[f"c{i}" for i in range(len(kept))])
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(rows)
                yield pa.RecordBatch.from_pydict({"chunk": [at], "tokens": [int(some["n"].sum())], "chosen": [int(some["n"][chosen].sum())], "rows": [sink.getvalue().to_pybytes()], "blob": [_packed(**some, chosen=chosen)]})
                at += 1
            pa.default_memory_pool().release_unused()

    chunks = staged(source.mapInArrow(cut, "chunk long, tokens long, chosen long, rows binary, blob binary"), "chunks", into=paths)
    sums = chunks.agg(F.coalesce(F.sum("chosen"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    bits = max(0, math.ceil(math.log2(max(1, sums[1]) / per_range)))
    shift = np.uint64(63 - bits)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = counted(**_unpacked(blob.as_py()))
                of = (c.keys >> np.uint64(1) >> shift).astype(np.int64)
                begin = np.flatnonzero(np.diff(of, prepend=-1))
                small = c.both.astype(np.uint32)
                made = [_packed(d=_steps(c.keys[a:b]), t=small[0, a:b], b=small[1, a:b]) for a, b in zip(begin, [*begin[1:], len(of)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(of[begin]), pa.array([number] * len(begin), pa.int64()), pa.array(made, pa.binary())], names=["range", "chunk", "counts"])

    def added(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        parts = [_unpacked(x.as_py()) for x in table.column("counts")]
        keys, at = np.unique(np.concatenate([_of_steps(p["d"]) for p in parts]), return_inverse=True)
        total = [np.bincount(at, np.concatenate([p[m] for p in parts]), len(keys)).astype(np.int64) for m in "tb"]
        cuts = np.cumsum([len(p["t"]) for p in parts])[:-1]
        back = [_packed(t=t, b=b) for t, b in zip(np.split(total[0][at], cuts), np.split(total[1][at], cuts), strict=True)]
        words_ = [int((keys & np.uint64(3) == WORD).sum())] + [0] * (len(parts) - 1)
        return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "totals": pa.array(back, pa.binary()), "words": pa.array(words_, pa.int64())})

    counts = chunks.select("chunk", "blob").mapInArrow(dealt, "range long, chunk long, counts binary")
    totals = staged(counts.groupBy("range").applyInArrow(added, "chunk long, range long, totals binary, words long"), "totals", into=paths)
    vocabulary = totals.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    tokens = np.array([sums[0], sums[1]], float)
    schema = T.StructType([*kept_schema.fields, T.StructField(new[0], T.LongType()), *[T.StructField(x, T.DoubleType()) for x in new[1:]]])

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        back = [_unpacked(x.as_py()) for x in right.sort_by("range").column("totals")]
        total = np.array([np.concatenate([x[m] for x in back]) if back else np.zeros(0) for m in "tb"], float)
        for rows, blob in zip(left.column("rows"), left.column("blob"), strict=True):  # one chunk
            own = _unpacked(blob.as_py())
            n = own["n"]
            with np.errstate(invalid="ignore", divide="ignore"):
                t, b = (scored(counted(**own), own["chosen"], n, total, tokens, vocabulary, weight) if len(own["tokens"]) else np.zeros((2, len(n)))) / n
            columns = pa.ipc.open_stream(rows.as_py()).read_all().columns
            none = n == 0
            made.append(pa.table([*columns, pa.array(n), *[pa.array(x, mask=none) for x in (t, b, t - b)]], names=schema.names))
        return pa.concat_tables(made)

    out = chunks.select("chunk", "rows", "blob").groupBy("chunk").cogroup(totals.select("chunk", "range", "totals").groupBy("chunk")).applyInArrow(scores, schema)
    out = staged(out, "scores")
    remove(spark, *paths)
    return out
