"""Packing: concatenate and cut.

Pass 1 tokenises each partition and numbers its tokens from 0; the staged table keeps, for each document, its partition,
its start there and its ids. Pass 2 adds up the partitions' totals (one small row each) to global offsets. After that each
document knows where it lies in the concatenation of all documents, and is cut at multiples of the window without moving
any row. Documents that cross a window's edge give boundary pieces, which meet by sequence_id only if whole sequences are
asked for.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, staged

#: The byte-level BPE's way to cut a text into pieces that are merged each on its own (fixed value, of the public vocabulary).
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Other characters than these (letters and signs up to U+024F and general punctuation, which all libraries class alike), a
#: special token's beginning, or a run of white space that the fast encoder's pattern may not get through: such texts are
#: encoded by the tokenizer itself.
_ODD = re.compile("[^\\t-\\r -~¡-ɏ‐-‧]|<\\||[\\s\\x1c-\\x1f\\x85\\xa0]{2000}")
#: Bytes of text, or of ids, that a task turns into one batch of rows, about.
_BATCH = 4 << 20


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """A byte-level BPE's tokens as bytes, by id; None unless it is one whose merges stand in the order of ids."""
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # stand for themselves; the other bytes follow from U+0100
    back = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in pairs]
    special = {t["content"] for t in spec["added_tokens"]}
    if ids != sorted(ids) or len(set(ids)) != len(ids) or max((model["vocab"][c] for c in back), default=0) > min(ids, default=256):
        return None
    return {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in special}


class Encoder:
    """The ids that tokenizers' encode(text, add_special_tokens=False) gives.

    For a byte-level BPE, texts of common characters are merged by tiktoken from the same vocabulary, five times as fast.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            ranks = byte_ranks(json.load(f))
        self.fast = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or _ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its ids (binary: little-endian unsigned 32-bit) with end_id after them, and its place in its partition.

    Columns: id_col, part, start_in_part, doc_tokens, ids. A null text is empty: its ids are end_id alone. Repeated rows and
    null ids are documents like any other.
    """
    source = docs.select(F.col(id_col), F.col(text_col))
    kind = source.schema.fields[0]
    schema = T.StructType([kind, T.StructField("part", T.IntegerType()), T.StructField("start_in_part", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for begin, end in slices((pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy() + 64).tolist(), _BATCH):
                some = batch.slice(begin, end - begin)
                ids = [x.astype("<u4").tobytes() + last for x in map(encoder.ids, (x or "" for x in some.column(1).to_pylist()))]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([part] * len(n), pa.int32()), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents' tokens, in one row of windows: a row per piece of a document that lies in one window.

    Columns: id_col, start (the document's ids before the piece), length, doc_tokens, sequence_id, offset (in the window),
    ids_crc32 (of the ids' bytes), and with_ids also ids (binary, little-endian unsigned 32-bit). Only the last window can be
    short. Nulls and repeats: see tokenized(); an empty table gives no piece.
    """
    tokens = staged(tokenized(docs, tokenizer, end_id, id_col, text_col), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    # a row for each partition of the input: small beside it by construction, so that one task can add them up
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    placed = tokens.join(F.broadcast(before), "part").select(F.col(id_col), (F.col("before") + F.col("start_in_part")).alias("at"), "ids")
    kind = placed.schema.fields[0]
    names = ["start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]
    schema = T.StructType([kind, *[T.StructField(x, T.LongType()) for x in names], *[T.StructField("ids", T.BinaryType())] * with_ids])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices((pc.binary_length(batch.column(2)).to_numpy() + 64).tolist(), _BATCH):
                some = batch.slice(begin, end - begin)
                at = some.column(1).to_numpy()
                ids = some.column(2).to_pylist()
                n = np.array([len(x) // 4 for x in ids], np.int64)
                first, last = at // window, (at + n - 1) // window
                count = last - first + 1
                row = np.repeat(np.arange(len(n)), count)
                seq = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
                lo = np.maximum(seq * window, at[row])
                hi = np.minimum((seq + 1) * window, (at + n)[row])
                start, length = lo - at[row], hi - lo
                pieces = [ids[r][4 * s : 4 * (s + k)] for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                crc = pa.array([zlib.crc32(x) for x in pieces], pa.int64())
                made = [some.column(0).take(pa.array(row)), *map(pa.array, (start, length, n[row], seq, lo - seq * window)), crc]
                yield pa.RecordBatch.from_arrays([*made, *[pa.array(pieces, pa.binary())] * with_ids], names=schema.names)

    return placed.mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole windows: sequence_id and ids (binary), from the pieces that meet there; at most a window's ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
