"""The corpus pipeline: from raw documents to packed training sequences, one operator of tarnloom.llm a stage.

Each stage but the last returns the columns of documents; each is written as Parquet and read again as the next one's input.
Where a stage changes a text, n_chars is the new text's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnloom.llm import decontam, langid, line_dedup, packing, simhash, suffix_dedup
from tarnloom.llm.common import staged
from tarnloom.llm.queries import table, tokenizer_path

#: Documents whose main language labels less of their letters than this are rejected, as are those without a language.
LEAST_SHARE = 0.5
#: Jaccard similarity of five-word shingles from which documents are near-duplicates.
SIMILARITY = 0.8


def apart(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], *made: str) -> DataFrame:
    """operator's result for docs; where docs has columns by the names that the operator makes, they come back as own_..."""
    return operator(docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c.lower() in made}))


def as_before(out: DataFrame, docs: DataFrame, *made: str) -> DataFrame:
    """docs' columns in out, by their own names."""
    return out.select(*[F.col(f"own_{c}").alias(c) if c.lower() in made else F.col(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one language labels LEAST_SHARE of the letters. The model is fitted on labelled documents of the
    same input, without the fold that measures it."""
    model = langid.learn(docs.filter(langid.fold(F.col("doc_id")) != 0).select("text", "lang"))
    made = ("lang_pred", "score")
    judged = apart(docs, lambda d: langid.identify(d, model), *made)
    return as_before(judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)), docs, *made)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are found in ten documents or more. What is left may be empty."""
    made = ("n_lines", "n_dropped")
    out = apart(docs, lambda d: line_dedup.drop_frequent_lines(d, min_docs=10, min_chars=1), *made)
    return as_before(out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)), docs, *made)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; of rows equal in id and text, one.

    Near-duplicates link as in op7_simhash or by a similarity of SIMILARITY of their sets of five-word shingles. Rows are told
    apart by a number in the order of ids, nulls last, so that an id which several texts share, or none, stands for no
    other row. Kept numbers grow as the documents do, so they are never broadcast.
    """
    own, number = suffix_dedup.numbered(docs, "doc_id", "text")
    groups = simhash.near_duplicates(own.select(number, "text"), id_col=number, similarity=SIMILARITY)
    kept = staged(groups.filter(F.col(number) == F.col("component")).select(number), "kept-numbers")
    once = kept.distinct()
    out = own.join(once.hint("merge"), number, "left_semi")
    return (out if kept.count() == once.count() else out.dropDuplicates([number])).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    made = ("n_words", "hit_runs", "n_hit", "hit_items", "contaminated")
    hits = apart(docs, lambda d: decontam.contamination(d, table(spark, sf_dir, "benchmark"), window=10), *made)
    return as_before(hits.filter(~F.col("contaminated")), docs, *made)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of 2048: a row per piece."""
    pieces = packing.pack(docs.select("doc_id", "text"), tokenizer_path(), window=2048, end_id=1, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: No SQL: fingerprints need XXH64 and packing a tokenizer. tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
