import zlib

import numpy as np
import pytest

from tarnloom.llm import packing
from tarnloom.llm.queries import tokenizer_path

TEXTS = [
    (1, "Hello world's  best\n\n  tea, isn't it?  "), (2, None), (3, ""), (4, "naïve café œuvre ŧ don't 123 45abc   x\u0085y"), (5, "日本語 текст <|endoftext|> done"),
    (6, " \t\r\n"), (6, " \t\r\n"), (None, "a" * 5000), (8, "word " * 3000), (9, "tab\tsep  two   three    \n end\x1cx"), (10, "₂₃ ½ 10² ‘quote’ — dash…"), (11, "it'S 'll 'LL x'd''s"),
]


@pytest.fixture(scope="module")
def pieces(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    return packing.pack(docs, tokenizer_path(), window=256).toPandas()


def test_ids_are_the_tokenizers(pieces):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    for doc_id, text in TEXTS:
        own = pieces[pieces.doc_id.isna() if doc_id is None else pieces.doc_id == doc_id].sort_values(["sequence_id", "offset"])
        got = np.frombuffer(b"".join(own.ids), "<u4").tolist()
        want = tok.encode(text or "", add_special_tokens=False).ids + [1]
        assert got == want * (2 if doc_id == 6 else 1), text


def test_windows_have_no_gaps(pieces):
    p = pieces.sort_values(["sequence_id", "offset"])
    at = p.sequence_id * 256 + p.offset
    assert at.iloc[0] == 0
    assert (at + p.length).iloc[:-1].tolist() == at.iloc[1:].tolist()
    assert (p.offset + p.length <= 256).all()


def test_sequences_and_crc(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    pieces = packing.pack(docs, tokenizer_path(), window=512)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(pieces).collect()}
    assert all(len(v) == 4 * 512 for k, v in whole.items() if k != max(whole))
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in pieces.collect())
    assert packing.pack(docs, tokenizer_path(), with_ids=False).columns == pieces.columns[:-1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, tokenizer_path()).count() == 0


def test_random_texts_against_the_tokenizer():
    import random

    from tokenizers import Tokenizer

    tok, encoder, rng = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path()), random.Random(1)
    alphabet = "ab Z09'’é\n\t  ,.- ß½²_s t r e"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert encoder.ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_runs_of_one_kind():
    from tokenizers import Tokenizer

    tok, encoder = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    n = 1_000_000
    for text in (" " * n, "\n" * n, "x" + "\t " * n + "y", " " * n + "word", "a " + "\xa0" * 300_000, "." * 100_000, "a" * 100_000):
        assert encoder.ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids, (text[:3], len(text))
