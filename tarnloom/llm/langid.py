"""Language identification of mixed-language text.

A word's script narrows its languages to those seen in that script; character n-grams score the word for each; Viterbi over
the words, with a penalty for each change of language, labels spans. Documents of a batch are decoded side by side, a word
of each at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, slices

#: First code points of blocks with letters, and their script (fixed values of the Unicode standard; a block ends where the next begins).
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
)
_STARTS = [a for a, _ in SCRIPTS]
_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
GRAMS = (2, 3)


def script(word: str) -> str:
    """The script of a word's first letter."""
    return SCRIPTS[max(0, bisect_right(_STARTS, ord(word[0])) - 1)][1]


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)]


def fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


class Model:
    """Log probabilities of n-grams by language, and the languages that each script leaves."""

    def __init__(self, langs: list[str], table: dict[str, list[int]], scripts: dict[tuple[str, str], int], smooth: float = 0.5, least_share: float = 0.001):
        self.langs = langs
        counts = np.array([table[g] for g in sorted(table)], float).reshape(len(table), len(langs))
        total = counts.sum(axis=0) + smooth * (len(table) + 1)
        self.rows = {g: i for i, g in enumerate(sorted(table))}
        self.log = np.log(np.vstack([counts + smooth, np.full(len(langs), smooth)]) / total)  # the last row: n-grams not seen
        letters = Counter()
        for (lang, _), n in scripts.items():
            letters[lang] += n
        self.scripts = {s: i for i, s in enumerate(sorted({s for _, s in scripts}))}
        self.allowed = np.array([[scripts.get((x, s), 0) >= least_share * max(1, letters[x]) for x in langs] for s in sorted(self.scripts)] + [[False] * len(langs)])

    def words(self, words: list[str]) -> np.ndarray:
        """Each language's log posterior (equal priors) for each word, not under -12; zeros where the script is unknown."""
        if not words:
            return np.zeros((0, len(self.langs)))
        get, unseen = self.rows.get, len(self.rows)
        each = [grams(w) for w in words]
        at = np.fromiter((get(g, unseen) for gs in each for g in gs), np.int32)
        n = np.array([len(gs) for gs in each], np.int64)
        allowed = self.allowed[[self.scripts.get(script(w), -1) for w in words]]
        s = np.where(allowed, np.add.reduceat(self.log[at], np.cumsum(n) - n), -1e9)
        s -= s.max(axis=1)[:, None]
        s -= np.log(np.exp(s).sum(axis=1))[:, None]
        return np.where(allowed.any(axis=1)[:, None], np.maximum(s, -12.0), 0.0)


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = 1500) -> Model | None:
    """Fit on max_docs different labelled texts of each language at most, whole: those with the smallest hashes.

    A threshold that about twice as many texts pass keeps all others where they are. All n-grams of these texts are kept, so the
    model's size has a bound that max_docs and the number of languages give. Rows with null text or language are not used.
    None if nothing is left to learn from.
    """
    some = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    hashed = some.withColumn("h", F.xxhash64("text", "lang"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    share = F.least(F.lit(1.0), 2.0 * max_docs / F.col("n"))
    most = sizes.select("lang", (-float(1 << 63) + share * float((1 << 64) - 1025)).cast("long").alias("most"))
    passed = hashed.join(F.broadcast(most), "lang").filter(F.col("h") <= F.col("most")).dropDuplicates(["lang", "h"])  # a row a language
    ranked = passed.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    some = ranked.filter(F.col("r") <= max_docs).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            words: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
            for lang, own in words.items():
                for w, n in own.items():
                    found[lang, "s", script(w)] += n * len(w)
                    for g in grams(w):
                        found[lang, "g", g] += n
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([found[k] for k in keys], pa.int64())], names=["lang", "kind", "key", "n"])

    counts = some.mapInArrow(count, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    by_key = counts.groupBy("kind", "key").agg(F.collect_list(F.struct("lang", "n")).alias("by")).collect()
    langs = sorted({x.lang for r in by_key for x in r.by})
    if not langs:
        return None
    place = {x: i for i, x in enumerate(langs)}
    table = {}
    for r in by_key:
        if r.kind == "g":
            table[r.key] = own = [0] * len(langs)
            for x in r.by:
                own[place[x.lang]] = x.n
    return Model(langs, table, {(x.lang, r.key): x.n for r in by_key if r.kind == "s" for x in r.by})


class Decoder:
    """A model with remembered words."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self._forget()

    def _forget(self) -> None:
        new = self.new = []

        class Known(dict):
            def __missing__(self, word: str) -> int:
                self[word] = at = len(self)
                new.append(word)
                return at

        self.known = Known()
        self.scores, self.letters, self.placed = np.zeros((0, len(self.model.langs))), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def codes(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        return np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))

    def _learn_words(self) -> None:
        """Score the words that codes() has met for the first time."""
        if self.new:
            letters = np.array([sum(map(str.isalpha, w)) for w in self.new], np.int64)
            scores = np.vstack([self.model.words(self.new[i : i + 20_000]) for i in range(0, len(self.new), 20_000)])
            scores[letters == 0] = 0
            known = self.model.allowed[[self.model.scripts.get(script(w), -1) for w in self.new]].any(axis=1)
            self.scores, self.letters = np.vstack([self.scores, scores]), np.append(self.letters, letters)
            self.placed = np.append(self.placed, letters * known)  # letters of words in a script that some language has
            self.new.clear()

    def labels(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """The language of each word of each document: the path with the largest sum of scores less penalties."""
        self._learn_words()
        n = np.array([len(d) for d in docs], np.int64)
        order = np.argsort(-n, kind="stable")
        begin = np.cumsum(n[order]) - n[order]
        flat = np.concatenate([docs[i] for i in order]) if len(docs) else np.zeros(0, np.int32)
        steps = int(n.max()) if len(n) else 0
        active = np.searchsorted(-n[order], -np.arange(steps), "left")  # documents with a word number t
        value = np.zeros((len(docs), len(self.model.langs)))
        switched = np.zeros((len(flat), value.shape[1]), bool)
        came_from = np.zeros(len(flat), np.int16)
        rows = np.arange(len(docs))
        for t in range(steps):
            a = active[t]
            at = begin[:a] + t
            v = value[:a]
            if t:
                best = v.argmax(axis=1)
                top = v[rows[:a], best][:, None]
                v -= top
                jump = v < -self.penalty
                switched[at], came_from[at] = jump, best
                np.maximum(v, -self.penalty, out=v)
            v += self.scores[flat[at]]
        label = np.zeros(len(flat), np.int16)
        now = value.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            a = active[t]
            at = begin[:a] + t
            own = now[:a]
            label[at] = own
            now[:a] = np.where(switched[at, own], came_from[at], own)
        out: list = [None] * len(docs)
        for i, b in zip(order.tolist(), begin.tolist(), strict=True):
            out[i] = label[b : b + len(docs[i])]
        return out

    def trim(self) -> None:
        if len(self.known) > 200_000:
            self._forget()


_decoders: dict[tuple, Decoder] = {}


def decoder_of(key: tuple, model: Callable[[], Model], penalty: float) -> Decoder:
    """One decoder for all tasks of a Python worker that have the same key."""
    if key not in _decoders:
        _decoders.clear()
        _decoders[key] = Decoder(model(), penalty)
    return _decoders[key]


def identify(docs: DataFrame, model: Model | None, penalty: float = 8.0, spans: bool = False, text_col: str = "text") -> DataFrame:
    """docs plus lang_pred and score, and with spans also lang_spans (array of begin, end, lang in code points).

    lang_pred labels most letters (ties: the first by name); score is the share of letters that it labels, so mixed text
    scores lower. Words in a script that no learned language has count for none: a text of nothing else scores 0. Null text, text without a letter, or no model: "und" with score 0. Columns of docs with these names are
    replaced.
    """
    docs = docs.drop("lang_pred", "score", *["lang_spans"] * spans)
    span_type = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *[T.StructField("lang_spans", T.ArrayType(span_type))] * spans]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = (docs.sparkSession.sparkContext.applicationId, sent._jbroadcast.id(), penalty)

    def run(batch: pa.RecordBatch) -> list:
        if sent.value is None:
            return [[UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows, *[[[]] * batch.num_rows] * spans]
        decoder = decoder_of(key, lambda: sent.value, penalty)
        column = batch.column(text_col)
        langs = decoder.model.langs
        pred, score, found = [UNKNOWN] * len(column), [0.0] * len(column), [None] * len(column)
        # documents of like length together, a few MB at a time: as many steps as the longest has words
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy()
        order = np.argsort(sizes, kind="stable")
        for a, b in slices(sizes[order].tolist(), 4 << 20):
            decoder.trim()
            rows = order[a:b].tolist()
            codes = [decoder.codes(column[i].as_py() or "") for i in rows]
            for i, c, label in zip(rows, codes, decoder.labels(codes), strict=True):
                letters = np.bincount(label, decoder.placed[c], len(langs)) if len(c) else np.zeros(1)
                total = decoder.letters[c].sum()
                if total:
                    top = int(letters.argmax())
                    pred[i], score[i] = langs[top], float(letters[top] / total)
                if spans:
                    at = [m.span() for m in _WORD.finditer((column[i].as_py() or "").lower())]
                    cuts = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(label)] if len(label) else [0]
                    found[i] = [{"begin": at[x][0], "end": at[y - 1][1], "lang": langs[label[x]]} for x, y in zip(cuts, cuts[1:], strict=False)]
        return [pred, score, *[found] * spans]

    return add_columns(docs, fields, run)
