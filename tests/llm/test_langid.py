import itertools

import numpy as np

from tarnloom.llm import langid

EN = "the quick brown fox jumps over the lazy dog and then it sleeps under the old tree with its friends while the others watch"
FR = "le renard brun saute par dessus le chien paresseux et puis il dort sous le vieil arbre avec ses amis pendant que les autres regardent"
RU = "быстрая лиса прыгает через ленивую собаку и потом спит под старым деревом вместе с друзьями"


def model(spark):
    rows = [(t, lang) for lang, text in (("en", EN), ("fr", FR), ("ru", RU)) for t in [text] * 3] + [(None, "en"), ("x", None), ("", "fr")]
    return langid.learn(spark.createDataFrame(rows, "text string, lang string"))


def test_spans_of_mixed_text(spark):
    m = model(spark)
    text = f"{EN}. {FR}! 123 {RU}"
    docs = spark.createDataFrame([(text, 1)], "text string, score int")
    r = langid.identify(docs, m, spans=True).first()
    assert [s.lang for s in r.lang_spans] == ["en", "fr", "ru"]
    assert text[r.lang_spans[1].begin : r.lang_spans[1].end] == FR


def test_hard_rows(spark):
    m = model(spark)
    rows = [(None,), ("",), ("123 !? _ ²",), ("日本語",), (EN * 300,), ("THE DOG",), (RU,)]
    got = [(r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, "text string").coalesce(1), m).collect()]
    assert got[:3] == [("und", 0.0)] * 3
    assert got[3][0] in m.langs and got[4][0] == got[5][0] == "en" and got[6][0] == "ru"
    assert all(0 <= s <= 1 for _, s in got)
    assert langid.identify(spark.createDataFrame([(EN,)], "text string"), langid.learn(spark.createDataFrame([], "text string, lang string"))).first().lang_pred == "und"
    assert langid.identify(spark.createDataFrame([], "text string"), m).count() == 0


def test_unseen_scripts_score_nothing(spark):
    rows = [(t, lang) for lang, text in (("en", EN), ("fr", FR)) for t in [text, text[:60]]]
    m = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    got = langid.identify(spark.createDataFrame([(RU,), ("привет мир",), (EN + " " + RU,)], "text string").coalesce(1), m).collect()
    assert all(r.lang_pred in m.langs for r in got) and [r.score for r in got[:2]] == [0.0, 0.0]
    letters = [sum(map(str.isalpha, t)) for t in (EN, RU)]
    assert got[2].lang_pred == "en" and np.isclose(got[2].score, letters[0] / sum(letters))


def test_each_language_is_sampled(spark):
    """A third of the rows is one text; a rare language is learned all the same, and each text counts once."""
    rows = [(EN, "en")] * 600 + [(f"{EN[i % 50 :]} number {i}", "en") for i in range(600)] + [(FR, "fr")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    m = langid.learn(docs, max_docs=40)
    assert m.langs == ["en", "fr"]
    assert langid.identify(spark.createDataFrame([(FR,)], "text string"), m).first().lang_pred == "fr"


def test_decoding_against_all_paths(spark):
    m = model(spark)
    decoder = langid.Decoder(m, 2.0)
    words = "the le chien fox дом dog sous".split()
    docs = [decoder.codes(" ".join(words[:n])) for n in (0, 7, 3, 1, 7)]
    for codes, label in zip(docs, decoder.labels(docs)):
        s = m.words(words)[: len(codes)]
        value = lambda path: sum(s[t][x] for t, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        best = max(map(value, itertools.product(range(3), repeat=len(codes))))
        assert np.isclose(value(label.tolist()), best)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = langid.learn(docs.filter(langid.fold(docs.doc_id) != 0))
    held = langid.identify(docs.filter(langid.fold(docs.doc_id) == 0), m)
    right, total = held.filter("lang_pred = lang").count(), held.count()
    assert right / total > 0.97
