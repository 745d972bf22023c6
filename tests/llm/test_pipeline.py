import collections

import corpus_pipeline as cp
from tarnloom.llm import decontam, langid, line_dedup, simhash
from tarnloom.llm.queries import table, tokenizer_path

from .test_simhash import brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, " 12 ! ", "en", "s", 6), (None, "the and of that with", "en", None, 20)], docs.schema)
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = table(spark, str(tmp_path), "documents"), []
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id: r.asDict() for r in docs.collect()} if i < 4 else docs.collect())
    raw = {r.doc_id: r for r in table(spark, str(tmp_path), "documents").collect()}
    model = langid.learn(spark.read.parquet(f"{tmp_path}/documents.parquet").filter(langid.fold(langid.F.col("doc_id")) != 0))
    judged = {r.doc_id: r for r in langid.identify(table(spark, str(tmp_path), "documents"), model).collect()}
    assert kept[0].keys() == {i for i, r in judged.items() if r.lang_pred != "und" and r.score >= 0.5}
    assert not {10**6, 10**6 + 1} & kept[0].keys() and len(kept[0]) >= len(raw) - 5

    found = collections.Counter(k for r in kept[0].values() for k in {line_dedup.line_key(x) for x in (r["text"] or "").encode().split(b"\n")})
    for i, r in kept[1].items():
        lines = [x for x in kept[0][i]["text"].split("\n") if not line_dedup.line_key(x.encode()) or found[line_dedup.line_key(x.encode())] < 10]
        assert r["text"] == "\n".join(lines) and r["n_chars"] == len(r["text"])
    assert kept[1].keys() == kept[0].keys()

    rows = sorted((10**9 if i is None else i, r["text"]) for i, r in kept[1].items())
    hashes = decontam.WordHashes()
    sets = [set(simhash.shingle_set(t.encode(), 5, hashes).tolist()) for _, t in rows]
    bits = [brute_fingerprint(t) for _, t in rows]
    alike = lambda i, j: len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j]))
    names = {i: {i} for i in range(len(rows))}  # groups at a looser and at a stricter similarity than the stage's
    strict = {i: {i} for i in range(len(rows))}
    for groups, least in ((names, 0.7), (strict, 0.9)):
        for i in range(len(rows)):
            for j in range(i):
                if groups[i] is not groups[j] and ((bits[i] ^ bits[j]).bit_count() <= 2 or alike(i, j) >= least):
                    groups[i] |= groups[j]
                    for x in groups[j]:
                        groups[x] = groups[i]
    left = {10**9 if i is None else i for i in kept[2]}
    assert {rows[min(g)][0] for g in names.values()} <= left <= {rows[min(g)][0] for g in strict.values()}

    items = [decontam.words((r.text or "").encode()) for r in table(spark, SF, "benchmark").collect()]
    windows = {tuple(w[j : j + min(10, len(w))]) for w in items if w for j in range(max(1, len(w) - 9))}
    for i, r in kept[2].items():
        w = decontam.words(r["text"].encode())
        hit = any(tuple(w[j : j + n]) in windows for n in {len(x) for x in windows} for j in range(len(w) - n + 1))
        assert hit != (i in kept[3])

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    own = collections.Counter()
    for p in kept[4]:
        own[p.doc_id] += p.length
    assert own == {i: len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in kept[3].items()}


def test_run_is_its_stages(spark):
    rows = cp.run(spark, SF).collect()
    at = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert at[0][:2] == (0, 0) and all(a * 2048 + b + n == c * 2048 + d for (a, b, n), (c, d, _) in zip(at, at[1:]))


def test_columns_that_clash_come_through(spark):
    docs = table(spark, SF, "documents").limit(20).withColumns({c: cp.F.lit(c) for c in ("score", "N_lines", "contaminated", "hits", "fp", "component")})
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert all(r[c] == c for r in out.collect() for c in docs.columns[5:])
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_rows_that_share_an_id_stay_apart(spark):
    rows = [(None, "one text about rivers and the boats on them"), (None, "another about hills and the sheep up there"), (None, None), (5, "five has a text of its own here"), (5, "and five has a second one, quite unlike"), (5, "and five has a second one, quite unlike"), (6, "five has a text of its own here"), (2, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], table(spark, SF, "documents").schema)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in cp.near_dedup(spark, docs, SF).collect()), key=str)
    assert got == sorted(((i is None, i or 0, t) for i, t in [rows[0], rows[1], rows[3], rows[4], rows[7]]), key=str)
