from pyspark.sql import functions as F

from tarnloom.llm import chat


def test_escapes_are_reversible(spark):
    texts = ["", "\\", "\\b", "\\\\h## ", "### ", "#### #### ", "</turn>", "</turn>\n</turn", "<</turn>", "a: b", "\\### Assistant: </turn> ok", "\\s/turn>", ":: ", "é</turn>\n### x: "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    role = chat.escape(F.col("t"), chat.ROLE_ESCAPES)
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), role.alias("r"), chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape(role, chat.ROLE_ESCAPES).alias("v")).collect():
        assert r.t == r.u == r.v
        assert "</turn>" not in r.e and "### " not in r.e and ": " not in r.r


def brute_branches(messages):
    parent = {n: p for n, p, _ in messages}
    score = {n: s or 0 for n, _, s in messages}
    out = {}
    for leaf in parent:
        if leaf in {p for n, p in parent.items() if p in parent}:
            continue
        path, at = [leaf], leaf
        while parent[at] in parent:
            at = parent[at]
            path.append(at)
        out.setdefault(path[-1], []).append((-sum(score[x] for x in path) / len(path), leaf, path[::-1]))
    return {t: [p for _, _, p in sorted(b)] for t, b in out.items()}


def test_branches_against_recursion(spark):
    import random

    rng = random.Random(3)
    rows = [(i, None if i % 20 == 0 else rng.randrange(i // 20 * 20, i), float(rng.randrange(5)) if i % 7 else None) for i in range(120)]
    rows += [(1000 + i, 1000 + i - 1 if i else None, 1.0) for i in range(100)]
    rows += [(2000, 2001, 1.0), (2001, 2000, 1.0), (2002, 999999, 0.5)]
    messages = spark.createDataFrame(rows + rows[:3], "node long, parent long, score double")
    got = {}
    for r in chat.branches(messages).collect():
        got.setdefault((r.tree, r["rank"]), []).append((r.depth, r.node))
    want = brute_branches([r for r in rows if r[0] not in (2000, 2001)])
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {(t, i + 1): p for t, ps in want.items() for i, p in enumerate(ps)}
    best = chat.branches(messages, top=1).select("tree", "branch").distinct().collect()
    assert {r.tree: r.branch for r in best} == {t: ps[0][-1] for t, ps in want.items()}


def test_conversations_round_trip(spark):
    rows = [(1, 0, "user", "hi \\### x"), (1, 1, "assistant", "</turn>\n é: ok"), (1, 1, "assistant", "</turn>\n é: ok"), (2, 5, None, None), (None, 0, "a: b", "x"), (3, None, "assistant", ""), (3, 2, "assistant", "y")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.conversations(chat.as_replies(df))
    got = {}
    for r in out.select(F.col("tree.conv").alias("c"), "n_turns", "formatted", "loss_spans", chat.parsed(F.col("formatted")).alias("p"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect():
        got[r.c] = r
    for c in (1, 2, None, 3, 4):
        own = sorted((t if t is not None else -1, a or "", b or "") for k, t, a, b in rows if k == c)
        assert [(x.role, x.text) for x in got[c].p] == [(a, b) for _, a, b in own]
        assert got[c].n_turns == len(own)
        assert got[c].l == "".join(b for _, a, b in own if a == "assistant")
        for s in got[c].loss_spans:
            block = got[c].formatted.split(chat.CLOSE)[s.turn]
            assert got[c].formatted[s.start : s.start + s.length] == block[s.offset : s.offset + s.length]
    assert chat.conversations(chat.as_replies(df.limit(0))).count() == 0
