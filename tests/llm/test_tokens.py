import random

from corpusloom.llm import tokens


def test_edits_match_a_full_recount():
    counts, rng = tokens.Counts(), random.Random(3)
    alphabet = ["a", "B", "é", " ", " ", "  ", "\n", "'", "'ll", "12", "!", "?!", "word", "\t", "日本", "'s"]
    for trial in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 60, 900])))
        doc = tokens.Counted(text, counts)
        for _ in range(12):
            a = rng.randrange(len(text) + 2)
            b = a + rng.choice([0, 0, 1, 3, 40, 500])
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 9, 700 if trial % 9 == 0 else 5])))
            doc.edit(a, b, new)
            text = text[:a] + new + text[max(a, b) :]
            assert doc.text() == text
            assert [p for i in range(len(doc.leaves)) for p in doc.leaf(i)[0]] == counts.cut(text)
            assert doc.n_tokens == counts.count(text) and doc.n_chars == len(text)


def test_small_edits_touch_little():
    counts = tokens.Counts()
    doc = tokens.Counted("some words here. " * 20000, counts)
    before = doc.encoded
    doc.edit(100_000, 100_004, "other")
    assert doc.encoded - before < 200


def test_odd_rows(spark):
    e = [(0, 2, None), None, (None, 3, "x"), (5, 2, "y"), (-4, 1, "zz")]
    df = spark.createDataFrame([(1, "hello world", e, 9), (1, "hello world", e, 9), (None, None, None, 1), (2, "", [(0, 9, "new text")], 1)], f"doc_id long, text string, edits {tokens.EDITS}, id int")
    got = sorted(map(tuple, tokens.edited_counts(df).collect()), key=str)
    want_text = "hello world"[2:]
    want_text = want_text[:5] + "y" + want_text[5:]
    want_text = "zz" + want_text[1:]
    c = tokens.Counts()
    by = {g[0]: g for g in got}
    assert len(got) == 4 and by[1][3] == 3 and by[1][4] == len(want_text) and by[1][5] == c.count(want_text)
    assert by[None][1:] == (0, 0, 0, 0, 0, 0) and by[2][5] == c.count("new text")
    assert tokens.edited_counts(df.limit(0)).count() == 0


def test_query_against_recount(spark, tmp_path):
    from corpusloom.llm import registry

    rows = [(i, t) for i, t in enumerate(["One two three, four.\nFive's six", "", None, "x" * 9000, "wörter und Wörter " * 400])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    edits = {r.doc_id: r.e or [] for r in df.select("doc_id", tokens.hashed_edits(df.doc_id, df.text).alias("e")).collect()}
    c = tokens.Counts()
    for r in registry.op10_token_counts(spark, str(tmp_path)).collect():
        t = dict(rows)[r.doc_id] or ""
        assert r.n_tokens == c.count(t)
        for s, e, new in edits[r.doc_id]:
            t = t[:s] + (new or "") + t[max(s, e) :]
        assert (r.n_tokens_after, r.n_chars_after) == (c.count(t), len(t))


def test_later_runs_encode_only_what_edits_touch(spark, tmp_path):
    rng = random.Random(6)
    texts = {1: "Some words, here. " * 800, 2: "", 3: "x" * 70000 + " end", 4: "wörter und Wörter\n" * 300, None: "a b"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    state = tokens.planted(df)
    c = tokens.Counts()
    assert {r.doc_id: r.n_tokens for r in state.collect()} == {i: c.count(t) for i, t in texts.items()}
    for k in range(3):
        state.select("doc_id", "text", "tree").write.parquet(f"{tmp_path}/{k}")
        edits = {i: [(a := rng.randrange(len(t) + 1), a + rng.choice([0, 2, 9]), rng.choice(["", "new", "one two "])) for _ in range(2)] for i, t in texts.items()}
        e = spark.createDataFrame([(i, x) for i, x in edits.items()], f"eid long, edits {tokens.EDITS}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        state = tokens.edited_counts(kept.join(e, kept["doc_id"].eqNullSafe(e["eid"])), tree_col="tree", with_state=True)
        for i, es in edits.items():
            for a, b, new in es:
                texts[i] = texts[i][:a] + new + texts[i][b:]
        rows = {r.doc_id: r for r in state.collect()}
        for i, t in texts.items():
            r = rows[i]
            assert (r.text, r.n_tokens_after, r.n_chars_after) == (t, c.count(t), len(t))
            assert r.n_planted == 0 and r.n_reencoded < 60
            assert tokens.Counted(t, c, bytes(r.tree)).encoded == 0
    stale = state.select("doc_id", "text", "tree", tokens.F.lit(None).cast(tokens.EDITS).alias("edits")).withColumn("text", tokens.F.concat("text", tokens.F.lit(" more")))
    got = tokens.edited_counts(stale, tree_col="tree", with_state=True).collect()
    assert all(r.n_tokens_after == c.count(texts[r.doc_id] + " more") and r.n_planted > 0 for r in got)


def test_large_deletions_and_insertions_are_linear():
    import time

    counts = tokens.Counts()
    for size in (300_000, 1_200_000):
        doc = tokens.Counted("some words here. " * (size // 17), counts)
        began = time.process_time()
        doc.edit(1000, doc.n_chars - 1000, "")
        doc.edit(500, 500, "inserted words " * 20_000)
        took = time.process_time() - began
        assert doc.n_tokens == counts.count(doc.text()) and took < 4
