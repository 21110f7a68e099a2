import __spark_entry__ as entry
from corpusloom.plans import catalog, sqltext


def test_queries_without_statement_and_the_flagship_ask_with_whole_texts(spark, tmp_path):
    """The word that tells the documents apart is the item's tenth."""
    item = "one two three four five six seven eight nine zebra"
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(i, "one two three four five six seven eight nine " + ("zebra" if i == 20 else "lion") + "\nmore words here", "en", "s", 60) for i in range(1, 21)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    q = entry.queries()
    first = [r.doc_id for r in q["bm25_docs"](spark, str(tmp_path)).where("place = 1").collect()]
    assert first == [20]
    for name in ("select_windows", "passage_pool"):
        assert 20 in {r.doc_id for r in q[name](spark, str(tmp_path)).collect()}, name
    assert "d20" in {r.url for r in q["search_serp"](spark, str(tmp_path)).collect()}
    assert "list_slice" not in sqltext.TOP


def test_gram_overlap_reads_to_the_end(spark, tmp_path):
    """The only word in common stands last, after hundreds of others."""
    rest = " ".join(["filler"] * 300)
    rows = [(1, f"elephant\n{rest} elephant"), (2, f"elephant\n{rest}"), (3, None), (4, "one line")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.overlap for r in entry.queries()["gram_overlap"](spark, str(tmp_path)).collect()}
    assert got[1] > 0.5 and got[2] == got[3] == got[4] == 0.0


def test_relevance_floor_keeps_the_order_of_whole_scores(spark, monkeypatch):
    """The three rows share their first four digits."""
    rows = [(1, "a", "s", 0.50001, 0.0), (1, "b", "t", 0.50003, 0.0), (1, "c", "u", 0.50002, 0.0), (1, "d", "u", 0.4, 0.0)]
    monkeypatch.setattr(catalog, "_scored", lambda spark, sf_dir: spark.createDataFrame(rows, "query_id int, url string, source string, score double, relevance double"))
    got = entry.queries()["relevance_floor"](spark, "")
    assert [r.url for r in got.orderBy("place").collect()] == ["b", "c", "a"]


def test_relevance_floor_takes_repeated_rows_as_its_sql_does(spark, monkeypatch):
    """A document that is there four times takes all three places."""
    rows = [(1, "a", "s", 0.5, 0.0)] * 4 + [(1, "b", "t", 0.4, 0.0)]
    monkeypatch.setattr(catalog, "_scored", lambda spark, sf_dir: spark.createDataFrame(rows, "query_id int, url string, source string, score double, relevance double"))
    got = entry.queries()["relevance_floor"](spark, "")
    assert sorted((r.place, r.url) for r in got.collect()) == [(1, "a"), (2, "a"), (3, "a")]
