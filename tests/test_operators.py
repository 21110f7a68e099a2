import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import dedup, expand, extract, passages, ranking, serp
from corpusloom.plans import recall
from corpusloom.sources import routes, stores


def test_greedy_list(spark):
    rows = [(1, f"u{i}", "s" if i < 6 else f"h{i}", 1.0 - i / 100, 0.9 if i < 8 else 0.1, 404 if i == 6 else 200, 2 if i == 9 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "query_id int, url string, site string, score double, relevance double, status int, pinned int")
    got = [r.url for r in serp.assembled(df, k=6, cap=2).orderBy("place").collect()]
    assert got == ["u0", "u9", "u1", "u2", "u3", "u7"]  # two of a site, then three more; no u6 (gone), no u8 (below the floor)


def test_greedy_list_orders_rows_of_one_shown_score_by_their_whole_score(spark):
    """search_serp: ``a`` and ``b`` are shown as 0.5, ``c`` is of the second pass."""
    rows = [(1, "a", "s", 0.50001), (1, "b", "t", 0.50002), (1, "c", "t", 0.50003), (1, "0", "t", 0.50004), (1, "d", "u", 0.4)]
    df = spark.createDataFrame([(*r, 0.9) for r in rows], "query_id int, url string, site string, score double, relevance double")
    got = [(r.url, r.score) for r in serp.assembled(df, k=5, cap=2).orderBy("place").collect()]
    assert got == [("0", 0.5), ("c", 0.5), ("a", 0.5), ("b", 0.5), ("d", 0.4)]


def test_dedup_keeps_longest_and_is_idempotent(spark):
    rows = [(1, 0, "http://e.org/a/", "xx"), (1, 1, "https://www.e.org/a", "xxxx"), (1, 2, "https://e.org/b", "y"), (2, 0, "https://e.org/a", "z")]
    df = spark.createDataFrame(rows, "query_id int, arrival int, url string, text string")
    once = dedup.by_address(df)
    assert {(r.query_id, r.url, r.consensus, r.arrival) for r in once.collect()} == {(1, "https://www.e.org/a", 2, 0), (1, "https://e.org/b", 1, 2), (2, "https://e.org/a", 1, 0)}
    assert dedup.by_address(once.drop("url_key")).count() == 3


def test_budget(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (1, 3, 10), (2, 1, 99)], "query_id int, place int, cost int")
    assert {(r.query_id, r.place, r.shrink) for r in serp.budget_prefix(df, 25).collect()} == {(1, 1, False), (1, 2, False), (2, 1, True)}


def test_judgement(spark):
    a = spark.createDataFrame([(1, "Answer.\nPAGES: 3, 1, 9, 3\n"), (2, "none")], "query_id int, answer string")
    got = {r.query_id: (r.pages, r.body) for r in serp.parse_judgement(a, 5).collect()}
    assert got[1] == ([3, 1], "Answer.") and got[2][1] == "none"
    res = spark.createDataFrame([(1, i) for i in range(1, 6)], "query_id int, place int").withColumn("was", F.col("place"))
    out = serp.judged(res, serp.parse_judgement(a, 5).select("query_id", "pages"), read=4, keep=2)
    assert [r.was for r in out.orderBy("place").collect()] == [3, 1, 5]


def test_windows_cover_terms():
    body = "Filler sentence here. " * 60 + "The tungsten melting point is 3422 degrees. " + "Filler sentence here. " * 60
    parts, before, after = passages.dense_windows(body, "", ["tungsten", "melting"], 300)
    assert "3422" in parts[0][0] and parts[0][1] == 1.0 and before and after
    assert passages.dense_windows("short", "", ["x"], 300) == ([("short", 1.0)], False, False)
    assert passages.dense_windows("", "seed text", [], 4)[0] == [("seed", 0.0)]
    two, _, _ = passages.dense_windows(body, "", ["tungsten", "filler"], 900, 2)
    assert 1 <= len(two) <= 2


def test_sentence_windows():
    out = passages.sentence_windows(("A sentence of some length here. " * 100))
    assert len(out) == 6 and all(len(w) >= 620 for w in out)
    assert passages.sentence_windows(" x ") == ["x"] and passages.sentence_windows("") == []


def test_extract_page():
    html = """<html lang="en"><head><title> A  page </title><meta name="description" content="About it."><meta property="article:published_time" content="2024-03-01T00:00">
    <link rel="canonical" href="/a"></head><body><nav><a href="/home">Home</a></nav><div class="sidebar">side words</div>
    <article><h1>Head</h1><p>%s <a href="/next?x=1#f">next page</a></p></article><form role="search" action="/find"><input name="q"></form><footer>foot</footer></body></html>""" % ("Some prose here. " * 40)
    p = extract.page(html, "https://www.e.org/a/b")
    assert (p["title"], p["description"], p["published"][:10], p["lang"], p["canonical"]) == ("A page", "About it.", "2024-03-01", "en", "https://www.e.org/a")
    assert "Some prose here." in p["text"] and "side words" not in p["text"] and "foot" not in p["text"]
    assert [x[0] for x in p["links"]] == ["https://www.e.org/next?x=1", "https://www.e.org/home"]
    assert p["search_url"] == "https://www.e.org/find?q={}" and p["favicon"] == "https://www.e.org/favicon.ico"
    assert extract.page(None, None)["text"] == ""


def test_weights():
    with pytest.raises(ValueError, match="unknown ranking weights"):
        ranking.weights(F.lit("news"), F.lit("en"), F.lit(False), {"nope": 1.0})


def test_weight_layers(spark):
    df = spark.createDataFrame([("news", "en", False), ("news", "ja", False), ("informational", "en", True)], "i string, l string, r boolean")
    w = ranking.weights(F.col("i"), F.col("l"), F.col("r"))
    got = df.select(w["ce"].alias("ce"), w["fresh"].alias("fresh")).collect()
    assert [tuple(r) for r in got] == [(0.9, 0.45), (0.35, 0.45), (1.0, 0.28)]


def test_routes(spark):
    bodies = [
        ("wikipedia", 200, '{"query":{"search":[{"title":"Write ahead","snippet":"a <b>b</b> &amp; c"}]}}'),
        ("reddit", 200, '{"data":{"children":[{"data":{"permalink":"/r/x/1","title":"T","selftext":"s","ups":300}}]}}'),
        ("github", 200, '{"items":[{"html_url":"https://github.com/a/b","full_name":"a/b","stargazers_count":4900},{"html_url":"u","full_name":"c","stargazers_count":3}]}'),
        ("hn", 503, "{}"), ("npm", 200, "not json"),
    ]
    df = spark.createDataFrame([(1, *b) for b in bodies], "query_id int, route string, status int, body string")
    got = {r.source: r for r in routes.parsed(df).collect()}
    assert set(got) == {"route:wikipedia", "route:reddit", "route:github"}
    assert got["route:wikipedia"].url == "https://en.wikipedia.org/wiki/Write_ahead" and got["route:wikipedia"].snippet == "a b & c"
    assert abs(got["route:reddit"].prior - 0.5) < 1e-9 and abs(got["route:github"].prior - 0.82) < 1e-9


def test_sitemaps_and_stores(spark):
    b = spark.createDataFrame([("e.org", "<urlset><url><loc> https://e.org/a?x=1&amp;y=2 </loc></url><loc>ftp://no</loc></urlset>")], "host string, body string")
    r = stores.sitemap_urls(b).first()
    assert r.locs == ["https://e.org/a?x=1&y=2"] and r.is_index is False
    b = spark.createDataFrame([("www.e.org", "User-agent: *\nSitemap: https://cdn.e.org/s.xml\nsitemap: /rel\nSitemap: https://other.com/s.xml")], "host string, body string")
    assert stores.robots_sitemaps(b).first().sitemaps == ["https://cdn.e.org/s.xml"]


def test_json_plans(spark):
    raw = '{"candidates":["https://a.example.com/x",{"url":"http://b.example.com/y","prior":0.9,"reason":"r"},{"url":"bad"},"https://a.example.com/x"]}'
    got = recall.from_json(spark.createDataFrame([(1, raw)], "query_id int, raw string")).orderBy("arrival").collect()
    assert [(r.url, r.prior, r.reason) for r in got] == [("https://a.example.com/x", 0.55, ""), ("https://b.example.com/y", 0.9, "r")]


def test_hub_links(spark):
    links = [(1, "https://e.org/reports/", f"https://e.org/reports/{i}-annual-report", f"annual report {i}", "") for i in range(7)] + [(1, "https://e.org/reports/", "https://e.org/jobs", "jobs", "")]
    df = spark.createDataFrame(links, "query_id int, src string, url string, anchor string, context string")
    q = spark.createDataFrame([(1, [["annual", "report"]], ["2024"])], "query_id int, vocabularies array<array<string>>, years array<string>")
    got = expand.follow_hubs(expand.scored_links(df, q.withColumn("years", F.array().cast("array<string>")))).collect()
    assert len(got) == 5 and all("report" in r.url and r.prior <= 0.75 for r in got)


def test_pages_of_one_address_give_the_smallest_row(spark):
    """pages_joined: the order in which rows of one spelling come changes nothing."""
    asked = spark.createDataFrame([(1, "https://e.org/a/")], "query_id int, url string")
    rows = [(9, "https://e.org/a", {"x": "y"}), (7, "https://e.org/a", {"x": "z"}), (8, "https://e.org/a", {"x": "y"}), (1, "https://e.org/a/", {})]
    for some in (rows, rows[::-1], rows[1:] + rows[:1]):
        pages = spark.createDataFrame(some, "page_id int, url string, headers map<string,string>").coalesce(1)
        assert [r.page_id for r in stores.pages_of(asked, pages).collect()] == [7]


def test_a_share_of_letters_of_just_0_55_is_prose(spark):
    """prose_factors: 0.55 * 660 is a little over 363 in doubles."""
    rows = [("a" * 363 + "%" * 297,), ("a" * 362 + "%" * 298,)]
    df = spark.createDataFrame(rows, "t string")
    assert [r.p for r in df.select(text.prose_factor(F.col("t")).alias("p")).collect()] == [1.0, 0.7]
    assert [passages.prose(t) for (t,) in rows] == [1.0, 0.7]
