import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text, urls


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://www.Example.com:80/a%20b/?utm_source=x&b=2&a=1#f", "https://example.com/a b?a=1&b=2"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com:8443/x+y/", "https://example.com:8443/x+y"),
        ("https://example.com/?ref=1&reference=2", "https://example.com/?reference=2"),
        ("https://example.com/%zz", "https://example.com/%zz"),
    ],
)
def test_canonical(spark, url, want):
    assert one(spark, url, urls.canonical_url) == want
    assert one(spark, want, urls.canonical_url) == want


@pytest.mark.parametrize(("host", "want"), [("www.a.b.co.uk", "b.co.uk"), ("x.github.io", "x.github.io"), ("a.x.github.io", "x.github.io"), ("docs.python.org", "python.org"), ("localhost", "localhost"), ("a.com.example", "com.example")])
def test_registrable(spark, host, want):
    assert one(spark, host, urls.registrable) == want


def test_addresses(spark):
    assert one(spark, "https://e.org/a/b.html", urls.section) == "/a"
    assert one(spark, "https://e.org/insights/", urls.section) == "/insights"
    assert one(spark, "https://e.org/", urls.section) == ""
    assert one(spark, "/de/x", urls.locale_of) == "de" and one(spark, "/dex/x", urls.locale_of) == ""
    assert one(spark, "https://e.org/d#dict.get", urls.anchor_terms) == ["dict.get", "dict get"]
    assert one(spark, "https://e.org/d#a", urls.anchor_terms) == []
    assert one(spark, "<http://e.org/a_(b)).>", urls.clean_url) == "https://e.org/a_(b)"
    assert one(spark, "https://www.google.com/search?q=x", urls.valid_url) is False
    assert one(spark, "https://www.docs.e.org/v1.2/x/latest/y", urls.unversioned) == "docs.e.org/x/y"


def test_words_and_grams(spark):
    assert one(spark, "Re-encoding dict.get C++ 日本語", text.tokens) == ["re-encoding", "dict.get", "c++", "日", "本", "語", "日本", "本語"]
    assert one(spark, 'how does "write ahead log" work in postgres', text.content_terms) == ['"write ahead log"', "postgres"]
    assert one(spark, "preise", text.grams) == ["^prei", "preis", "reise", "eise$"]
    assert one(spark, "über", text.fold) == "ueber" and one(spark, "café", text.fold) == "cafe"
    assert one(spark, "abc", text.grams) == []


def test_fits(spark):
    df = spark.createDataFrame([(["strompreise"], ["strompreisentwicklung", "2024"]), (["a", "b"], ["a", "b"]), (["art"], ["smart"])], "q array<string>, f array<string>")
    got = [r.y for r in df.select(text.field_fit(F.col("q"), F.col("f")).alias("y")).collect()]
    assert abs(got[0] - 0.85**0.75 * (0.85 / 2) ** 0.25) < 1e-9 or got[0] > 0.5
    assert got[1] == 1.0 and got[2] == 0.0


def test_dates_and_budget(spark):
    assert str(one(spark, "5 March 2021", text.parse_date)) == "2021-01-01"
    assert one(spark, "2020-02-30", text.parse_date).year == 2020
    day = F.lit("2024-01-01").cast("date")
    assert abs(one(spark, "2022-01-01", lambda c: text.freshness(text.parse_date(c), day)) - math.exp(-1)) < 1e-9
    assert one(spark, "a" * 9, text.count_tokens) == 2 and one(spark, "", text.count_tokens) == 0
    assert one(spark, "aaaa bbbb cccc dddd", lambda c: text.truncate(c, F.lit(3))) == "aaaa bbbb ..."


def test_queries_are_read(spark):
    assert one(spark, "restaurants in Berlin", text.guess_intent) == "local"
    assert one(spark, "restaurants in berlin", text.guess_intent) == "informational"
    assert one(spark, "wie ist das", text.guess_lang) == "de" and one(spark, "die hard", text.guess_lang) == "en"
    assert one(spark, "How to use a Python guide for HNSW indexes", lambda c: text.keyword_query(c, 2)) == "Python HNSW"
