import datetime as dt

import pytest

from corpusloom.engine import Engine, Options
from corpusloom.operators import extract
from corpusloom.streaming import deadline

PAGE = "<html lang='en'><head><title>{t}</title></head><body><article><h1>{t}</h1><p>{b}</p><p><a href='https://e.org/deep/tungsten-melting-point'>tungsten melting point</a></p></article></body></html>"


def corpus(spark):
    rows = [
        (1, "https://e.org/tungsten", PAGE.format(t="Tungsten melting point", b="Tungsten melts at 3422 degrees. " * 20)),
        (2, "https://e.org/iron", PAGE.format(t="Iron facts", b="Iron is a metal that melts. " * 20)),
        (3, "https://f.org/music", PAGE.format(t="Music today", b="Songs and bands play here. " * 20)),
        (4, "https://e.org/deep/tungsten-melting-point", PAGE.format(t="Melting point of tungsten", b="Deep page on tungsten. " * 20)),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_search_without_and_with_plans(spark):
    eng = Engine(extracted=extract.pages(corpus(spark)).cache())
    q = spark.createDataFrame([(7, "tungsten melting point")], "query_id int, query string")
    got = eng.search(q, today="2024-01-01").orderBy("place").collect()
    assert got and "tungsten" in got[0].url and got[0].relevance > 0.5 and "ungsten" in got[0].snippet
    plans = spark.createDataFrame([(7, "I reference\nU 0.9 https://e.org/iron\nH https://e.org/tungsten\nU 0.8 https://nowhere.org/x")], "query_id int, raw string")
    got = {r.url for r in eng.search(q, plans=plans, today="2024-01-01").collect()}
    assert "https://e.org/deep/tungsten-melting-point" in got and "https://nowhere.org/x" not in got
    deny = spark.createDataFrame([("e.org",)], "domain string")
    assert all("e.org" not in r.url for r in eng.search(q, deny=deny, today="2024-01-01").collect())


def test_options():
    with pytest.raises(ValueError):
        Options(depth="endless")
    with pytest.raises(ValueError):
        Options(top_k=0)


def test_deadline_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, 1, t0, 1.0), (1, 2, t0 + dt.timedelta(seconds=5), 3.0), (1, 3, t0 + dt.timedelta(seconds=50), 9.0), (2, 4, t0, 2.0), (2, 5, t0 + dt.timedelta(seconds=1), 5.0)]
    df = spark.createDataFrame(rows, "query_id long, event_id long, ts timestamp, score double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = deadline.collected(deadline.deadline_serp(s, 10), "t_serp", "append", str(tmp_path / "ck")).collect()
    assert {(r.query_id, r.place, r.event_id, r.closed_by) for r in got if r.query_id == 1} == {(1, 1, 2, "arrival"), (1, 2, 1, "arrival")}
    assert {r.event_id for r in got if r.query_id == 2} in (set(), {4, 5})
