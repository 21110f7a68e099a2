import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom import sinks
from corpusloom.engine import Engine
from corpusloom.operators import answers, content, extract, passages, serp
from corpusloom.plans import cases, plain
from corpusloom.sources import stores
from corpusloom.streaming import deadline


def greedy(rows, k, cap, floor, least):
    """The list taken row by row: (url, site, score, relevance, gone, pinned)."""
    order = lambda r: (r[5] is None, r[5] or 0, -r[2], r[0])
    rows = sorted((r for r in rows if not r[4] or r[5] is not None or all(x[4] for x in rows)), key=order)
    taken = []
    for more in (0, 3):
        for r in rows:
            if len(taken) < k and r not in taken:
                of_site = sum(t[1] == r[1] for t in taken)
                if r[5] is not None or (of_site < cap + more and (len(taken) < least or r[3] >= floor)):
                    taken.append(r)
    loose = sorted((r for r in taken if r[5] is None), key=lambda r: -r[2])
    for r in sorted((r for r in taken if r[5] is not None), key=lambda r: r[5]):
        loose.insert(min(r[5] - 1, len(loose)), r)
    return [r[0] for r in loose]


def test_lists_are_those_taken_row_by_row(spark):
    rng, rows = random.Random(3), []
    for q in range(120):
        pins = rng.sample(range(1, 9), rng.randrange(3))
        rows += [(q, f"u{i:02d}", rng.choice("abcdef"[: rng.choice([1, 3, 6])]), rng.choice([0.5, round(rng.random(), 4)]), rng.choice([0.0, 0.18, 0.5]), rng.choice([200, 200, 404]), pins.pop() if pins and rng.random() < 0.2 else None) for i in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "query_id int, url string, site string, score double, relevance double, status int, pinned int")
    for k, cap in ((8, 2), (5, 1)):
        got: dict = {}
        for r in serp.assembled(df, k, cap).collect():
            got.setdefault(r.query_id, {})[r.place] = r.url
        for q in range(120):
            want = greedy([(u, s, sc, rel, st == 404, p) for i, u, s, sc, rel, st, p in rows if i == q], k, cap, 0.18, 3)
            assert [got.get(q, {})[i + 1] for i in range(len(got.get(q, {})))] == want


def test_link_and_catalogue_queries_against_plain_code(spark):
    sf = "/root/testdata/sf0.001"
    vocabularies, years = [["thered", "anding"], ["nicht", "entier"]], ["2024"]
    pages = {r.url: r for r in extract.pages(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    links = {}
    for u, p in sorted(pages.items(), reverse=True):
        for x in p.links:
            links[x.url] = x
    words = lambda t: sorted({w.lower() for w in re.findall(r"[^\W_][\w+#.'-]*", t) if w.lower() not in plain.v.STOP and len(w) > 1})
    rows = entry.queries()["link_fit"](spark, sf).collect()
    assert {r.url for r in rows} == set(links)
    for r in rows:
        x = links[r.url]
        path = re.sub(r"[?#].*", "", "/" + x.url.split("/", 3)[3] if x.url.count("/") >= 3 else "")
        if "%" not in path and path.isascii():
            assert abs(r.fit - plain.link_fit(vocabularies, path, words(x.anchor), words(x.context), x.anchor, years)) < 1e-6, x


def test_pages_cut_to_their_budget(spark):
    n = lambda t: max(1, len(t) // 4) if t else 0

    def cut(t, most):
        if most <= 0 or not t:
            return ""
        if n(t) <= most:
            return t
        part = t[: most * 4]
        at = part.rfind(" ")
        return (part[:at] if at > 0.6 * len(part) else part).rstrip(" ") + " ..."

    rng, rows = random.Random(1), []
    for i in range(40):
        words = lambda k: " ".join("w" * rng.randrange(1, 9) for _ in range(k))
        rows.append((i, words(2), "https://e.org/" + "x" * rng.randrange(20), [words(rng.randrange(1, 30)) for _ in range(rng.randrange(4))], words(rng.randrange(60))))
    df = spark.createDataFrame(rows, "query_id int, title string, url string, passages array<string>, text string")
    for r in serp.fit_page(df, 30).collect():
        _, title, url, ps, text = rows[r.query_id]
        left, kept, done = 30 - n(title) - n(url), [], False
        for p in ps if left > 0 else []:
            if not done and left > 0 and n(p) <= left:
                kept, left = [*kept, p], left - n(p)
            elif not done and left > 0 and not kept:
                kept, left, done = [cut(p, left)], 0, True
        assert r.passages == kept
        assert r.text == cut(text, max(0, 30 - n(title) - n(url) - sum(map(n, kept))))


def test_windows_hold_what_they_claim():
    rng = random.Random(4)
    vocab = "tungsten melting point filler words and more of them here".split()
    for _ in range(60):
        body = " ".join(rng.choice(vocab) + rng.choice(["", "", "."]) for _ in range(rng.randrange(5, 900)))
        terms = rng.sample(vocab, 3)
        parts, before, after = passages.dense_windows(body, "", terms, 400, 2)
        assert 1 <= len(parts) <= 2 and all(p in body for p, _ in parts)
        assert body.startswith(parts[0][0]) or before
        long = [t for t in terms if len(t) >= 3]
        if len(body) > 400 and long:
            best = max(sum(t in body.lower()[i : i + 370] for t in long) for i in range(0, len(body), 10))
            assert max(s for _, s in parts) <= best / len(long) + 1e-3
    pool = passages.chosen_passages("Opening words here. " * 700 + "the tungsten melting point is 3422. " + "Closing words. " * 200, ["tungsten", "melting"])
    assert any("3422" in p for p in pool) and len(pool) <= 7


@pytest.mark.parametrize("html", ["<![foo bar]><p>x</p>", "<!doctype", "<a href='http://[x'>t</a>", "<link rel=canonical href='http://[x'>", "<p clas", "\x00", "<form action='http://[' role=search><input name=q></form>"])
def test_odd_pages_are_rows(html):
    assert isinstance(extract.page(html, "https://e.org/a")["text"], str) and isinstance(extract.page(html, "http://[bad")["text"], str)


def test_broken_bodies_are_rows():
    rng = random.Random(5)
    for _ in range(300):
        raw = bytes(rng.choice(b"<>!/[]-abc \"'=&;%()\\PDFBTjE\x00\xff") for _ in range(rng.randrange(80)))
        for kind in ("text/html", "application/json", "application/pdf", None):
            assert isinstance(content.page(raw, kind, "https://e.org/x.pdf")["text"], str)


PAGE = "<html><head><title>{t}</title></head><body><article><h1>{t}</h1><p>{b}</p>{l}</article></body></html>"


def corpus(spark):
    text = "Tungsten melts at 3422 degrees, the highest of all metals. " * 12
    link = "<p>See <a href='https://e.org/metals/tungsten-melting-point'>tungsten melting point</a> for more.</p>"
    rows = [(1, "https://e.org/metals/", PAGE.format(t="Metals", b="All metals are listed here. " * 30, l=link)), (2, "https://e.org/metals/tungsten-melting-point", PAGE.format(t="Tungsten melting point", b=text, l="")), (3, "https://f.org/tungsten", PAGE.format(t="Tungsten", b=text[:-50], l="")), (4, "https://g.org/second/tungsten-melting", PAGE.format(t="Tungsten melting again", b="Second round page on tungsten. " * 20, l=""))]
    return extract.pages(spark.createDataFrame(rows, "page_id long, url string, html string")).cache()


def test_further_pages_second_round_and_degraded_lists(spark):
    seen = []

    def refine(reports):
        seen.extend(reports.collect())
        return reports.where("query_id = 1").select("query_id", F.lit("U 0.9 https://g.org/second/tungsten-melting").alias("raw"))

    maps = spark.createDataFrame([("f.org", "https://f.org/tungsten"), ("f.org", "https://f.org/jobs")], "host string, loc string")
    eng = Engine(extracted=corpus(spark), sitemaps=maps, refine=refine)
    q = spark.createDataFrame([(1, "tungsten melting point"), (2, "nothing there"), (3, " ")], "query_id int, query string")
    plans = spark.createDataFrame([(1, "U 0.9 https://e.org/metals/\nU 0.8 https://f.org/tungsten-gone"), (2, "U 0.9 https://nowhere.org/x")], "query_id int, raw string")
    got = eng.search(q, plans=plans, rounds=2, today="2024-01-01").collect()
    urls = {r.url for r in got if r.query_id == 1}
    assert {"https://e.org/metals/tungsten-melting-point", "https://f.org/tungsten", "https://g.org/second/tungsten-melting"} <= urls
    assert [(r.place, r.url, r.score) for r in got if r.query_id == 2] == [(1, "https://nowhere.org/x", 0.0)]
    reports = {r.query_id: r for r in seen}
    assert any("e.org/metals" in f.url for f in reports[1].found) and reports[2].dead == ["https://nowhere.org/x"]
    shown = spark.createDataFrame([(1, "https://e.org/metals/tungsten-melting-point")], "query_id int, url string")
    assert "https://e.org/metals/tungsten-melting-point" not in {r.url for r in eng.search(q, plans=plans, shown=shown, page=2, today="2024-01-01").collect()}


def test_models_and_routes_are_plugged_in(spark):
    rerank = lambda w: w.select("query_id", "doc_id", F.when(F.contains("doc_id", F.lit("f.org")), 0.99).otherwise(0.2).alias("ce"))
    similar = lambda p: p.select("query_id", "doc_id", F.when(F.contains("doc_id", F.lit("f.org")), 0.9).otherwise(-0.5).alias("emb"))
    eng = Engine(extracted=corpus(spark), rerank=rerank, similar=similar)
    q = spark.createDataFrame([(1, "tungsten melting point")], "query_id int, query string")
    plans = spark.createDataFrame([(1, "U 0.5 https://e.org/metals/tungsten-melting-point")], "query_id int, raw string")
    body = '{"hits":[{"title":"Tungsten melting story","url":"https://f.org/tungsten","points":100},{"title":"Cooking","url":"https://e.org/metals/"}]}'
    answers_ = spark.createDataFrame([(1, "hn", 200, body)], "query_id int, route string, status int, body string")
    got = {r.place: r for r in eng.search(q, plans=plans, answers=answers_, follow=False, token_budget=200, today="2024-01-01").collect()}
    assert got[1].url == "https://f.org/tungsten" and got[1].relevance == 0.99 and got[1].source == "route:hn"
    assert "https://e.org/metals/" not in {r.url for r in got.values()}
    x = eng.extract(spark.createDataFrame([("https://f.org/tungsten",), ("https://none.org/",)], "url string"), query="tungsten")
    assert {(r.url, r.error, bool(r.passages)) for r in x.collect()} == {("https://f.org/tungsten", None, True), ("https://none.org/", "not found", False)}
    like = eng.like(spark.createDataFrame([("https://f.org/tungsten",)], "url string")).first()
    assert like.query == "Tungsten" and like.exclude == "f.org"


def test_option_rules():
    from corpusloom.engine import Options

    for bad in ({"page": 11}, {"freshness": "decade"}, {"freshness": "day", "after": "2024-01-01"}, {"rounds": 3}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_schemas_with_grounding():
    import json

    got = json.loads(answers.with_grounding({"type": "object", "properties": {"a": {"type": "string"}}}))
    assert set(got["json_schema"]["schema"]["properties"]) == {"a", "_grounding"}
    with pytest.raises(ValueError):
        answers.with_grounding({"properties": {}})
    with pytest.raises(ValueError):
        answers.messages(None, None, "sing")


def test_sinks_of_streams(spark, tmp_path):
    rows = [(i, "x") for i in range(50)]
    sent = []
    q = deadline.outbound(cases.streamed(spark, [rows], "i int, x string"), lambda b, n, dropped: sent.append((b.groupBy("part").count().collect(), dropped)), str(tmp_path / "c1"), size=10, most=30, every="0 seconds")
    q.processAllAvailable()
    q.stop()
    assert sum(r["count"] for b, _ in sent for r in b) == 30 and all(r["count"] == 10 for b, _ in sent for r in b) and sum(d for _, d in sent) == 20
    plan = "\n".join(["X a b"] + [f"U 0.5 https://e.org/{i}" for i in range(5)])
    q = sinks.complete_plans(cases.streamed(spark, [[(1, plan), (2, "U 1 https://e.org/")]], "query_id int, raw string"), str(tmp_path / "plans"), str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert [r.query_id for r in spark.read.parquet(str(tmp_path / "plans")).collect()] == [1]


def test_zipped_sitemaps(spark):
    import gzip

    rows = [("a", gzip.compress(b"<loc>https://e.org/</loc>")), ("b", b"<loc>https://f.org/</loc>"), ("c", b"\x1f\x8bbroken"), ("d", None)]
    x = spark.createDataFrame(rows, "host string, raw binary").select("host", stores.unzipped("raw").alias("body"))
    assert {r.host: r.body for r in x.collect()} == {"a": "<loc>https://e.org/</loc>", "b": "<loc>https://f.org/</loc>", "c": None, "d": None}
    assert stores.no_store(spark).count() == 0
