"""Queries over given rows, one or a few for each operator that the tables hold no input for; their SQL states the rows that must come out.

Expected rows are worked out by hand from what the operator is to do, or by ``plain``.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import sinks
from ..functions import text, urls
from ..functions import values as v
from ..operators import answers, content, dedup, expand, ranking, serp
from ..operators.cut import shared
from ..sources import routes, stores
from ..streaming import deadline
from . import plain, recall
from . import sqltext as s

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, dt.datetime):
        return f"TIMESTAMP '{x}'"
    if isinstance(x, dt.date):
        return f"DATE '{x}'"
    return s.lit(x) if isinstance(x, str) else repr(x)


def stated(rows: list[tuple], columns: str) -> str:
    """SQL of rows; ``columns`` is name and type of each."""
    names, kinds = zip(*(c.split() for c in columns.split(",")), strict=True)
    cast = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names, kinds, strict=True))
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) t({', '.join(names)})"


def case(rows: list[tuple], columns: str):
    """Registers a query that gives ``rows`` whatever the tables hold."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = stated(rows, columns)
        return f

    return add


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def given(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


R6 = lambda c: F.round(c, 6)
JOIN = lambda c, sep=" | ": F.array_join(c, sep)

# ---------------------------------------------------------------- sources


@case([("de", "de,en;q=0.5"), ("en", None), ("", None), (" FR ", "fr,en;q=0.5")], "lang VARCHAR,header VARCHAR")
def accept_language(spark, sf_dir):
    return given(spark, [("de",), ("en",), ("",), (" FR ",)], "lang string").select("lang", urls.accept_language(F.col("lang")).alias("header"))


@query(f"""WITH x AS (SELECT page_id, {s.registrable(s.host('url'))} AS site FROM pages), h AS (SELECT *, (row_number() OVER (PARTITION BY site ORDER BY page_id) - 1) // 6 AS w FROM x)
SELECT page_id, greatest(w, (row_number() OVER (ORDER BY w, page_id) - 1) // 96)::INTEGER AS wave FROM h""")
def host_waves(spark, sf_dir):
    """In which round of fetches each page goes: six of a site at a time, 96 in all."""
    c = table(spark, sf_dir, "pages").select(F.lit(0).alias("query_id"), F.col("page_id").alias("arrival"), "page_id", "url")
    return stores.waves(c).select("page_id", "wave")


@query(f"""WITH c AS (SELECT page_id AS q, url FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT -1, 'https://nowhere.example.net/x'),
p AS (SELECT {s.canonical('url')} AS k, min(url) AS final_url, arg_min(page_id, url) AS page_id FROM pages GROUP BY 1)
SELECT c.q AS query_id, p.final_url, p.page_id, CASE WHEN p.k IS NULL THEN 404 WHEN p.page_id % 5 = 0 THEN 0 ELSE 200 END::INTEGER AS status, CASE WHEN p.k IS NULL THEN 'not found' WHEN p.page_id % 5 = 0 THEN 'timeout' END AS error
FROM c LEFT JOIN p ON {s.canonical('c.url')} = p.k""")
def pages_joined(spark, sf_dir):
    """Candidates with their pages; every fifth page came too late."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    c = p.where("page_id % 3 = 0").select(F.col("page_id").alias("query_id"), "url").unionByName(given(spark, [(-1, "https://nowhere.example.net/x")], "query_id long, url string"))
    timed = p.withColumn("fetch_ms", F.when(F.col("page_id") % 5 == 0, 9000).otherwise(10))
    return stores.pages_of(c, timed, window_ms=6000).select("query_id", "final_url", "page_id", "status", "error")


@case([("e.org", "https://e.org/s?q=tungsten%20melting%20point")], "host VARCHAR,url VARCHAR")
def site_search_addresses(spark, sf_dir):
    t = given(spark, [("e.org", "https://e.org/s?q={}"), ("f.org", "https://f.org/?s={}")], "host string, template string")
    return stores.search_addresses(t, given(spark, [("e.org", "what is the tungsten melting point")], "host string, query string")).select("host", "url")


URLSET = "<urlset>" + "".join(f"<url><loc> https://{h}/a{i}?x=1&amp;y=2 </loc></url>" for h, i in (("e.org", 1), ("e.org", 2))) + "<url><loc>ftp://no</loc></url></urlset>"
INDEX = "<sitemapindex>" + "".join(f"<sitemap><loc>https://g.org/m{i}.xml</loc></sitemap>" for i in range(5)) + "</sitemapindex>"


@case([("e.org", "https://e.org/a1?x=1&y=2 https://e.org/a2?x=1&y=2"), ("f.org", "https://f.org/own"), ("g.org", "https://g.org/p0 https://g.org/p2")], "host VARCHAR,locs VARCHAR")
def sitemap_parse(spark, sf_dir):
    """A plain map at the usual place; one that robots.txt names before it; an index, whose first three children are read, one of them missing."""
    hosts = given(spark, [("e.org",), ("f.org",), ("g.org",), ("none.org",)], "host string")
    robots = given(spark, [("f.org", "User-agent: *\nSitemap: https://cdn.f.org/s.xml\nsitemap: /relative\nSitemap: https://other.com/s.xml")], "host string, body string")
    page = lambda u: f"<urlset><url><loc>{u}</loc></url></urlset>"
    maps = [("https://e.org/sitemap.xml", URLSET), ("https://f.org/sitemap.xml", page("https://f.org/usual")), ("https://cdn.f.org/s.xml", page("https://f.org/own")), ("https://g.org/sitemap.xml", INDEX)]
    maps += [(f"https://g.org/m{i}.xml", page(f"https://g.org/p{i}")) for i in (0, 2, 3, 4)]
    return stores.catalogues(hosts, robots, given(spark, maps, "url string, body string")).select("host", JOIN("locs", " ").alias("locs"))


DAY = dt.datetime(2024, 5, 10, 12)


@case([("a", "x y"), ("b", None), ("c", ""), ("d", None), ("e", None)], "host VARCHAR,locs VARCHAR")
def known_sitemaps(spark, sf_dir):
    """Stored catalogues: fresh, too old, a fresh miss, an old miss, and a host never asked."""
    store = [("a", ["x", "y"], DAY - dt.timedelta(days=2)), ("b", ["z"], DAY - dt.timedelta(days=4)), ("c", [], DAY - dt.timedelta(hours=5)), ("d", [], DAY - dt.timedelta(hours=7))]
    asked = given(spark, [(h,) for h in "abcde"], "host string")
    return stores.known_sitemaps(asked, given(spark, store, "host string, locs array<string>, updated timestamp"), F.lit(DAY)).select("host", JOIN("locs", " ").alias("locs"))


@case([(1, "new", 0), (2, "other", 1)], "query_id INTEGER,raw VARCHAR,found INTEGER")
def shared_plans(spark, sf_dir):
    """The first key that hits, and the newest plan under it; the third question hits nothing."""
    asked = given(spark, [(1, ["k1", "k2"]), (2, ["none", "k2"]), (3, ["none"])], "query_id int, keys array<string>")
    store = [("k1", "old", DAY), ("k1", "new", DAY + dt.timedelta(days=1)), ("k2", "other", DAY)]
    return stores.shared_plans(asked, given(spark, store, "key string, raw string, created timestamp")).select("query_id", "raw", "found")


@case([(1, 0, "I code", 0.5 + 7 / 4 / 2), (1, 1, "U 1 https://e.org/a", 0.5 + 27 / 4 / 2)], "query_id INTEGER,line INTEGER,text VARCHAR,seconds DOUBLE")
def plan_replay(spark, sf_dir):
    """A stored plan line by line, half a second to the first token and two tokens a second."""
    return stores.replayed(given(spark, [(1, "I code\nU 1 https://e.org/a"), (2, ""), (3, None)], "query_id int, raw string"), 0.5, 2.0).withColumnRenamed("at", "seconds")


@case([("k", "b", 2), ("l", "c", 1)], "k VARCHAR,x VARCHAR,n INTEGER")
def store_upsert(spark, sf_dir):
    old = given(spark, [("k", "a", 1), ("l", "c", 1)], "k string, x string, n int")
    return stores.upserted(old, given(spark, [("k", "b", 2), ("l", "d", 0)], "k string, x string, n int"), "k", "n")


@case([("h", "", 2), ("i", "u", 1)], "host VARCHAR,locs VARCHAR,updated INTEGER")
def catalogue_upsert(spark, sf_dir):
    kind = "host string, locs array<string>, updated int"
    out = sinks.catalogue_store(given(spark, [("h", ["x"], 1), ("i", ["u"], 1)], kind), given(spark, [("h", None, 2)], kind))
    return out.select("host", JOIN("locs").alias("locs"), "updated")


JSON_PLAN = '{"candidates":["https://a.example.com/x",{"url":"http://b.example.com/y","prior":0.9,"reason":"r"},{"url":"bad"},"https://a.example.com/x"],"routes":{"wikipedia":"tcp handshake","nosuch":"x","hn":""},"hubs":["https://h.example.com/","https://www.bing.com/search?q=1"],"expansions":["syn ack","a"],"intent":"Code","lang":"de-AT"}'
JSON_LIST = '{"candidates":[],"routes":["arxiv","pubmed","zzz"],"intent":"odd"}'


@case([(1, 0, "https://a.example.com/x", 0.55, ""), (1, 1, "https://b.example.com/y", 0.9, "r")], "query_id INTEGER,arrival INTEGER,url VARCHAR,prior DOUBLE,reason VARCHAR")
def json_plan(spark, sf_dir):
    return recall.from_json(given(spark, [(1, JSON_PLAN), (2, JSON_LIST), (3, "no json")], "query_id int, raw string")).select("query_id", "arrival", "url", "prior", "reason")


@case([(1, "code", "de", "syn ack", "https://h.example.com/", "wikipedia=tcp handshake hn="), (2, "informational", "en", "", "", "arxiv= pubmed=")], "query_id INTEGER,intent VARCHAR,lang VARCHAR,expansions VARCHAR,hubs VARCHAR,routes VARCHAR")
def json_plan_parts(spark, sf_dir):
    x = recall.json_parts(given(spark, [(1, JSON_PLAN), (2, JSON_LIST)], "query_id int, raw string"))
    return x.select("query_id", "intent", "lang", JOIN("expansions").alias("expansions"), JOIN("hubs").alias("hubs"), JOIN(F.transform("routes", lambda r: F.concat(r["name"], F.lit("="), F.coalesce(r["query"], F.lit("")))), " ").alias("routes"))


@case([(1, True, True, False), (2, True, True, True)], "query_id INTEGER,asks BOOLEAN,has_grammar BOOLEAN,reports BOOLEAN")
def planner_prompts(spark, sf_dir):
    """First prompts hold the question and the protocol; those of a second round also what was found, dead and shown."""
    q = given(spark, [(1, "what is a monad"), (2, "tcp handshake")], "query_id int, query string")
    report = given(spark, [(2, [("T", "https://e.org/t", 0.5, "ex")], ["https://d.org/"], ["https://e.org/t"])], "query_id int, found array<struct<title:string,url:string,relevance:double,excerpt:string>>, dead array<string>, shown array<string>")
    p = recall.prompts(q).where("query_id = 1").unionByName(recall.refine_prompts(q, report)).join(q, "query_id")
    has = lambda t: F.contains("prompt", F.lit(t) if isinstance(t, str) else t)
    return p.select("query_id", has(F.col("query")).alias("asks"), (has("U confidence address") & has("informational")).alias("has_grammar"), (has("0.50 T https://e.org/t") & has("Dead:\nhttps://d.org/") & has("Shown:")).alias("reports"))


PDF = b"%PDF-1.4\n1 0 obj << /Title (A \\(small\\) file) /CreationDate (D:20240305) >> endobj\n2 0 obj << /Length 60 >> stream\nBT /F1 12 Tf (First line) Tj T* [(Sec) -20 (ond)] TJ ET\nendstream endobj"


@case([(1, "A (small) file", "2024-03-05", "First line\nSecond"), (2, "", "", '{\n "a": [\n  1\n ]\n}'), (3, "Ä", "", "Ü"), (4, "É", "", "x"), (5, "", "", ""), (6, "é", "", "y")], "page_id INTEGER,title VARCHAR,published VARCHAR,text VARCHAR")
def bodies_by_type(spark, sf_dir):
    """A PDF, JSON, pages whose character set the header, the page or nothing names, and no body."""
    html = lambda t, b, m="": f"<html><head>{m}<title>{t}</title></head><body>{b}</body></html>"
    rows = [(1, "https://e.org/f.pdf", PDF, "application/pdf"), (2, "https://e.org/j", b'{"a":[1]}', "application/json"), (3, "u", html("Ä", "Ü").encode("latin-1"), "text/html; charset=ISO-8859-1"), (4, "u", html("É", "x", '<meta charset="cp1252">').encode("cp1252"), "text/html"), (5, "u", None, None), (6, "u", html("é", "y").encode(), "text/html; charset=nosuch")]
    x = content.pages(given(spark, rows, "page_id int, url string, body binary, content_type string"))
    return x.select("page_id", "title", "published", "text")


@case([(1, "# Head\n\nA **bold** [link](https://e.org/x).\n\n- one\n- two\n\n> Said.\n\n```\nx = 1\n```"), (2, "")], "i INTEGER,markdown VARCHAR")
def page_markdown(spark, sf_dir):
    html = "<body><nav>menu</nav><article><h1>Head</h1><p>A <b>bold</b> <a href='/x'>link</a>.</p><ul><li>one<li>two</ul><blockquote><p>Said.</p></blockquote><pre>x = 1</pre></article></body>"
    return content.as_markdown(given(spark, [(1, "https://e.org/", html), (2, "", None)], "i int, url string, html string")).select("i", "markdown")


# ---------------------------------------------------------------- routes

BODIES = [
    ("wikipedia", '{"query":{"search":[{"title":"Write ahead","snippet":"a <b>b</b> &amp; c"},{"title":"Log","snippet":""}]}}'),
    ("hn", '{"hits":[{"title":"T","url":"https://e.org/t","points":100,"created_at":"2024-01-02T03:04"},{"title":"","url":"https://e.org/u"},{"title":"V","url":""}]}'),
    ("stackoverflow", '{"items":[{"link":"https://so/q1","title":"Why &lt;x&gt;","body":"<p>Because.</p>","score":20,"is_answered":true},{"link":"https://so/q2","title":"How","score":0}]}'),
    ("github", '{"items":[{"html_url":"https://github.com/a/b","full_name":"a/b","stargazers_count":4900},{"html_url":"u","full_name":"c","stargazers_count":24}]}'),
    ("arxiv", "<feed><entry><id>http://arxiv.org/abs/1</id><title>On\n X</title><summary>We show.</summary><published>2023-05-06T00</published></entry></feed>"),
    ("semanticscholar", '{"data":[{"url":"https://s2/p","title":"P","abstract":"A.","year":2020,"citationCount":100}]}'),
    ("pubmed", '{"esearchresult":{"idlist":["11","12"]}}'),
    ("mdn", '{"documents":[{"mdn_url":"/en-US/docs/x","title":"X","summary":"S"}]}'),
    ("npm", '{"objects":[{"package":{"name":"left-pad","description":"Pads"}}]}'),
    ("pypi", '{"info":{"name":"requests","summary":"HTTP"}}'),
    ("crates", '{"crates":[{"name":"serde","description":"Ser"}]}'),
    ("openlibrary", '{"docs":[{"key":"/works/1","title":"B","author_name":["N","M","O"],"first_publish_year":1999}]}'),
    ("reddit", '{"data":{"children":[{"data":{"permalink":"/r/x/1","title":"T","selftext":"s","ups":300}}]}}'),
    ("youtube", '<script>var ytInitialData = {"a":[{"videoRenderer":{"videoId":"noTitle1"}},{"videoRenderer":{"videoId":"abc12345","title":{"runs":[{"text":"One "},{"text":"two"}]},"descriptionSnippet":{"simpleText":"D"}}}]};</script>'),
]
PARSED = [
    ("wikipedia", 0, "https://en.wikipedia.org/wiki/Write_ahead", "Write ahead", 0.78, "a b & c", ""), ("wikipedia", 1, "https://en.wikipedia.org/wiki/Log", "Log", 0.74, "", ""),
    ("hn", 0, "https://e.org/t", "T", 0.67, "", "2024-01-02"),
    ("stackoverflow", 0, "https://so/q1", "Why <x>", 0.65, "Because.", ""), ("stackoverflow", 1, "https://so/q2", "How", 0.49, "", ""),
    ("github", 0, "https://github.com/a/b", "a/b", 0.82, "", ""),
    ("arxiv", 0, "https://arxiv.org/abs/1", "On X", 0.70, "We show.", "2023-05-06"),
    ("semanticscholar", 0, "https://s2/p", "P", 0.55, "A.", "2020"),
    ("pubmed", 0, "https://pubmed.ncbi.nlm.nih.gov/11/", "", 0.66, "", ""), ("pubmed", 1, "https://pubmed.ncbi.nlm.nih.gov/12/", "", 0.66, "", ""),
    ("mdn", 0, "https://developer.mozilla.org/en-US/docs/x", "X", 0.74, "S", ""),
    ("npm", 0, "https://www.npmjs.com/package/left-pad", "left-pad", 0.62, "Pads", ""),
    ("pypi", 0, "https://pypi.org/project/requests/", "requests - PyPI", 0.66, "HTTP", ""),
    ("crates", 0, "https://crates.io/crates/serde", "serde", 0.62, "Ser", ""),
    ("openlibrary", 0, "https://openlibrary.org/works/1", "B", 0.60, "N, M", "1999"),
    ("reddit", 0, "https://www.reddit.com/r/x/1", "T", 0.50, "s", ""),
    ("youtube", 0, "https://www.youtube.com/watch?v=noTitle1", "", 0.55, "", ""), ("youtube", 1, "https://www.youtube.com/watch?v=abc12345", "One two", 0.52, "D", ""),
]


@case(PARSED, "route VARCHAR,i INTEGER,url VARCHAR,title VARCHAR,prior DOUBLE,snippet VARCHAR,published VARCHAR")
def route_parse(spark, sf_dir):
    """An answer of each of the fourteen routes, and two that are none."""
    rows = [(1, r, 200, b) for r, b in BODIES] + [(2, "npm", 200, "not json"), (2, "hn", 503, BODIES[1][1])]
    x = routes.parsed(given(spark, rows, "query_id int, route string, status int, body string"))
    return x.select(F.replace("source", F.lit("route:"), F.lit("")).alias("route"), "i", "url", "title", R6("prior").alias("prior"), "snippet", "published")


@case([(1, "https://de.wikipedia.org/wiki/Log"), (2, "https://en.wikipedia.org/wiki/Log")], "query_id INTEGER,url VARCHAR")
def route_editions(spark, sf_dir):
    body = '{"query":{"search":[{"title":"Log","snippet":""}]}}'
    return routes.wikipedia(given(spark, [(1, body, "de"), (2, body, "zz")], "query_id int, body string, lang string")).select("query_id", "url")


@case([("wikipedia", "own words"), ("hn", "Python HNSW indexes"), ("pypi", "requests"), ("pypi", "how")], "route VARCHAR,asked VARCHAR")
def route_queries(spark, sf_dir):
    """The plan's wording, the query's most telling words, and the word that is most like a package."""
    q = "How to use a Python guide for HNSW indexes"
    rows = [("wikipedia", q, "own words"), ("hn", q, None), ("pypi", "install python requests", ""), ("pypi", "how to", None)]
    return routes.queries_for(given(spark, rows, "route string, query string, explicit string")).select("route", "asked")


@case([(1, "hn", "a"), (1, "hn", "b"), (2, "hn", "a")], "query_id INTEGER,route VARCHAR,asked VARCHAR")
def route_claims(spark, sf_dir):
    return routes.claimed(given(spark, [(1, "hn", "a"), (1, "hn", "a"), (1, "hn", "b"), (1, "npm", " None "), (1, "npm", ""), (2, "hn", "a")], "query_id int, route string, asked string"))


@case([(1, "reddit", 200, "y"), (1, "hn", 503, "")], "query_id INTEGER,route VARCHAR,status INTEGER,body VARCHAR")
def route_answers(spark, sf_dir):
    """The first backend that answers; else what the last one said."""
    rows = [(1, "reddit", 0, 403, "x"), (1, "reddit", 1, 200, "y"), (1, "reddit", 2, 200, "z"), (1, "hn", 0, 200, ""), (1, "hn", 1, 503, "")]
    return routes.answered(given(spark, rows, "query_id int, route string, attempt int, status int, body string"))


@case([(src, i, 1.0 if src not in ("route:hn", "route:npm") or (src == "route:hn" and i in ("code", "news")) else 0.62) for src in ("", "expand", "route:hn", "route:npm") for i in v.INTENTS], "source VARCHAR,intent VARCHAR,trust DOUBLE")
def route_trust(spark, sf_dir):
    x = given(spark, [(src, i) for src in ("", "expand", "route:hn", "route:npm") for i in v.INTENTS], "source string, intent string")
    return x.select("source", "intent", recall.route_fit(F.col("source"), F.col("intent")).alias("trust"))


@case([("informational", "wikipedia"), ("reference", "wikipedia"), ("navigational", "wikipedia"), ("academic", "arxiv"), ("academic", "wikipedia"), ("news", "hn"), ("news", "wikipedia"), ("code", "github"), ("code", "hn"), ("code", "stackoverflow"), ("product", "reddit")], "intent VARCHAR,route VARCHAR")
def speculative_by_intent(spark, sf_dir):
    return recall.speculative(given(spark, [(i,) for i in v.INTENTS], "intent string")).select("intent", "route")


# ---------------------------------------------------------------- words and addresses

CJK = [("abc", "abc", False), ("日本語", "日 本 語 日本 本語", True), ("python教程", "python 教 程 教程", True), ("字", "字", True)]


@case(CJK, "t VARCHAR,grams VARCHAR,unspaced BOOLEAN")
def cjk_tokens(spark, sf_dir):
    return given(spark, [(t,) for t, _, _ in CJK], "t string").select("t", text.segmented(F.col("t")).alias("grams"), text.unspaced(F.col("t")).alias("unspaced"))


PIECES = [("量子计算机的工作原理是什么", "量子计算机 工作原理"), ("python教程", "python 教程"), ("2023年北京", "2023 北京"), ("日本の歴史について", "日本 歴史"), ("在", ""), ("plain", "plain")]


@case(PIECES, "t VARCHAR,pieces VARCHAR")
def cjk_pieces(spark, sf_dir):
    return given(spark, [(t,) for t, _ in PIECES], "t string").select("t", JOIN(text.pieces(F.col("t")), " ").alias("pieces"))


@case([("量子计算机的工作原理是什么", "zh", "量子计算机 工作原理"), ("wer ist der Autor von Faust", "de", "autor faust"), ("wer ist der Autor von Faust", "en", "wer ist der autor von faust"), ('how does "write ahead log" work', "en", '"write ahead log"')], "q VARCHAR,lang VARCHAR,terms VARCHAR")
def terms_by_language(spark, sf_dir):
    q = given(spark, [("量子计算机的工作原理是什么", "zh"), ("wer ist der Autor von Faust", "de"), ("wer ist der Autor von Faust", "en"), ('how does "write ahead log" work', "en")], "q string, lang string")
    return q.select("q", "lang", JOIN(F.transform(text.content_terms(F.col("q"), F.col("lang")), F.lower), " ").alias("terms"))


@query(f"""WITH c AS (SELECT item_id, list_transform({s.content('text')}, lambda t: lower(t)) AS ts FROM benchmark), d AS (SELECT item_id, list_filter(ts, lambda t, i: list_position(ts, t) = i) AS ts FROM c)
SELECT item_id, array_to_string(list_slice(list_filter(ts, lambda t: length(t) >= 3), 1, 10), ' ') AS terms, array_to_string(list_sort(ts), ' ') AS bag FROM d""")
def query_terms(spark, sf_dir):
    """Ranking terms and the bag of content words of each benchmark text."""
    return table(spark, sf_dir, "benchmark").select("item_id", JOIN(text.query_terms(F.col("text")), " ").alias("terms"), JOIN(text.content_bag(F.col("text")), " ").alias("bag"))


@case([(1, "what is x", 9), (3, "q" * 2000, 2000)], "query_id INTEGER,query VARCHAR,n INTEGER")
def query_normalised(spark, sf_dir):
    from ..engine import analysed

    q = given(spark, [(1, " what\n is \t x "), (2, "  "), (3, "q" * 5000), (4, None)], "query_id int, query string")
    return analysed(q).select("query_id", "query", F.length("query").alias("n"))


@case([(1, "bern city", 2, "bern"), (2, "bern", 1, ""), (3, "", 0, ""), (4, "city info", 1, "")], "i INTEGER,first VARCHAR,n INTEGER,second VARCHAR")
def question_keys(spark, sf_dir):
    x = given(spark, [(1, "The city of Bérn"), (2, "bern"), (3, ""), (4, "City info")], "i int, q string").select("i", text.question_keys(F.col("q")).alias("k"))
    return x.select("i", F.coalesce(F.get("k", F.lit(0)), F.lit("")).alias("first"), F.size("k").alias("n"), F.coalesce(F.get("k", F.lit(1)), F.lit("")).alias("second"))


@case([("day", dt.date(2024, 5, 9)), ("week", dt.date(2024, 5, 3)), ("month", dt.date(2024, 4, 9)), ("year", dt.date(2023, 5, 10)), ("decade", None)], "w VARCHAR,since DATE")
def freshness_windows(spark, sf_dir):
    return given(spark, [(w,) for w in ("day", "week", "month", "year", "decade")], "w string").select("w", text.freshness_floor(F.col("w"), F.lit("2024-05-10").cast("date")).alias("since"))


WORDS = ["preise", "über", "straße", "café", "abc", "naïveté"]


@case([(w, plain.fold(w), " ".join(sorted(plain.grams(w)))) for w in WORDS], "w VARCHAR,folded VARCHAR,grams VARCHAR")
def word_folds(spark, sf_dir):
    return given(spark, [(w,) for w in WORDS], "w string").select("w", text.fold(F.col("w")).alias("folded"), JOIN(F.array_sort(text.grams(F.col("w"))), " ").alias("grams"))


BAGS = [(["strompreise"], ["strompreisentwicklung", "2024"]), (["a", "b"], ["a", "b"]), (["art"], ["smart"]), (["annual", "report"], ["reports", "annual", "2024"]), ([], ["x"]), (["x"], []), (["größe", "tabelle"], ["groesse", "tabellen"]), (["strompreisentwicklung"], ["strom", "preise"]), (["klimaschutz"], ["klimaschutzgesetz"])]


@case([(i, round(plain.compound(q, f), 6), round(plain.field_fit(q, f), 6)) for i, (q, f) in enumerate(BAGS)], "i INTEGER,compound DOUBLE,fit DOUBLE")
def field_fits(spark, sf_dir):
    x = given(spark, [(i, q, f) for i, (q, f) in enumerate(BAGS)], "i int, q array<string>, f array<string>")
    return x.select("i", R6(text.compound_fit(F.col("q"), F.col("f"))).alias("compound"), R6(text.field_fit(F.col("q"), F.col("f"))).alias("fit"))


TITLES = [("Annual Report 2024", [["annual", "report"], ["jahresbericht"]]), ("Jahresberichte", [["annual", "report"], ["jahresbericht"]]), ("unrelated", [["annual"]])]


@case([(t, round(plain.best_fit(vs, t.lower().split()), 6)) for t, vs in TITLES] + [("量子计算机的原理", 1.0)], "title VARCHAR,fit DOUBLE")
def title_fits(spark, sf_dir):
    """Best fit over vocabularies and never their union; an unspaced title goes by its pieces."""
    x = given(spark, [*TITLES, ("量子计算机的原理", [["量子计算机", "原理"]])], "title string, vs array<array<string>>")
    return x.select("title", R6(expand.title_fit(F.col("vs"), F.col("title"))).alias("fit"))


DOMAINS = [("rust-lang.org", ["rust", "lang", "book"]), ("postgresql.org", ["postgresql"]), ("e.org", ["e"]), ("example.com", ["sample"]), ("stadt-bochum.de", ["bochum", "stadt"])]


@case([(d, round(plain.host_fit(d, ts), 6)) for d, ts in DOMAINS], "domain VARCHAR,fit DOUBLE")
def host_fits(spark, sf_dir):
    return given(spark, DOMAINS, "domain string, ts array<string>").select("domain", R6(text.host_fit(F.col("domain"), F.col("ts"))).alias("fit"))


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, t, len(regexp_extract_all(t, {s.lit(v.LISTY)})) AS listy, len(regexp_extract_all(t, '[.!?]\\s+[A-ZÄÖÜ0-9]')) AS starts, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS letters FROM d)
SELECT doc_id, CASE WHEN t = '' THEN 1.0 WHEN listy >= 3 AND starts <= 1 THEN 0.4 WHEN listy >= 3 THEN 0.7 WHEN letters < 0.55 * length(t) THEN 0.7 ELSE 1.0 END::DOUBLE AS prose FROM c""")
def prose_factors(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.prose_factor(F.coalesce("text", F.lit(""))).alias("prose"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, (doc_id % 7 * 20)::BIGINT AS n FROM documents), c AS (SELECT *, substring(t, 1, n * 4) AS cut FROM d),
e AS (SELECT *, length(cut) - length(regexp_extract(cut, '([^ ]*)$', 1)) - 1 AS sp FROM c)
SELECT doc_id, CASE WHEN n <= 0 OR t = '' THEN '' WHEN greatest(length(t) // 4, 1) <= n THEN t WHEN contains(cut, ' ') AND sp > length(cut) * 0.6 THEN rtrim(substring(cut, 1, sp), ' ') || ' ...' ELSE rtrim(cut, ' ') || ' ...' END AS cut FROM e""")
def truncated(spark, sf_dir):
    """Texts cut to 0 to 120 tokens."""
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.coalesce("text", F.lit("")), (F.col("doc_id") % 7 * 20).cast("long")).alias("cut"))


ADDRESSES = [
    ("https://www.e.org/a/b.html#dict.get", "e.org", "dict.get | dict get", "/a", "e.org/a/b.html"),
    ("https://docs.e.org/v1.2/x/latest/y", "docs.e.org", "", "/v1.2/x/latest/y", "docs.e.org/x/y"),
    ("https://e.org/", "e.org", "", "", "e.org/"),
    ("https://e.org/insights/#a", "e.org", "", "/insights", "e.org/insights"),
]


@case(ADDRESSES, "url VARCHAR,filed VARCHAR,anchors VARCHAR,section VARCHAR,unversioned VARCHAR")
def address_parts(spark, sf_dir):
    u = F.col("url")
    return given(spark, [(a[0],) for a in ADDRESSES], "url string").select("url", urls.atlas_host(u).alias("filed"), JOIN(urls.anchor_terms(u)).alias("anchors"), urls.section(u).alias("section"), urls.unversioned(u).alias("unversioned"))


CANONICAL = [("https://e.org/a/b", "https://www.e.org/a/c", True), ("https://e.org/a/b", "https://e.org/", False), ("https://e.org/a/b", "https://f.org/a/b", False), ("https://e.org/a", None, False), ("https://e.org/a", "/a", False)]


@case([(u, c if own else u) for u, c, own in CANONICAL], "url VARCHAR,key VARCHAR")
def declared_addresses(spark, sf_dir):
    return given(spark, [(u, c) for u, c, _ in CANONICAL], "url string, c string").select("url", urls.dedup_key(F.col("url"), F.col("c")).alias("key"))


@case([("https://e.org/casino-bonus", "", "bonus", True), ("https://e.org/casino", "", "casino", False), ("https://e.org/x", "Free download now", "x", True), ("https://e.org/x", "Plain", "x", False)], "url VARCHAR,title VARCHAR,asked VARCHAR,spam BOOLEAN")
def spam_rows(spark, sf_dir):
    x = given(spark, [("https://e.org/casino-bonus", "", "bonus"), ("https://e.org/casino", "", "casino"), ("https://e.org/x", "Free download now", "x"), ("https://e.org/x", "Plain", "x")], "url string, title string, asked string")
    return x.select("url", "title", "asked", urls.spam(F.col("url"), F.replace("title", F.lit(" "), F.lit("-")), F.array("asked")).alias("spam"))


@query(f"SELECT min(page_id) AS page_id FROM pages GROUP BY {s.canonical('url')}")
def distinct_candidates(spark, sf_dir):
    """The first arrival of each canonical address, of pages from two sources."""
    p = table(spark, sf_dir, "pages").select(F.lit(0).alias("query_id"), F.col("page_id").alias("arrival"), "page_id", "url")
    both = p.where("page_id % 2 = 0").unionByName(p.where("page_id % 2 = 1"))
    return dedup.distinct_candidates(both).select("page_id")


# ---------------------------------------------------------------- ranking

KINDS = [("informational", "en"), ("news", "ja"), ("code", "de"), ("navigational", "en"), ("academic", "zh"), ("reference", "en"), ("product", "ru")]


@case([(i, la, r, n, float(w)) for i, la in KINDS for r in (False, True) for n, w in plain.weights(i, la, r, {"thin": 0.5}).items()], "intent VARCHAR,lang VARCHAR,recent BOOLEAN,name VARCHAR,weight DOUBLE")
def weights_by_intent(spark, sf_dir):
    x = given(spark, [(i, la, r) for i, la in KINDS for r in (False, True)], "intent string, lang string, recent boolean")
    w = ranking.weights(F.col("intent"), F.col("lang"), F.col("recent"), {"thin": 0.5})
    return x.select("intent", "lang", "recent", F.explode(F.map_from_arrays(F.array(*map(F.lit, w)), F.array(*[c.cast("double") for c in w.values()]))).alias("name", "weight"))


SIGNALS = ("lex", "emb", "title", "url", "host", "rare", "covered", "aspect", "emb_raw", "prior", "authority", "consensus", "fresh", "date", "thin", "dead", "root", "orphan", "spam")
_INTENTS = [i for i, _ in KINDS]


def _signal(k: int) -> str:
    """Every signal of a document from its number; those that are marks are 0 or 1."""
    name = SIGNALS[k]
    return f"(doc_id % {k + 2} = 0)::INT::DOUBLE" if name in ("thin", "dead", "root", "orphan", "spam") else f"(((doc_id * {2 * k + 3} + {k}) % 101)::DOUBLE / 100 - {0.5 if name == 'date' else 0.0})"


def _weight(name: str) -> str:
    by = " ".join(f"WHEN doc_id % {len(KINDS)} = {k} THEN {plain.weights(i, la, False)[name]}" for k, (i, la) in enumerate(KINDS))
    w = f"(CASE {by} END)::DOUBLE"
    return f"(CASE WHEN doc_id % 2 = 0 THEN greatest({w}, {v.RECENT_FRESH}) ELSE {w} END)" if name == "fresh" else w


_CE = "((doc_id * 7 % 103)::DOUBLE / 102)"


@query(f"""WITH f AS (SELECT doc_id, doc_id % 20 AS query_id, {', '.join(f'{_signal(k)} AS {n}' for k, n in enumerate(SIGNALS))}, {', '.join(f'{_weight(n)} AS w_{n}' for n in v.WEIGHTS)} FROM documents),
r AS (SELECT *, {' + '.join(f'w_{n} * {n}' for n in SIGNALS[:8])} AS rel, w_prior * prior + w_authority * authority + w_consensus * consensus + w_fresh * fresh + w_date * date AS sta, {' + '.join(f'w_{n} * {n}' for n in ('thin', 'dead', 'root', 'orphan'))} + spam AS pen FROM f),
h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY rel + sta - pen DESC, doc_id) <= 20 THEN {_CE} END AS ce FROM r)
SELECT doc_id, round(rel + sta - pen, 6) AS prelim, round(rel + (0.30 + 0.70 * coalesce(ce, greatest(lex, emb))) * sta - pen + w_ce * coalesce(ce, 0), 6) AS score, round(coalesce(ce, greatest(emb_raw, title, url)), 6) AS relevance FROM h""")
def fusion_full(spark, sf_dir):
    """Scores with every signal at work, all intents and scripts, and a reranker's score for the first twenty of each query."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 20).alias("query_id"))
    sql = lambda x: x.replace("::INT::DOUBLE", "::int::double")
    x = d.select("*", *[F.expr(sql(_signal(k))).alias(n) for k, n in enumerate(SIGNALS)])
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    x = x.withColumns({"intent": pick(_INTENTS), "lang": pick([la for _, la in KINDS]), "ce": F.lit(None).cast("double")})
    w = ranking.weights(F.col("intent"), F.col("lang"), F.col("doc_id") % 2 == 0)
    first = ranking.fused(x, w)
    ce = d.select("query_id", "doc_id", F.expr(_CE).alias("ce"))
    order = first.withColumns({"signal": F.col("url"), "url": F.col("doc_id")})
    head = ranking.reranked(order, ce).withColumn("url", F.col("signal")).drop("score", "relevance")
    return ranking.fused(head, w).select("doc_id", R6("prelim").alias("prelim"), R6("score").alias("score"), R6("relevance").alias("relevance"))


@query("""WITH v AS (SELECT vec_id, vec_id % 7 AS doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-9 AS norm FROM v),
c AS (SELECT n.vec_id, n.doc_id, greatest(list_sum(list_transform(list_zip(q.e, n.e), lambda z: z[1] * z[2])) / (q.norm * n.norm), 0) AS sim FROM n, n q WHERE q.vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT doc_id, round(max(sim), 6) AS emb, arg_min(vec_id, (-sim, vec_id)) AS pos FROM c GROUP BY 1""")
def dense_best(spark, sf_dir):
    """Each group's vector that is most like the first one; vectors stand for passages."""
    e = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("query_id"), (F.col("vec_id") % 7).alias("doc_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    q = e.groupBy("query_id").agg(F.min_by("vector", "pos").alias("vector"))
    return ranking.best_cosine(e, q).select("doc_id", R6("emb").alias("emb"), "pos")


def _rows(spark):
    rows = [("a", "s", 0.9, 0.9, 200, None), ("b", "s", 0.8, 0.9, 404, None), ("c", "s", 0.7, 0.9, 200, None), ("d", "s", 0.6, 0.9, 200, None), ("e", "t", 0.5, 0.1, 200, None), ("f", "u", 0.4, 0.1, 200, None), ("g", "v", 0.3, 0.5, 200, None), ("h", "w", 0.2, 0.5, 410, 2)]
    return given(spark, [(1, *r) for r in rows] + [(2, "x", "s", 0.5, 0.9, 404, None)], "query_id int, url string, site string, score double, relevance double, status int, pinned int")


@case([(1, 1, "a"), (1, 2, "h"), (1, 3, "c"), (1, 4, "d"), (1, 5, "g"), (2, 1, "x")], "query_id INTEGER,place INTEGER,url VARCHAR")
def dead_and_pinned(spark, sf_dir):
    """Dead rows go unless all are dead or they are pinned; the site cap, the floor and the second pass leave these."""
    return serp.assembled(_rows(spark), k=5).select("query_id", "place", "url")


@case([(1, 3, "n"), (1, 1, "m"), (1, 2, "k")], "query_id INTEGER,was INTEGER,url VARCHAR")
def judged_order(spark, sf_dir):
    """Listed pages in the reader's order, then pages it did not read, refilled to three."""
    r = given(spark, [(1, 1, "m"), (1, 2, "k"), (1, 3, "n")], "query_id int, place int, url string").withColumn("was", F.col("place"))
    out = serp.judged(r, given(spark, [(1, [3])], "query_id int, pages array<int>"), read=3, keep=3)
    return out.select("query_id", "was", "url")


@query(f"SELECT event_id FROM events WHERE coalesce(ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-02-10', false) OR event_id % 50 = 0")
def date_window(spark, sf_dir):
    """Rows dated within a window; every fiftieth has no date and stays, as none is required."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("published"))
    day = text.parse_date(F.col("published"))
    return e.where(F.coalesce((day >= F.lit("2024-01-10").cast("date")) & (day <= F.lit("2024-02-10").cast("date")), F.lit(True))).select("event_id")


# ---------------------------------------------------------------- answers and replies

LONG = "word " * 400


@case([(1, "[1] T\nurl: https://e.org/t\nsite: e.org  score: 0.50  found_by: U\nOpening text.\n[...]\nAnother part.\n\n[2] https://e.org/u\nurl: https://e.org/u\nsite: -  score: 0.25  found_by: -\nsnip")], "query_id INTEGER,pages VARCHAR")
def answer_pages(spark, sf_dir):
    """The opening, then passages that are not in it; an untitled page without text gives its snippet."""
    rows = [(1, 1, "https://e.org/t", "T", "e.org", 0.5, "U", " Opening text. ", ["Opening text", "Another part."], ""), (1, 2, "https://e.org/u", "", "", 0.25, None, "", [], "snip")]
    return answers.page_blocks(given(spark, rows, "query_id int, place int, url string, title string, site string, score double, source string, text string, passages array<string>, snippet string"))


@case([(1, 1400), (5, 1400)], "place INTEGER,n INTEGER")
def answer_lengths(spark, sf_dir):
    """A long page without passages gives its opening, whatever its place allows."""
    x = given(spark, [(1, LONG), (5, LONG)], "place int, text string")
    chars = F.when(F.col("place") <= v.TOP_PAGES, v.TOP_PAGE_CHARS).otherwise(v.PAGE_CHARS)
    return x.select("place", F.length(answers.page_body(F.col("text"), F.array().cast("array<string>"), F.lit(""), chars)).alias("n"))


@case([(1, "system", True), (1, "user", True)], "query_id INTEGER,role VARCHAR,fits BOOLEAN")
def answer_messages(spark, sf_dir):
    q = given(spark, [(1, "why"), (2, "no results")], "query_id int, query string")
    r = given(spark, [(1, 1, "https://e.org/t", "T", "e.org", 0.5, "U", "Body.", ["p"], "")], "query_id int, place int, url string, title string, site string, score double, source string, text string, passages array<string>, snippet string")
    x = answers.messages(q, r, "synthesize").select("query_id", F.explode("messages").alias("m")).select("query_id", "m.*")
    return x.select("query_id", "role", F.when(F.col("role") == "system", F.contains("content", F.lit("PAGES:"))).otherwise(F.startswith("content", F.lit("Question: why\n\nPages:\n\n[1] T\n")) & F.endswith("content", F.lit("Answer:"))).alias("fits"))


@case([(1, "Answer.", "3 1", None), (2, "", "", None), (3, "", "", "timeout"), (4, "plain", "", None)], "query_id INTEGER,answer VARCHAR,pages VARCHAR,error VARCHAR")
def answer_replies(spark, sf_dir):
    rows = [(1, "PAGES: 3, 1, 9, 3\n\nAnswer.", None), (2, "Not found here", None), (3, None, "timeout"), (4, "plain", None)]
    x = answers.read(given(spark, rows, "query_id int, reply string, error string"))
    return x.select("query_id", "answer", JOIN(F.transform("pages", lambda p: p.cast("string")), " ").alias("pages"), "error")


@case([(1, '{"a": 1}', None), (2, None, "the reply is no JSON object"), (3, None, "late"), (4, '{"b":[2]}', None)], "query_id INTEGER,object VARCHAR,error VARCHAR")
def answer_objects(spark, sf_dir):
    return answers.read_object(given(spark, [(1, '```json\n{"a": 1}\n```', None), (2, "sorry", None), (3, None, "late"), (4, '{"b":[2]}', None)], "query_id int, reply string, error string"))


@case([(1, '{"query_id":1,"query":"q","results":[{"place":1,"url":"https://e.org/t","title":"T"},{"place":2,"url":"https://e.org/u","title":"U"}]}'), (2, '{"query_id":2,"query":"none","results":[]}')], "query_id INTEGER,reply VARCHAR")
def reply_objects(spark, sf_dir):
    q = given(spark, [(1, "q"), (2, "none")], "query_id int, query string")
    return sinks.replies(q, given(spark, [(1, 2, "https://e.org/u", "U"), (1, 1, "https://e.org/t", "T")], "query_id int, place int, url string, title string"))


@case([(1, 0, 'data: {"id":"1","object":"search.chunk","created":5,"event":"plan","data":{"a":1}}\n\n')], "query_id INTEGER,seq INTEGER,frame VARCHAR")
def event_frames(spark, sf_dir):
    return sinks.frames(given(spark, [(1, 0, "plan", '{"a":1}', 5)], "query_id int, seq int, event string, data string, created long"))


@case([(1, "why (1 pages)\n\n1. T\n   https://e.org/t  relevance=0.50  2024-01-02\n   > part\nBody\n[cut: 4 of 4,000 chars shown; extract https://e.org/t with token_budget_per_page=2000 for all of it]"), (2, "none (0 pages)")], "query_id INTEGER,text VARCHAR")
def text_rendering(spark, sf_dir):
    q = given(spark, [(1, "why"), (2, "none")], "query_id int, query string")
    r = [(1, 1, "https://e.org/t", "T", 0.5, "2024-01-02", ["part"], "Body", 4000)]
    return sinks.rendered(q, given(spark, r, "query_id int, place int, url string, title string, relevance double, published string, passages array<string>, text string, text_chars int"))


@case([(1, 1, 12, "aaaa bbbb cccc dddd", ""), (2, 1, 5, "", "xxxx"), (2, 2, 5, "", "yyyy")], "query_id INTEGER,place INTEGER,n INTEGER,passages VARCHAR,text VARCHAR")
def budget_shrink(spark, sf_dir):
    """A first row that alone is too large is cut to the budget; else rows stay while they fit together."""
    rows = [(1, 1, "T" * 8, "u" * 24, ["aaaa bbbb cccc dddd eeee ffff"], "z" * 400), (1, 2, "T", "u", [], "z"), (2, 1, "T", "u", [], "xxxx"), (2, 2, "T", "u", [], "yyyy"), (2, 3, "T", "u", [], "z" * 100)]
    x = serp.budget_fit(given(spark, rows, "query_id int, place int, title string, url string, passages array<string>, text string"), 13)
    n = serp.page_cost(x).select("query_id", "place", "cost", JOIN("passages").alias("passages"), "text")
    return n.select("query_id", "place", (F.when(F.col("query_id") == 1, 12).otherwise(5)).alias("n"), F.regexp_replace("passages", r" \.\.\.$", "").alias("passages"), "text")


# ---------------------------------------------------------------- links and recovery

VOCABS = [["annual", "report"], ["jahresbericht"]]
LINKS = [
    (1, "https://e.org/reports/", "https://e.org/reports/2024-annual-report", "Annual report", "The annual report is here"),
    (1, "https://e.org/reports/", "https://e.org/reports/2023-annual-report", "Annual report", ""),
    (1, "https://e.org/reports/", "https://e.org/jobs", "Jobs", ""),
    (1, "https://e.org/reports/", "https://f.org/jahresberichte", "Jahresberichte", ""),
    (1, "https://e.org/reports/", "https://e.org/reports/old", "Read", "Older annual numbers and reports"),
]


def _fit(row) -> float:
    words = lambda t: [w for w in t.lower().split() if w not in v.STOP and len(w) > 1]
    path = row[2].split("/", 3)[3] if row[2].count("/") >= 3 else ""
    return plain.link_fit(VOCABS, "/" + path, sorted(set(words(row[3]))), sorted(set(words(row[4]))), row[3], ["2024"])


def _linked(spark) -> DataFrame:
    q = given(spark, [(1, VOCABS, ["2024"])], "query_id int, vocabularies array<array<string>>, years array<string>")
    return expand.scored_links(given(spark, LINKS, "query_id int, src string, url string, anchor string, context string"), q)


@case([(r[2], round(_fit(r), 6)) for r in LINKS], "url VARCHAR,fit DOUBLE")
def link_fits(spark, sf_dir):
    """Fits of links by anchor, address, sentence and period."""
    return _linked(spark).select("url", R6("fit").alias("fit"))


def _hub_rows() -> list[tuple]:
    """Links off an index page: a lower bar in its section, which counts a little more, and a high one outside where two are inside."""
    out = []
    for r in LINKS:
        inside, off = r[2].startswith("https://e.org/reports/"), "f.org" in r[2]
        fit = _fit(r)
        if fit >= (v.HUB_SECTION_FIT if inside else v.HUB_FIT):
            out.append((r[2], fit + 0.12 * inside + 0.05 * off, inside))
    many = sum(i for _, _, i in out) >= 2
    out = sorted(((u, f) for u, f, i in out if i or not many or f >= v.HUB_FIT + 0.12), key=lambda x: (-x[1], x[0]))[: v.HUB_LINKS]
    return [(u, round(f, 6), round(min(0.75, 0.4 + f / 2), 6), k + 1) for k, (u, f) in enumerate(out)]


@case(_hub_rows(), "url VARCHAR,score DOUBLE,prior DOUBLE,place INTEGER")
def hub_links(spark, sf_dir):
    return expand.follow_hubs(_linked(spark)).select("url", R6("score").alias("score"), R6("prior").alias("prior"), "place")


def _section_rows(ident: float) -> list[tuple]:
    inside = sorted(((r[2], _fit(r)) for r in LINKS if r[2].startswith("https://e.org/reports/")), key=lambda x: (-x[1], x[0]))
    inside = [x for x in inside if x[1] >= max(v.HUB_SECTION_FIT, ident / 2)][: v.DEEP_PER_PAGE]
    return [(u, round(f, 6), round(min(0.8, 0.45 + f / 2), 6), k + 1) for k, (u, f) in enumerate(inside)]


@case(_section_rows(0.4), "url VARCHAR,score DOUBLE,prior DOUBLE,place INTEGER")
def section_links(spark, sf_dir):
    """Two links of a landed page into its own section."""
    idents = given(spark, [(1, "https://e.org/reports/", 0.4)], "query_id int, src string, ident double")
    return expand.follow_section(_linked(spark), idents).select("url", R6("score").alias("score"), R6("prior").alias("prior"), "place")


def _deep_rows(ident: float) -> list[tuple]:
    scored = [(r[2], _fit(r) + 0.12 * r[2].startswith("https://e.org/reports/") - 0.06 * ("f.org" in r[2])) for r in LINKS]
    scored = sorted((x for x in scored if x[1] >= max(v.DEEP_FIT, ident + v.DEEP_MARGIN)), key=lambda x: (-x[1], x[0]))[: v.DEEP_PER_PAGE]
    return [(u, round(f, 6), round(min(0.8, 0.45 + f / 2), 6), k + 1) for k, (u, f) in enumerate(scored)]


@case(_deep_rows(0.3), "url VARCHAR,score DOUBLE,prior DOUBLE,place INTEGER")
def deep_links(spark, sf_dir):
    """Links that fit better than the page they are on."""
    idents = given(spark, [(1, "https://e.org/reports/", 0.3)], "query_id int, src string, ident double")
    return expand.follow_deep(_linked(spark), idents).select("url", R6("score").alias("score"), R6("prior").alias("prior"), "place")


LOCS = [("e.org", f"https://e.org/common/item-{i}") for i in range(40)] + [("e.org", "https://e.org/common/tungsten-price"), ("e.org", "https://e.org/de/tungsten"), ("e.org", "https://e.org/common/tungsten-price-2024")]


def _pick_rows() -> list[tuple]:
    """``common`` and ``item`` are in most addresses and no evidence; the year is a bonus, another language's edition counts less."""
    out = []
    for _, loc in LOCS:
        path = "/" + loc.split("/", 3)[3]
        whole, parts = plain.path_words(path)
        fit = max(plain.field_fit(["tungsten"], whole), plain.field_fit(["tungsten"], parts))
        if fit < v.SITEMAP_FIT:
            continue
        fit += 0.05 if "2024" in parts else 0.0
        fit *= 0.3 if path.startswith("/de/") else 1.0
        if fit >= v.SITEMAP_FIT:
            out.append((loc, fit))
    out = sorted(out, key=lambda x: (-round(x[1], 9), len(x[0]), x[0]))[: v.SITEMAP_LINKS]
    return [(u, round(f, 6), k + 1) for k, (u, f) in enumerate(out)]


@case(_pick_rows(), "loc VARCHAR,fit DOUBLE,place INTEGER")
def catalogue_pick(spark, sf_dir):
    want = given(spark, [(1, "e.org", ["common", "tungsten", "2024"], "en")], "query_id int, host string, terms array<string>, lang string")
    return expand.pick(given(spark, LOCS, "host string, loc string"), want).select("loc", R6("fit").alias("fit"), "place")


@case([(1, "https://e.org/a", "dead"), (2, "https://e.org/b", "thin"), (3, "https://e.org/", "root"), (4, "https://e.org/", None), (5, "https://e.org/c", None)], "i INTEGER,url VARCHAR,why VARCHAR")
def unusable_pages(spark, sf_dir):
    x = given(spark, [(1, "https://e.org/a", 404, "x" * 500, "news"), (2, "https://e.org/b", 200, "short", "news"), (3, "https://e.org/", 200, "x" * 500, "news"), (4, "https://e.org/", 200, "x" * 500, "navigational"), (5, "https://e.org/c", 200, "x" * 500, "news")], "i int, url string, status int, body string, intent string")
    return x.select("i", "url", expand.unusable(F.col("status"), F.col("body"), F.col("url"), F.col("intent")).alias("why"))


@case([(1, f"h{i:02d}.org", False) for i in range(8)] + [(1, "known.org", True), (1, "r1.org", False), (1, "r2.org", False), (1, "r3.org", False)], "query_id INTEGER,host VARCHAR,cached BOOLEAN")
def hosts_to_recover(spark, sf_dir):
    """Eight hosts in order of arrival, three more that were named by their front page, and known ones for nothing."""
    rows = [(1, i, f"https://h{i:02d}.org/x", "dead") for i in range(10)] + [(1, 20, "https://known.org/x", "thin")] + [(1, 30 + i, f"https://r{i}.org/", "root") for i in range(1, 6)]
    return expand.hosts_to_recover(given(spark, rows, "query_id int, arrival int, url string, why string"), given(spark, [("known.org",)], "host string"))


@case([(1, "https://e.org/tungsten", 0.45, "e.org sitemap")], "query_id INTEGER,url VARCHAR,prior DOUBLE,reason VARCHAR")
def catalogue_recovery(spark, sf_dir):
    """A page that is gone gives way to one of its host's catalogue, not to itself."""
    failed = given(spark, [(1, 0, "https://e.org/tungsten-old", "dead")], "query_id int, arrival int, url string, why string")
    locs = given(spark, [("e.org", "https://e.org/tungsten"), ("e.org", "https://e.org/tungsten-old"), ("e.org", "https://e.org/jobs")], "host string, loc string")
    return expand.recovered(failed, locs, given(spark, [(1, ["tungsten"], "en")], "query_id int, words array<string>, lang string"))


@case([(1, "a"), (1, "c"), (1, "d"), (2, "e")], "query_id INTEGER,url VARCHAR")
def route_gate(spark, sf_dir):
    """Hits whose title has nothing to do with the query go; those without a title, of a plan, or of a query without words stay."""
    q = given(spark, [(1, [["tungsten"]]), (2, [[]])], "query_id int, vocabularies array<array<string>>")
    hits = [(1, "a", "route:hn", "Tungsten prices"), (1, "b", "route:hn", "Cooking"), (1, "c", "route:hn", ""), (1, "d", "plan", "Cooking"), (2, "e", "route:hn", "Cooking")]
    return expand.admitted(given(spark, hits, "query_id int, url string, source string, title string"), q).select("query_id", "url")


@case([("a",), ("c",)], "url VARCHAR")
def presentable_rows(spark, sf_dir):
    return expand.presentable(given(spark, [("a", 200, "", ""), ("b", 404, "T", ""), ("c", 404, "T", "s")], "url string, status int, title string, snippet string")).select("url")


@case([(2, 1, "https://e.org/a", 0.0, True), (2, 2, "https://e.org/b", 0.0, True)], "query_id INTEGER,place INTEGER,url VARCHAR,score DOUBLE,unverified BOOLEAN")
def degraded_list(spark, sf_dir):
    """A query without results gets its plan's addresses, unverified; one address counts once."""
    plan = [(1, 0, "U", "https://e.org/x"), (2, 0, "U", "https://e.org/a"), (2, 1, "U", "https://www.e.org/a/"), (2, 2, "H", "https://e.org/h"), (2, 3, "P", "https://e.org/b")]
    return expand.degraded(given(spark, plan, "query_id int, arrival int, kind string, url string"), given(spark, [(1,)], "query_id int")).select("query_id", "place", "url", "score", "unverified")


@case([(1, "a.org", 0.9, 1), (1, "c.org", 0.5, 2), (1, "b.org", 0.4, 3)], "query_id INTEGER,site VARCHAR,fit DOUBLE,place INTEGER")
def hosts_by_fit(spark, sf_dir):
    rows = [("a.org", 0.1), ("a.org", 0.9), ("b.org", 0.4), ("c.org", 0.5), ("d.org", 0.3)]
    return expand.hosts_by_fit(given(spark, [(1, *r) for r in rows], "query_id int, site string, fit double"))


@case([(1, 4, 3, 2, 1, 1, 1)], "query_id INTEGER,dispatched INTEGER,fetched_ok INTEGER,from_plan INTEGER,from_routes INTEGER,from_links INTEGER,domains INTEGER")
def search_counters(spark, sf_dir):
    f = given(spark, [(1, "U", 200), (1, "P", 404), (1, "R", 200), (1, "E", 200)], "query_id int, kind string, status int")
    x = expand.counters(f, given(spark, [(1, "www.e.org"), (1, "docs.e.org")], "query_id int, site string"))
    return x.select(*[F.col(c).cast("int") for c in ("query_id", "dispatched", "fetched_ok", "from_plan", "from_routes", "from_links", "domains")])


@query("SELECT user_id AS query_id, count(*)::BIGINT AS calls, sum(event_id % 100)::BIGINT AS prompt_tokens, sum(event_id % 10)::BIGINT AS completion_tokens, sum(event_id % 100 + event_id % 10)::BIGINT AS total_tokens FROM events GROUP BY 1")
def model_usage(spark, sf_dir):
    """Token sums by query; events stand for calls."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 100).alias("prompt_tokens"), (F.col("event_id") % 10).alias("completion_tokens"))
    return expand.usage(e)


@case([(1, 0, "u0"), (1, 1, "u1"), (1, 3, "https://e.org/a/b/c")], "query_id INTEGER,arrival INTEGER,url VARCHAR")
def plan_tail(spark, sf_dir):
    """Two addresses of a plan, and of the next five those that name a page."""
    rows = [(1, 0, "u0"), (1, 1, "u1"), (1, 2, "https://e.org/"), (1, 3, "https://e.org/a/b/c"), (1, 9, "https://e.org/x")]
    return expand.tail_specific(given(spark, rows, "query_id int, arrival int, url string"), 2)


@case([(1, "a", True, True), (1, "b", True, False), (1, "c", False, False)], "query_id INTEGER,url VARCHAR,ok BOOLEAN,serp BOOLEAN")
def plan_outcomes(spark, sf_dir):
    k = "query_id int, url string"
    return sinks.outcomes(given(spark, [(1, "a"), (1, "b"), (1, "c"), (1, "a")], k), given(spark, [(1, "a", 200), (1, "b", 200), (1, "c", 404)], k + ", status int"), given(spark, [(1, "a")], k))


@case([(1, "T https://e.org/t 0.57 snip; U https://e.org/u 0.2 ", "https://d.org/", "https://e.org/t")], "query_id INTEGER,found VARCHAR,dead VARCHAR,shown VARCHAR")
def findings_report(spark, sf_dir):
    rows = [(1, 1, "https://e.org/t", "T", 0.567, "snip", 200), (1, None, "https://e.org/u", "U", 0.2, None, 200), (1, None, "https://d.org/", "", 0.0, "", 404)]
    x = expand.findings(given(spark, rows, "query_id int, place int, url string, title string, relevance double, snippet string, status int"))
    said = F.transform("found", lambda f: F.concat_ws(" ", f["title"], f["url"], f["relevance"].cast("string"), f["excerpt"]))
    return x.select("query_id", JOIN(said, "; ").alias("found"), JOIN("dead").alias("dead"), JOIN("shown").alias("shown"))


# ---------------------------------------------------------------- streams


def streamed(spark, batches: list[list[tuple]], schema: str) -> DataFrame:
    """Rows as a stream, a file and so a micro-batch for each of ``batches``, in order."""
    at = f"{shared(spark)}/case-{uuid.uuid4().hex}"
    for k, rows in enumerate(batches):
        given(spark, rows, schema).coalesce(1).write.parquet(f"{at}/{k}")
    kind = given(spark, [], schema).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(*[f"{at}/*"])


@case([(1, 0, "I code"), (1, 1, "U 1 https://e.org/a"), (2, 0, "end")], "query_id INTEGER,line INTEGER,text VARCHAR")
def stream_plan_lines(spark, sf_dir):
    """Lines of plans from chunks that come in pieces and out of order."""
    rows = [(1, 2, " https://e.org/a\n", False), (1, 0, "I co", False), (1, 1, "de\nU 1", False), (1, 3, "cut", False), (2, 0, "en", False), (2, 1, "d", True)]
    x = deadline.plan_lines(streamed(spark, [rows], "query_id int, seq int, chunk string, last boolean"))
    return deadline.collected(x, "plan_lines", "append")


T0 = dt.datetime(2024, 1, 1)


def _at(s: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=s)


@case([(1, "plan", "a"), (1, "plan", "b"), (1, "page", "a"), (2, "plan", "a")], "query_id INTEGER,kind VARCHAR,payload VARCHAR")
def stream_progress(spark, sf_dir):
    """Events that were told before are not told again."""
    rows = [(1, "plan", "a", _at(0)), (1, "plan", "a", _at(1)), (1, "plan", "b", _at(2)), (1, "page", "a", _at(3)), (2, "plan", "a", _at(4))]
    x = deadline.changed(streamed(spark, [rows], "query_id int, kind string, payload string, ts timestamp"))
    return deadline.collected(x.select("query_id", "kind", "payload"), "progress", "append")


@case([("a",), ("b",)], "host VARCHAR")
def stream_coalesced(spark, sf_dir):
    x = deadline.coalesced(streamed(spark, [[("a", _at(0)), ("a", _at(1)), ("b", _at(2))]], "host string, ts timestamp"))
    return deadline.collected(x.select("host"), "coalesced", "append")


MARKS = [
    (1, 1, 0, 0.0, "start"), (1, 2, 4, 5.0, "page"), (1, 3, 13, 6.0, "page"), (1, 4, 15, 9.0, "page"),  # the first address after 4 s: ten more from there
    (2, 5, 0, 1.0, "page"), (2, 6, 3, 2.0, "page"), (2, 7, 4, 0.0, "end"), (2, 8, 5, 9.0, "page"),
    (3, 9, 0, 1.0, "page"), (3, 10, 1, 0.0, "plan"), (3, 11, 2, 3.0, "page"), (3, 12, 4, 9.0, "page"),  # two seconds for stragglers after the plan
    (4, 13, 0, 1.0, "page"), (4, 14, 1, 2.0, "page"), (4, 15, 2, 3.0, "page"), (4, 16, 3, 9.0, "page"),  # three are enough
]


@case([(1, 1, 3, 6.0, "arrival"), (1, 2, 2, 5.0, "arrival"), (2, 1, 6, 2.0, "end"), (2, 2, 5, 1.0, "end"), (3, 1, 11, 3.0, "arrival"), (3, 2, 9, 1.0, "arrival"), (4, 1, 15, 3.0, "enough"), (4, 2, 14, 2.0, "enough")], "query_id BIGINT,place INTEGER,event_id BIGINT,score DOUBLE,closed_by VARCHAR")
def stream_marks(spark, sf_dir):
    """Grace that is handed back, an end mark, a window for stragglers, and enough pages."""
    x = streamed(spark, [[(q, e, _at(t), sc, k) for q, e, t, sc, k in MARKS]], "query_id long, event_id long, ts timestamp, score double, kind string")
    return deadline.collected(deadline.deadline_serp(x, 10, k=2, enough=3, grace_s=5, tail_s=2), "marks", "append")


@case([("standard", 6.0, 4.5), ("fast", 2.5, 1.0), ("explicit", 3.0, 0.0), ("supplied", 24.0, 0.0), ("slow planner", 30.0, 0.0)], "i VARCHAR,seconds DOUBLE,grace DOUBLE")
def search_budgets(spark, sf_dir):
    b = {"standard": deadline.budget("standard"), "fast": deadline.budget("fast"), "explicit": deadline.budget("fast", 3.0), "supplied": deadline.budget("deep", supplied=True), "slow planner": deadline.budget("fast", floor_s=30.0)}
    return given(spark, [(k, *x) for k, x in b.items()], "i string, seconds double, grace double")
