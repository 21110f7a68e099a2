"""Pieces of ANSI SQL that the oracle statements share."""

from __future__ import annotations

from ..functions import text
from ..functions import values as v


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(v.WORD)})"


def content(x: str) -> str:
    """Content words of English texts, case kept."""
    return f"list_filter(regexp_extract_all({x}, {lit(v.CONTENT_TOKEN)}), lambda t: starts_with(t, '\"') OR (lower(t) NOT IN ({quoted(v.STOP)}) AND length(t) > 1))"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"


def host(u: str) -> str:
    return f"regexp_replace(regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', '')"


def bare(h: str) -> str:
    return f"regexp_replace({h}, '^www\\.', '')"


def canonical(u: str) -> str:
    params = f"list_sort(list_filter(string_split(regexp_extract({u}, '^[^#?]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(regexp_extract(p, '^([^=]*)', 1)), {lit(v.TRACKING)})))"
    p = f"regexp_replace(url_decode({path(u)}), '/+$', '')"
    query = f"array_to_string({params}, '&')"
    return f"('https://' || {bare(host(u))} || CASE WHEN {p} = '' THEN '/' ELSE {p} END || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END)"


def registrable(h: str) -> str:
    b, n = bare(h), f"len(string_split({bare(h)}, '.'))"
    part = lambda i: f"string_split({b}, '.')[{n} - {i}]"
    tail = lambda k: f"array_to_string(list_slice(string_split({b}, '.'), {n} - {k - 1}, {n}), '.')"
    return f"(CASE WHEN {n} <= 2 THEN {b} WHEN ({part(1)} IN ({quoted(v.REGISTRY_SLD)}) AND length({part(0)}) = 2) OR {tail(2)} IN ({quoted(v.MULTI_TENANT)}) THEN {tail(3)} ELSE {tail(2)} END)"


def fold(x: str) -> str:
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("æ", "ae"), ("ø", "oe"), ("å", "aa"), ("œ", "oe")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"translate({x}, {lit(text.ACCENTS[0])}, {lit(text.ACCENTS[1])})"


def grams(x: str) -> str:
    """Anchored five-grams of a word written in letters."""
    a = f"('^' || {fold(x)} || '$')"
    return f"(CASE WHEN length({fold(x)}) >= 5 THEN list_distinct(list_transform(range(1, greatest(length({a}) - 4, 1) + 1), lambda i: substring({a}, i::INT, 5))) ELSE []::VARCHAR[] END)"


def gram_set(bag: str) -> str:
    return f"list_sort(list_distinct(flatten(list_transform({bag}, lambda w: {grams('w')}))))"


def dice(a: str, b: str) -> str:
    h = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN {h} > 0 THEN pow({h}::DOUBLE / len({a}), 0.75) * pow({h}::DOUBLE / len({b}), 0.25) ELSE 0.0 END)"


def cost(s: str) -> str:
    return f"(CASE WHEN coalesce(length({s}), 0) = 0 THEN 0 ELSE greatest(length({s}) // 4, 1) END)"


#: Queries q(query_id, ts), all words of each benchmark item; each one's ten best documents by BM25.
TOP = f"""q AS (
  SELECT query_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS ts FROM (SELECT item_id AS query_id, {tok("text")} AS w FROM benchmark)
), qt AS (
  SELECT query_id, unnest(ts) AS t FROM q
), d AS (
  SELECT doc_id, {tok("coalesce(text, '')")} AS ts FROM documents
), st AS (
  SELECT count(*) AS n, avg(len(ts)) AS mean FROM d
), tf AS (
  SELECT doc_id, len, t, count(*) AS f FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY ALL
), df AS (
  SELECT t, count(*) AS df FROM tf GROUP BY t
), bm AS (
  SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f / (f + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM qt JOIN tf USING (t) JOIN df USING (t), st GROUP BY ALL
), top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM bm) WHERE place <= 10
)"""
