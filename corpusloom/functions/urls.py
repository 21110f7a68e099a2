"""URL and host functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as v
from .text import let, tokens


def _set(words) -> Column:
    return F.array(*map(F.lit, words))


def authority_part(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def host_of(url: Column) -> Column:
    """Lower-case host, empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority_part(url), r"^.*@", ""), r":\d*$", ""))


def port_of(url: Column) -> Column:
    return F.regexp_extract(authority_part(url), r":(\d+)$", 1)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1), F.lit(""))


def fragment_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^[^#]*#(.*)$", 1), F.lit(""))


def decoded(part: Column) -> Column:
    """Percent escapes decoded; a plus stays a plus, and a part that can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part)


def atlas_host(url: Column) -> Column:
    """The host under which a site's search endpoint is filed: without www., not the registered domain."""
    return bare(host_of(url))


def bare(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """One spelling for each page: https, no www., port, fragment, tracking or trailing slash; parameters sorted."""
    return let(url, _canonical)


def _canonical(url: Column) -> Column:
    kept = F.array_sort(F.filter(F.split(query_of(url), "&"), lambda p: (p != "") & ~F.rlike(F.lower(F.regexp_extract(p, "^([^=]*)", 1)), F.lit(v.TRACKING))))
    query = F.array_join(kept, "&")
    path = F.regexp_replace(decoded(path_of(url)), "/+$", "")
    port = port_of(url)
    return F.concat(F.lit("https://"), bare(host_of(url)), F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def registrable(host: Column) -> Column:
    """Registered domain, approximately: two labels, three under a registry's second level or a shared host."""
    def of(parts: Column, n: Column) -> Column:
        tail = lambda k: F.array_join(F.slice(parts, n - (k - 1), k), ".")
        three = (F.get(parts, n - 2).isin(*v.REGISTRY_SLD) & (F.length(F.get(parts, n - 1)) == 2)) | tail(2).isin(*v.MULTI_TENANT)
        return F.when(n <= 2, F.array_join(parts, ".")).when(three, tail(3)).otherwise(tail(2))

    return let(F.split(bare(host), r"\."), lambda parts: of(parts, F.size(parts)))


def suffixes(host: Column) -> Column:
    """The host without www. and every domain above it."""
    parts = F.split(bare(F.regexp_replace(F.lower(host), r"\.+$", "")), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def authority(host: Column) -> Column:
    """Bonus of the longest listed suffix with at least two labels, else of the kind of registry suffix, else 0."""
    named = F.create_map(*[F.lit(x) for kv in v.AUTHORITY.items() for x in kv])
    parts = F.split(host, r"\.")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    listed = F.get(F.filter(F.transform(above, lambda s: F.try_element_at(named, s)), lambda x: x.isNotNull()), 0)
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.coalesce(listed, F.when(F.arrays_overlap(every, _set(v.PUBLIC)), 0.10), F.when(F.arrays_overlap(every, _set(v.ACADEMY)), 0.07), F.lit(0.0))


def path_words(path: Column) -> Column:
    """Whole slugs of a path, and each without a file extension; no path furniture. Sorted and distinct."""
    def of(whole: Column) -> Column:
        base = F.transform(F.filter(whole, lambda t: F.regexp_extract(t, r"^.+\.([^.]*)$", 1).isin(*v.PATH_STOP)), lambda t: F.regexp_extract(t, r"^(.+)\.[^.]*$", 1))
        return F.array_sort(F.array_distinct(F.concat(whole, base)))

    return let(F.filter(tokens(path), lambda t: ~t.isin(*v.PATH_STOP)), of)


def path_parts(path: Column) -> Column:
    """The words inside the slugs of a path, of two characters or more. Sorted and distinct."""
    split = F.flatten(F.transform(path_words(path), lambda t: F.split(t, r"[-_+./:%~]+")))
    return F.array_sort(F.array_distinct(F.filter(split, lambda p: (F.length(p) >= 2) & ~p.isin(*v.PATH_STOP))))


def anchor_terms(url: Column) -> Column:
    """At most four search strings that a fragment implies, in order."""
    frag = F.lower(decoded(F.trim(fragment_of(url))))
    words = F.filter(F.split(frag, r"[-_+.:/]+"), lambda w: F.length(w) >= 3)
    found = F.concat(F.array(frag), F.when(F.size(words) > 1, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>")), F.filter(words, lambda w: F.length(w) >= 8))
    found = F.slice(F.filter(F.array_distinct(found), lambda a: F.length(a) >= 6), 1, 4)
    size = F.length(F.trim(fragment_of(url)))
    return F.when((size > 0) & (size <= 120), found).otherwise(F.array().cast("array<string>"))


def specific(url: Column) -> Column:
    """Whether an address names a page and not a site or section."""
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    last = F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))
    return (F.size(parts) >= 3) | (F.length(last) >= 12) | F.contains(last, F.lit("-")) | F.contains(last, F.lit("."))


def section(url: Column) -> Column:
    """The part of a site that a page is in: its path without a file name at the end; empty at the root."""
    parts = F.filter(F.split(decoded(path_of(url)), "/"), lambda p: p != "")
    last = F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))
    parts = F.when(F.contains(last, F.lit(".")), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.when(F.size(parts) > 0, F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise("")


def unversioned(url: Column) -> Column:
    """Host and path without segments that name a release."""
    parts = F.filter(F.split(path_of(url), "/"), lambda p: (p != "") & ~F.rlike(F.lower(p), F.lit(r"^(v?\d+(\.\d+|\.x)*|latest|stable|master|main|current|dev)$")))
    return F.concat(bare(host_of(url)), F.lit("/"), F.array_join(parts, "/"))


def locale_of(path: Column) -> Column:
    """Language of a path that starts with a locale, else empty."""
    return F.lower(F.regexp_extract(path, r"^/([a-zA-Z]{2})(?:[-_][a-zA-Z]{2})?/", 1))


def dedup_key(url: Column, canonical: Column) -> Column:
    """The declared canonical address if it is on the same site and as deep, else the address itself."""
    c = F.coalesce(canonical, F.lit(""))
    slashes = lambda p: F.length(p) - F.length(F.replace(p, F.lit("/")))
    deep = lambda x, y: (x != "") & (slashes(x) == slashes(y))
    trimmed = lambda u: F.regexp_replace(path_of(u), "/+$", "")
    ok = F.rlike(c, F.lit("(?i)^https?://")) & (registrable(host_of(c)) == registrable(host_of(url))) & let(trimmed(c), lambda x: let(trimmed(url), lambda y: deep(x, y)))
    return F.when(ok, c).otherwise(url)


def accept_language(lang: Column) -> Column:
    lang = F.lower(F.trim(lang))
    return F.when((lang != "") & (lang != "en"), F.concat(lang, F.lit(",en;q=0.5")))


def clean_url(url: Column) -> Column:
    """An address out of running text: quotes, brackets and closing punctuation off, https."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), "^[<>\"'`,;]+|[<>\"'`,;]+$", ""), r"\.+$", "")
    closing = F.length(F.regexp_extract(u, r"(\)*)$", 1))
    extra = F.greatest(F.length(F.regexp_replace(u, r"[^)]", "")) - F.length(F.regexp_replace(u, r"[^(]", "")), F.lit(0))
    u = F.substring(u, F.lit(1), F.length(u) - F.least(closing, extra))
    return F.regexp_replace(u, "^http://", "https://")


def valid_url(url: Column) -> Column:
    return F.coalesce(F.rlike(url, F.lit(v.URL_OK)) & ~F.rlike(url, F.lit(v.SEARCH_ENGINE)) & (F.length(url) < v.MAX_URL), F.lit(False))


def spam(url: Column, title: Column, words: Column) -> Column:
    """Whether the address or title holds a spam word that the query doesn't."""
    pattern = "(?i)" + v.SPAM
    hit = F.lower(F.coalesce(F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(title, pattern, 1), F.lit(""))))
    return hit.isNotNull() & ~F.coalesce(F.array_contains(words, F.regexp_replace(hit, "^-+|-+$", "")), F.lit(False))
