"""Stores of plans, search endpoints and sitemaps as tables, with their times to live."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text, urls
from ..functions import values as v

NUL = "\x00"
SITEMAP_BYTES = 4_000_000
SMALL = 500_000  # addresses that are broadcast at most


def plan_key(query: Column, model: Column, variant: Column, protocol: str = "1") -> Column:
    return F.sha1(F.concat_ws(NUL, F.lit(protocol), model, variant, F.lower(F.trim(query))))


def fresh_plans(asked: DataFrame, store: DataFrame, now: Column, ttl_days: int = v.PLAN_TTL_DAYS) -> DataFrame:
    """Left join of ``asked`` (plan_key) with the newest stored plan that is not older than its time to live."""
    newest = store.where(F.col("created") >= now - F.expr(f"INTERVAL {ttl_days} DAYS")).groupBy("plan_key").agg(F.max_by("raw", F.struct("created", "raw")).alias("raw"))
    return asked.join(newest, "plan_key", "left")


def upserted(store: DataFrame, rows: DataFrame, key: str, stamp: str) -> DataFrame:
    """A store after an upsert: the newest row of each key; of equal stamps the one whose columns as JSON have the smallest hash."""
    every = store.unionByName(rows)
    newest = Window.partitionBy(key).orderBy(F.desc(stamp), F.xxhash64(F.to_json(F.struct(*every.columns))))
    return every.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def no_store(spark: SparkSession) -> DataFrame:
    """A plan store that holds nothing, for engines without a cache."""
    return spark.createDataFrame([], "plan_key string, raw string, created timestamp")


def shared_plans(asked: DataFrame, store: DataFrame, key: str = "query_id") -> DataFrame:
    """The shared plan of each question: ``key``, raw, found (place of the key that hit). ``asked`` has an array ``keys``, best first."""
    each = asked.select(key, F.posexplode(F.slice("keys", 1, 4)).alias("found", "key"))
    hit = each.join(store.groupBy("key").agg(F.max_by("raw", F.struct("created", "raw")).alias("raw")), "key")
    return hit.groupBy(key).agg(F.min_by("raw", "found").alias("raw"), F.min("found").alias("found"))


def replayed(plans: DataFrame, first_s: float = 0.0, tokens_s: float = 0.0, key: str = "query_id") -> DataFrame:
    """Stored plans line by line: ``key``, line, text, at (seconds). A token is four characters; without a rate all lines come at ``first_s``."""
    x = plans.where("coalesce(raw, '') <> ''").select(key, F.posexplode(F.split("raw", "\n")).alias("line", "text"))
    sent = F.sum(F.length("text") + 1).over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("at", F.lit(first_s) + (sent / 4.0 / tokens_s if tokens_s else F.lit(0.0)))


def waves(candidates: DataFrame, per_host: int = v.HOST_GATE, at_once: int = v.GATE, key: str = "query_id") -> DataFrame:
    """Adds ``wave``: the round of fetches in which each candidate goes, if a site takes ``per_host`` at a time and all sites together ``at_once``."""
    site = urls.registrable(urls.host_of(F.col("url")))
    x = candidates.withColumn("__s", site)
    x = x.withColumn("__w", F.floor((F.row_number().over(Window.partitionBy(key, "__s").orderBy("arrival")) - 1) / per_host))
    x = x.withColumn("wave", F.floor((F.row_number().over(Window.partitionBy(key).orderBy("__w", "arrival")) - 1) / at_once))
    return x.withColumn("wave", F.greatest("wave", "__w").cast("int")).drop("__s", "__w")


def atlas(confirmed: DataFrame) -> DataFrame:
    """Search endpoints by host and template: times confirmed, last time. Templates must hold ``{}`` and be short."""
    ok = F.contains("template", F.lit("{}")) & (F.length("template") <= 600)
    return confirmed.where(ok).groupBy("host", "template").agg(F.count(F.lit(1)).alias("seen"), F.max("ts").alias("updated"))


def best_templates(store: DataFrame, now: Column, ttl_days: int = v.ATLAS_TTL_DAYS) -> DataFrame:
    """Each host's template with most confirmations, then the latest, then the smallest; too old ones don't count."""
    live = store.where(F.col("updated") >= now - F.expr(f"INTERVAL {ttl_days} DAYS"))
    n = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("seen"), F.desc("updated"), "template"))
    return live.withColumn("__n", n).where("__n = 1").drop("__n")


def search_addresses(templates: DataFrame, queries: DataFrame, terms: int = 8) -> DataFrame:
    """Search address of each (host, query) pair asked for, with the query's ``terms`` most telling words. Needs host; query in ``query``."""
    coded = F.replace(F.url_encode(text.keyword_query(F.col("query"), terms)), F.lit("+"), F.lit("%20"))
    return queries.join(templates, "host").withColumn("url", F.replace("template", F.lit("{}"), coded))


def sitemap_urls(bodies: DataFrame, limit: int = 20_000) -> DataFrame:
    """Addresses of sitemap bodies and whether each is an index: host, locs, is_index. Bodies are text; see ``unzipped`` for bytes."""
    locs = F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return bodies.select("host", F.slice(F.filter(locs, lambda u: F.startswith(u, F.lit("http"))), 1, limit).alias("locs"), F.rlike(F.substring("body", 1, 4096), F.lit("(?i)<sitemapindex")).alias("is_index"))


@F.pandas_udf(StringType())
def unzipped(raw: pd.Series) -> pd.Series:
    """Text of sitemap bytes, unpacked if they are gzip's, of which 4 MB are read; null if they can't be."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        try:
            return (zlib.decompressobj(31).decompress(b, SITEMAP_BYTES) if b[:2] == b"\x1f\x8b" else b[:SITEMAP_BYTES]).decode("utf-8", "replace")
        except zlib.error:
            return None

    return raw.map(one)


def robots_sitemaps(bodies: DataFrame) -> DataFrame:
    """At most four absolute sitemap addresses of a robots file on the host's own site: host, sitemaps."""
    found = F.transform(F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1)), lambda u: F.trim(u))
    own = F.filter(found, lambda u: F.startswith(u, F.lit("http")) & (urls.registrable(urls.host_of(u)) == urls.registrable(F.col("host"))))
    return bodies.select("host", F.slice(own, 1, 4).alias("sitemaps"))


def catalogues(hosts: DataFrame, robots: DataFrame, maps: DataFrame, limit: int = 20_000) -> DataFrame:
    """The page list of each host: host, locs. ``robots`` has (host, body), ``maps`` (url, body) of all maps that can be read.

    Maps that robots.txt names come before ``/sitemap.xml``; the first that is there counts. An
    index gives way to its first three children; five maps are read at most.
    """
    usual = F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml"))
    named = hosts.join(robots_sitemaps(robots), "host", "left").select("host", F.posexplode(F.concat(F.coalesce("sitemaps", F.array().cast("array<string>")), F.array(usual))).alias("i", "url"))
    read = sitemap_urls(maps.select(F.col("url").alias("host"), "body"), limit).withColumnRenamed("host", "url")
    first = named.join(read, "url").groupBy("host").agg(F.min_by(F.struct("locs", "is_index"), "i").alias("m")).select("host", "m.*")
    children = first.where("is_index").select("host", F.posexplode(F.slice("locs", 1, 3)).alias("i", "url")).join(read.where("NOT is_index").select("url", F.col("locs").alias("more")), "url")
    below = children.groupBy("host").agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "more"))), lambda c: c["more"])), 1, limit).alias("locs"))
    return first.where("NOT is_index").select("host", "locs").unionByName(below)


def known_sitemaps(asked: DataFrame, store: DataFrame, now: Column) -> DataFrame:
    """Stored catalogues by host: null if never asked or too old, empty if known to have none."""
    age = F.when(F.size("locs") > 0, F.expr(f"INTERVAL {v.SITEMAP_TTL_DAYS * 24} HOURS")).otherwise(F.expr(f"INTERVAL {v.SITEMAP_MISS_HOURS} HOURS"))
    return asked.join(store.where(F.col("updated") >= now - age).select("host", "locs"), "host", "left")


def keyed(pages: DataFrame) -> DataFrame:
    """Pages with their canonical address as ``url_key``: worth writing once, bucketed by it, for a corpus that is searched often."""
    return pages.withColumn("url_key", urls.canonical_url(F.col("url")))


def pages_of(candidates: DataFrame, pages: DataFrame, window_ms: int | None = None, key: str = "query_id") -> DataFrame:
    """Candidates with their page by canonical address; one without a page stays as an error row.

    Pages are cut to those asked for before anything is shuffled, where the candidates are
    few enough to be sent to all tasks; ``pages`` may have ``url_key`` already (see ``keyed``).
    Of pages with one canonical address the smallest spelling counts, and of equal spellings
    the smallest row, by its columns in order (those of types that have an order).
    ``error`` is null, ``not found``, or ``timeout`` where ``pages`` has fetch_ms over
    ``window_ms``; status is 200, 404 or 0.
    """
    p = pages if "url_key" in pages.columns else keyed(pages)
    x = candidates.withColumn("url_key", urls.canonical_url(F.col("url")))
    asked = x.select("url_key").distinct()
    p = p.join(F.broadcast(asked) if asked.count() <= SMALL else asked, "url_key", "left_semi")
    p = p.select("url_key", F.col("url").alias("final_url"), *[c for c in p.columns if c not in ("url", "url_key")])
    first = ["final_url", *[c for c, kind in p.dtypes if c not in ("url_key", "final_url") and not any(k in kind for k in ("map<", "variant", "interval"))]]
    p = p.withColumn("__n", F.row_number().over(Window.partitionBy("url_key").orderBy(*[F.col("`" + c.replace("`", "``") + "`") for c in first]))).where("__n = 1").drop("__n")
    x = x.join(p, "url_key", "left")
    late = F.coalesce(F.col("fetch_ms") > window_ms, F.lit(False)) if window_ms is not None and "fetch_ms" in pages.columns else F.lit(False)
    found = F.col("final_url").isNotNull()
    return x.withColumns({"status": F.when(~found, 404).when(late, 0).otherwise(200), "error": F.when(~found, "not found").when(late, "timeout")})


def backoff(strikes: DataFrame, base: float = 60.0, most: int = 5) -> DataFrame:
    """Seconds that a route rests after so many refusals in a row (``blocks``): base * 2^(blocks - 1), five doublings at most."""
    return strikes.withColumn("rest", F.when(F.col("blocks") > 0, F.lit(base) * F.pow(F.lit(2.0), F.least("blocks", F.lit(most)) - 1)).otherwise(0.0))


def strikes(answers: DataFrame) -> DataFrame:
    """Refusals in a row at the end of each route's answers: route, blocks. Needs route, ts, status."""
    bad = F.col("status").isin(400, 401, 403, 420, 429, 451, 503)
    w = Window.partitionBy("route").orderBy(F.desc("ts"), F.desc("status"))
    x = answers.where(bad | (F.col("status") == 200)).withColumn("__ok", F.sum((~bad).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("route").agg(F.count_if(F.col("__ok") == 0).cast("int").alias("blocks"))
