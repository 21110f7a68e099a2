"""One row for each page of a candidate set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls


def by_address(docs: DataFrame, key: str = "query_id") -> DataFrame:
    """Rows of one canonical address become one: the longest text, the smallest arrival, and how many agreed.

    Needs ``key``, arrival, url, text; ``canonical`` and ``consensus`` if there are any. Adds
    ``url_key`` and ``consensus``. Equal lengths go to the earlier arrival.
    """
    canonical = F.col("canonical") if "canonical" in docs.columns else F.lit(None).cast("string")
    had = F.col("consensus") if "consensus" in docs.columns else F.lit(1)
    d = docs.withColumn("url_key", urls.canonical_url(urls.dedup_key(F.col("url"), canonical))).withColumn("consensus", had)
    same = Window.partitionBy(key, "url_key")
    best = same.orderBy(F.desc(F.length(F.coalesce("text", F.lit("")))), "arrival")
    d = d.withColumns({"__n": F.row_number().over(best), "__first": F.min("arrival").over(same), "consensus": F.sum("consensus").over(same).cast("int")})
    return d.where("__n = 1").withColumn("arrival", F.col("__first")).drop("__n", "__first")


def by_opening(docs: DataFrame, key: str = "query_id") -> DataFrame:
    """Rows whose texts open alike become one: the longest text, then the shortest, then the smallest url."""
    d = docs.withColumn("__f", text.fingerprint(F.coalesce("text", F.lit(""))))
    keep = d.where("__f = ''")
    best = Window.partitionBy(key, "__f").orderBy(F.desc(F.length("text")), F.length("url"), "url")
    return keep.unionByName(d.where("__f <> ''").withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")).drop("__f")


def stays_by_opening(docs: DataFrame, id_col: str = "doc_id", key: str = "query_id") -> DataFrame:
    """``key`` and ``id_col`` of the rows that ``by_opening`` keeps, without moving their texts: grouped minima of (length, url), combined before the shuffle."""
    d = docs.select(key, id_col, text.fingerprint(F.coalesce("text", F.lit(""))).alias("f"), F.struct((-F.length("text")).alias("n"), F.length("url").alias("u"), F.col("url").alias("url")).alias("r"))
    best = d.where("f <> ''").groupBy(key, "f").agg(F.min_by(id_col, "r").alias(id_col))
    return d.where("f = ''").select(key, id_col).unionByName(best.select(key, id_col))


def stays_by_address(docs: DataFrame, id_col: str = "doc_id", key: str = "query_id") -> DataFrame:
    """``key``, url_key, ``id_col``, consensus and arrival of the rows that ``by_address`` keeps, without moving their texts."""
    d = docs.select(key, id_col, "arrival", urls.canonical_url(F.col("url")).alias("url_key"), (-F.length(F.coalesce("text", F.lit("")))).alias("n"))
    return d.groupBy(key, "url_key").agg(F.min_by(id_col, F.struct("n", "arrival")).alias(id_col), F.count(F.lit(1)).cast("int").alias("consensus"), F.min("arrival").alias("arrival"))


def distinct_candidates(candidates: DataFrame, key: str = "query_id") -> DataFrame:
    """First arrival of each canonical address (before anything is fetched)."""
    first = Window.partitionBy(key, "url_key").orderBy("arrival")
    return candidates.withColumn("url_key", urls.canonical_url(F.col("url"))).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def allowed(docs: DataFrame, domains: DataFrame, keep: bool = True) -> DataFrame:
    """Rows whose host is, or is under, a listed domain (``keep``), or the rest.

    ``domains`` has a column ``domain``. A host is matched by equality on each of its
    suffixes, so the list joins by hash and never as a nested loop.
    """
    listed = domains.select(urls.bare(F.regexp_replace(F.lower(F.trim("domain")), r"\.+$", "")).alias("__d")).where("__d <> ''").distinct()
    hosts = docs.select(urls.host_of(F.col("url")).alias("__h")).distinct().select("__h", F.explode(urls.suffixes(F.col("__h"))).alias("__d"))
    hit = hosts.join(listed, "__d", "left_semi").select("__h").distinct()
    return docs.withColumn("__h", urls.host_of(F.col("url"))).join(hit, "__h", "left_semi" if keep else "left_anti").drop("__h")


def unseen(candidates: DataFrame, shown: DataFrame, key: str = "query_id") -> DataFrame:
    """Candidates whose canonical address the query has not been shown."""
    done = shown.select(key, urls.canonical_url(F.col("url")).alias("__u")).distinct()
    return candidates.withColumn("__u", urls.canonical_url(F.col("url"))).join(done, [key, "__u"], "left_anti").drop("__u")
