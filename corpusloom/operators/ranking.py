"""Ranking signals over candidate sets, every one a grouped or windowed expression by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions import values as v


SMALL = 500_000  # rows of (query, term) that are broadcast at most


def weights(intent: Column, lang: Column, recent: Column, overrides: dict[str, float] | None = None) -> dict[str, Column]:
    """Fusion weights of each row: default, then intent, then script, then the caller's; a query that wants news is fresh at least."""
    unknown = sorted(set(overrides or {}) - set(v.WEIGHTS))
    if unknown:
        raise ValueError(f"unknown ranking weights: {', '.join(unknown)}; known: {', '.join(sorted(v.WEIGHTS))}")
    out = {}
    for name, base in v.WEIGHTS.items():
        w = F.lit(float(base))
        for k, table in v.INTENT_WEIGHTS.items():
            if name in table:
                w = F.when(intent == k, table[name]).otherwise(w)
        if name in v.SCRIPT_WEIGHTS:
            w = F.when(lang.isin(*v.NON_LATIN), v.SCRIPT_WEIGHTS[name]).otherwise(w)
        if overrides and name in overrides:
            w = F.lit(float(overrides[name]))
        out[name] = F.greatest(w, F.when(recent, v.RECENT_FRESH).otherwise(0.0)) if name == "fresh" else w
    return out


def bm25(passages: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, key: str = "query_id", top: int = 400, stem=None) -> DataFrame:
    """BM25 of passages within each query's candidate set: ``key``, doc_id, pos, score, for the ``top`` best passages.

    ``passages`` has ``key``, doc_id, pos, text; ``queries`` has ``key`` and text, and may have
    ``lang``, whose function words are then no terms. A term counts once in a query; idf is
    ln(1 + (N - df + .5) / (df + .5)). ``stem`` turns a word column into its stem, if given.
    """
    def words(s: Column, lang: Column | None = None) -> Column:
        ts = text.tokens(s)
        if lang is not None:
            ts = F.filter(ts, lambda t: ~(lang.isin(*v.STOPWORD_LANGS) & F.array_contains(text.stop_words(lang), t)))
        return F.transform(ts, stem) if stem else ts

    lang = F.col("lang") if "lang" in queries.columns else None
    asked = queries.select(key, F.explode(F.array_distinct(words(F.col("text"), lang))).alias("t"))
    p = passages.join(queries.select(key, "lang"), key) if lang is not None else passages
    p = p.select(key, "doc_id", "pos", words(F.col("text"), lang).alias("ts"))
    stats = p.groupBy(key).agg(F.count(F.lit(1)).alias("N"), F.avg(F.size("ts")).alias("avg"))
    tf = p.select(key, "doc_id", "pos", F.size("ts").alias("len"), F.explode("ts").alias("t")).join(asked, [key, "t"], "left_semi")
    tf = tf.groupBy(key, "doc_id", "pos", "len", "t").agg(F.count(F.lit(1)).alias("f"))
    df = tf.groupBy(key, "t").agg(F.count(F.lit(1)).alias("df"))
    x = tf.join(df, [key, "t"]).join(stats, key)
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("f") / (F.col("f") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    scored = x.groupBy(key, "doc_id", "pos").agg(F.sum(part).alias("score"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "doc_id", "pos"))
    return scored.withColumn("__n", best).where(F.col("__n") <= top).drop("__n")


def bm25_corpus(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of one shared corpus for many queries at once: query_id, doc_id, score.

    Only postings of the queries' terms leave the scan, and they are dealt by document once:
    term counts, weights and the sum over each query's terms then need no other shuffle of
    postings. What meets them, the queries' terms with their document counts, is sent to all
    tasks where it is small enough, and else joined by shuffles.
    """
    sized = lambda df, n: F.broadcast(df) if n <= SMALL else df
    d = docs.select("doc_id", text.plain_tokens(F.coalesce("text", F.lit(""))).alias("ts"))
    asked = queries.select("query_id", F.explode(F.array_distinct(text.plain_tokens(F.col("text")))).alias("t"))
    n = asked.count()
    tf = d.select("doc_id", F.size("ts").alias("len"), F.explode("ts").alias("t")).join(sized(asked.select("t").distinct(), n), "t", "left_semi")
    tf = tf.repartition("doc_id").groupBy("doc_id", "len", "t").agg(F.count(F.lit(1)).alias("f"))
    stats = d.agg(F.count(F.lit(1)).alias("N"), F.avg(F.size("ts")).alias("avg"))  # one row
    df = tf.groupBy("t").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats))
    terms = asked.join(df, "t").select("query_id", "t", F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg")
    part = F.col("idf") * F.col("f") / (F.col("f") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return tf.join(sized(terms, n), "t").select("query_id", "doc_id", part.alias("w")).groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))


def best_passage(scored: DataFrame, key: str = "query_id") -> DataFrame:
    """Each document's best passage: ``key``, doc_id, score, pos (the earlier of equals)."""
    return scored.groupBy(key, "doc_id").agg(F.max(F.struct(F.col("score"), (-F.col("pos")).alias("p"))).alias("b")).select(key, "doc_id", F.col("b.score").alias("score"), (-F.col("b.p")).alias("pos"))


def minmax(col: str, key: str = "query_id") -> Column:
    """Scaled to 0..1 over the candidate set; 0 where all are equal."""
    w = Window.partitionBy(key)
    low, high = F.min(col).over(w), F.max(col).over(w)
    return F.when(high - low < 1e-9, 0.0).otherwise((F.col(col) - low) / (high - low))


def norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two vectors; norms that are known need not be worked out for each pair."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (((norm(a) if norm_a is None else norm_a) + 1e-9) * ((norm(b) if norm_b is None else norm_b) + 1e-9))


def best_cosine(passages: DataFrame, queries: DataFrame, key: str = "query_id") -> DataFrame:
    """Each document's best passage by cosine, not below 0: ``key``, doc_id, emb, pos. Both sides have ``vector``; the join is on the query."""
    q = queries.select(key, F.col("vector").alias("__q"), norm(F.col("vector")).alias("__nq"))
    x = passages.withColumn("__np", norm(F.col("vector"))).join(q, key)
    x = x.withColumn("__c", F.greatest(cosine(F.col("__q"), F.col("vector"), F.col("__nq"), F.col("__np")), F.lit(0.0)))
    return x.groupBy(key, "doc_id").agg(F.max("__c").alias("emb"), F.min_by("pos", F.struct(-F.col("__c"), "pos")).alias("pos"))


def reranked(features: DataFrame, scores: DataFrame, key: str = "query_id") -> DataFrame:
    """Adds ``ce``, the best score of each document's windows, for the first ``RERANK_DEPTH`` rows by ``prelim``; null elsewhere.

    ``scores`` (``key``, doc_id, ce) comes from any model: a table, or a pandas UDF over
    ``passages.reranker_windows``.
    """
    best = scores.groupBy(key, "doc_id").agg(F.max("ce").alias("ce"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("prelim"), "url"))
    x = features.drop("ce").withColumn("__n", place).join(best, [key, "doc_id"], "left")
    return x.withColumn("ce", F.when(F.col("__n") <= v.RERANK_DEPTH, F.col("ce"))).drop("__n")


def term_coverage(terms: Column, blob: Column) -> Column:
    """Share of terms that the text holds anywhere."""
    hit = F.size(F.filter(terms, lambda t: F.contains(blob, t)))
    return F.when((F.size(terms) > 0) & (F.trim(blob) != ""), hit / F.size(terms)).otherwise(0.0)


def _weighted(present: DataFrame, group: list[str], key: str, rare: bool) -> DataFrame:
    """Coverage weighted by how much each term separates the candidates; ``present`` has 0/1 in ``p``."""
    over = Window.partitionBy(*group, "t")
    n, df = F.count(F.lit(1)).over(over), F.sum("p").over(over)
    idf = F.greatest(F.log((n + 1.0) / (df + 0.5)), F.lit(0.0))
    if rare:
        named = F.rlike("t", F.lit(v.IDENTIFIER)) & ~F.rlike("t", F.lit(v.BARE_NUMBER)) & ~F.rlike("t", F.lit(v.PERIOD))
        idf = F.when(named & (df > 0) & (df < n), idf).otherwise(0.0)
    got = present.withColumn("idf", idf).groupBy(*group, "doc_id").agg(F.sum(F.col("p") * F.col("idf")).alias("a"), F.sum("idf").alias("z"), F.avg("p").alias("m"))
    return got.select(*group, "doc_id", F.when(F.col("z") > 1e-6, F.col("a") / F.col("z")).otherwise(F.lit(0.0) if rare else F.col("m")).alias("score"))


def aspect_coverage(docs: DataFrame, vocabularies: DataFrame, key: str = "query_id") -> DataFrame:
    """Share of a query's constraints that a page announces itself to be about; best vocabulary wins.

    ``docs`` has ``key``, doc_id and ``ident`` (distinct words of title, description, address
    and opening); ``vocabularies`` has ``key``, vocab_id and ``terms``.
    """
    d = docs.select(key, "doc_id", "ident", text.gram_set(F.col("ident")).alias("ig"))
    terms = vocabularies.select(key, "vocab_id", F.explode(F.filter(F.array_distinct("terms"), lambda t: F.length(t) >= 3)).alias("t")).withColumn("tg", text.grams(F.col("t")))
    x = d.join(terms, key)
    share = F.size(F.array_intersect("tg", "ig")) / F.size("tg")
    hit = F.array_contains("ident", F.col("t")) | ((F.size("tg") > 0) & (share >= v.ASPECT_HIT))
    present = x.select(key, "vocab_id", "doc_id", "t", F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0).alias("p"))
    scored = _weighted(present, [key, "vocab_id"], key, False)
    return scored.groupBy(key, "doc_id").agg(F.max("score").alias("aspect"))


def rare_coverage(docs: DataFrame, queries: DataFrame, key: str = "query_id") -> DataFrame:
    """Weighted share of a query's identifiers that a page holds as whole words, among those that tell pages apart.

    ``docs`` has ``key``, doc_id, blob (lower-case); ``queries`` has ``key`` and terms.
    """
    terms = queries.select(key, F.explode(F.slice(F.filter(F.array_distinct("terms"), lambda t: F.length(t) >= 3), 1, 12)).alias("t"))
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), "t", F.lit(r"\E(?![a-z0-9])"))
    present = docs.join(terms, key).select(key, "doc_id", "t", F.when(F.contains("blob", F.col("t")) & F.rlike("blob", quoted), 1.0).otherwise(0.0).alias("p"))
    return _weighted(present, [key], key, True).withColumnRenamed("score", "rare")


SIGNALS = ("lex", "emb", "title", "url", "host", "rare", "covered", "aspect")


def fused(features: DataFrame, w: dict[str, Column], strict_head: bool = False) -> DataFrame:
    """Preliminary and final scores and absolute relevance.

    ``features`` has, for each row, the columns of ``SIGNALS`` (lex and emb scaled), emb_raw,
    prior, authority, consensus (0..1), fresh, date, thin, dead, root, orphan, spam, and ce,
    the reranker's probability or null where it did not run. With ``strict_head`` the first
    ``RERANK_DEPTH`` rows by preliminary score count as reranked even without a score.
    """
    relevance = sum((w[s] * F.col(s) for s in SIGNALS), F.lit(0.0))
    static = w["prior"] * F.col("prior") + w["authority"] * F.col("authority") + w["consensus"] * F.col("consensus")
    period = w["fresh"] * F.col("fresh") + w["date"] * F.col("date")
    penalty = w["thin"] * F.col("thin") + w["dead"] * F.col("dead") + w["root"] * F.col("root") + w["orphan"] * F.col("orphan") + F.col("spam")
    x = features.withColumns({"__r": relevance, "__s": static + period, "__p": penalty})
    x = x.withColumn("prelim", F.col("__r") + F.col("__s") - F.col("__p"))
    ce = F.col("ce")
    if strict_head:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("prelim"), "url"))
        x = x.withColumn("ce", F.when(place <= v.RERANK_DEPTH, F.coalesce(ce, F.lit(0.0))))
    signal = F.coalesce(ce, F.greatest("lex", "emb"))
    final = F.col("__r") + (0.30 + 0.70 * signal) * F.col("__s") - F.col("__p") + w["ce"] * F.coalesce(ce, F.lit(0.0))
    seen = F.coalesce(ce, F.greatest("emb_raw", "title", "url"))
    return x.withColumns({"score": final, "relevance": seen}).drop("__r", "__s", "__p")
