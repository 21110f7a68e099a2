"""Following links, picking from catalogues, and the report for a second round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions import values as v


def link_fit(vocabularies: Column, url: Column, anchor: Column, context: Column, years: Column) -> Column:
    """How well a link says that it is the page a query wants: anchor, then address, then the sentence around it; the period decides between equals."""
    def of(path: Column) -> Column:
        by_path = F.greatest(text.best_fit(vocabularies, urls.path_words(path)), text.best_fit(vocabularies, urls.path_parts(path)))
        fit = F.greatest(text.best_fit(vocabularies, text.content_bag(anchor)), 0.85 * by_path, 0.6 * text.best_fit(vocabularies, text.content_bag(context)))
        d = text.date_fit(F.lit(None).cast("date"), path, anchor, years)
        return text.let(fit, lambda f: text.let(d, lambda d: F.when(d > 0, f * (1 + 0.6 * d)).otherwise(f + 0.30 * d)))

    return text.let(F.lower(urls.decoded(urls.path_of(url))), of)


def scored_links(links: DataFrame, queries: DataFrame) -> DataFrame:
    """Links of each query's pages with their fit.

    ``links`` has query_id, src, url, anchor, context (one row a link); ``queries`` has
    query_id, vocabularies and years. The join is on the query; a link that two pages share
    counts once, from the smaller source.
    """
    x = links.join(queries, "query_id")
    x = x.withColumn("fit", link_fit(F.col("vocabularies"), F.col("url"), F.coalesce("anchor", F.lit("")), F.coalesce("context", F.lit("")), F.col("years")))
    n = F.row_number().over(Window.partitionBy("query_id", "url").orderBy("src"))
    return x.withColumn("__n", n).where("__n = 1").drop("__n", "vocabularies", "years")


def _placed(scored: DataFrame) -> DataFrame:
    site = lambda c: urls.registrable(urls.host_of(F.col(c)))
    s, u = urls.section(F.col("src")), urls.section(F.col("url"))
    return scored.withColumns({"off_site": site("url") != site("src")}).withColumn("inside", ~F.col("off_site") & (F.length(s) > 1) & F.startswith(u, F.concat(s, F.lit("/"))))


def follow_hubs(scored: DataFrame, limit: int = v.HUB_LINKS) -> DataFrame:
    """Links to follow from index pages: query_id, url, anchor, score, prior, place."""
    x = _placed(scored).where(F.col("fit") >= F.when(F.col("inside"), v.HUB_SECTION_FIT).otherwise(v.HUB_FIT))
    x = x.withColumn("score", F.col("fit") + F.when(F.col("inside"), 0.12).otherwise(0.0) + F.when(F.col("off_site"), 0.05).otherwise(0.0))
    x = x.withColumn("__in", F.sum(F.col("inside").cast("int")).over(Window.partitionBy("query_id", "src")))
    x = x.where(F.col("inside") | (F.col("__in") < 2) | (F.col("score") >= v.HUB_FIT + 0.12))
    kind = F.row_number().over(Window.partitionBy("query_id", "inside").orderBy(F.desc("score"), "url"))
    x = x.withColumn("__k", kind).where(~F.col("inside") | (F.col("__k") <= v.HUB_SECTION_LINKS))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "url"))
    x = x.withColumn("place", place).where(F.col("place") <= limit)
    return x.select("query_id", "url", "anchor", "score", F.least(F.lit(0.75), 0.4 + F.col("score") / 2).alias("prior"), "place")


def follow_section(scored: DataFrame, idents: DataFrame) -> DataFrame:
    """Links of landed pages into their own sections: two a page, four a query. ``idents`` has query_id, src, ident."""
    x = _placed(scored).where("inside").join(idents, ["query_id", "src"]).where(F.col("fit") >= F.greatest(F.lit(v.HUB_SECTION_FIT), F.col("ident") / 2))
    x = x.withColumn("page_key", urls.unversioned(F.col("url")))
    best = F.row_number().over(Window.partitionBy("query_id", "page_key").orderBy(F.desc("fit"), "url"))
    x = x.withColumn("__n", best).where("__n = 1")
    x = x.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "src").orderBy(F.desc("fit"), "url"))).where(F.col("__n") <= v.DEEP_PER_PAGE)
    x = x.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fit"), "url"))).where(F.col("place") <= v.DEEP_LINKS)
    return x.select("query_id", "url", "anchor", F.col("fit").alias("score"), F.least(F.lit(0.8), 0.45 + F.col("fit") / 2).alias("prior"), "place")


def follow_deep(scored: DataFrame, idents: DataFrame) -> DataFrame:
    """Links that fit better than the page they are on; best fit of each page address, four a query."""
    x = _placed(scored).join(idents, ["query_id", "src"])
    x = x.withColumn("score", F.col("fit") - F.when(F.col("off_site"), 0.06).otherwise(0.0) + F.when(F.col("inside"), 0.12).otherwise(0.0))
    x = x.where(F.col("score") >= F.greatest(F.lit(v.DEEP_FIT), F.col("ident") + v.DEEP_MARGIN)).withColumn("page_key", urls.unversioned(F.col("url")))
    x = x.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "page_key").orderBy(F.desc("score"), "url"))).where("__n = 1")
    x = x.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "src").orderBy(F.desc("score"), "url"))).where(F.col("__n") <= v.DEEP_PER_PAGE)
    x = x.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "url"))).where(F.col("place") <= v.DEEP_LINKS)
    return x.select("query_id", "url", "anchor", "score", F.least(F.lit(0.8), 0.45 + F.col("score") / 2).alias("prior"), "place")


def pick(locs: DataFrame, wanted: DataFrame, n: int = v.SITEMAP_LINKS, least: float = v.SITEMAP_FIT) -> DataFrame:
    """The addresses of a host's catalogue that fit a query best.

    ``locs`` has host and loc; ``wanted`` has query_id, host, terms (distinct) and lang. Words
    in over 15 % of a catalogue of 40 or more are no evidence unless no other is left; a year
    is worth a little more and no word; other languages' editions come last.
    """
    parts = locs.select("host", "loc", urls.path_parts(urls.path_of(F.col("loc"))).alias("parts"), urls.path_words(urls.path_of(F.col("loc"))).alias("whole"), urls.locale_of(urls.path_of(F.col("loc"))).alias("locale"))
    size = parts.groupBy("host").agg(F.count(F.lit(1)).alias("n_locs"))
    df = parts.select("host", F.explode(F.array_distinct(F.transform("parts", text.fold))).alias("w")).groupBy("host", "w").agg(F.count(F.lit(1)).alias("df"))
    common = df.join(size, "host").where((F.col("n_locs") >= 40) & (F.col("df") > 0.15 * F.col("n_locs"))).groupBy("host").agg(F.collect_set("w").alias("common"))
    x = wanted.join(common, "host", "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>")))
    kept = F.filter("terms", lambda t: ~F.array_contains("common", text.fold(t)))
    x = x.withColumn("terms", F.when(F.size(kept) > 0, kept).otherwise(F.col("terms")))
    is_year = lambda t: F.rlike(t, F.lit(r"^(19|20)\d\d$"))
    x = x.withColumn("years", F.filter("terms", is_year)).withColumn("subject", F.filter("terms", lambda t: ~is_year(t)))
    x = x.withColumn("vocab", F.array(F.when(F.size("subject") > 0, F.col("subject")).otherwise(F.col("terms")))).drop("common", "subject")
    y = x.join(parts, "host")
    fit = F.greatest(text.best_fit(F.col("vocab"), F.col("whole")), text.best_fit(F.col("vocab"), F.col("parts")))
    y = y.withColumn("fit", fit).where(F.col("fit") >= least)
    y = y.withColumn("fit", F.col("fit") + F.when(F.arrays_overlap("years", "parts"), 0.05).otherwise(0.0))
    y = y.withColumn("fit", F.when((F.col("locale") != "") & (F.col("lang") != "") & (F.col("locale") != F.col("lang")), F.col("fit") * 0.3).otherwise(F.col("fit"))).where(F.col("fit") >= least)
    place = F.row_number().over(Window.partitionBy("query_id", "host").orderBy(F.desc(F.round("fit", 9)), F.length("loc"), "loc"))
    return y.withColumn("place", place).where(F.col("place") <= n).select("query_id", "host", "loc", "fit", "place")


def findings(rows: DataFrame, pages: int = 8, dead: int = 6, shown: int = 40, excerpt: int = 220) -> DataFrame:
    """Report of a first round: query_id, found (title, url, relevance, excerpt), dead and shown addresses.

    ``rows`` has query_id, place (null if not shown), url, title, relevance, snippet, status.
    """
    best = Window.partitionBy("query_id", F.col("status") == 200).orderBy(F.col("place").isNull(), "place", "url")
    x = rows.withColumn("__n", F.row_number().over(best))
    page = F.when((F.col("status") == 200) & (F.col("__n") <= pages), F.struct("__n", "title", "url", F.round("relevance", 2).alias("relevance"), F.substring(F.coalesce("snippet", F.lit("")), 1, excerpt).alias("excerpt")))
    gone = F.when((F.col("status") != 200) & (F.col("__n") <= dead), F.struct("__n", "url"))
    seen = F.when(F.col("place") <= shown, F.struct("place", "url"))
    got = x.groupBy("query_id").agg(F.array_sort(F.collect_list(page)).alias("found"), F.array_sort(F.collect_list(gone)).alias("dead"), F.array_sort(F.collect_list(seen)).alias("shown"))
    return got.select("query_id", F.transform("found", lambda f: F.struct(f["title"], f["url"], f["relevance"], f["excerpt"])).alias("found"), F.transform("dead", lambda f: f["url"]).alias("dead"), F.transform("shown", lambda f: f["url"]).alias("shown"))


def report(planned: DataFrame, fetched: DataFrame, serp: DataFrame) -> DataFrame:
    """What became of each planned address: query_id, url, ok, serp."""
    f = fetched.where("status = 200").select("query_id", F.col("url").alias("url"), F.lit(True).alias("__ok")).distinct()
    s = serp.select("query_id", "url", F.lit(True).alias("__s")).distinct()
    return planned.select("query_id", "url").distinct().join(f, ["query_id", "url"], "left").join(s, ["query_id", "url"], "left").select("query_id", "url", F.col("__ok").isNotNull().alias("ok"), F.col("__s").isNotNull().alias("serp"))


def tail_specific(candidates: DataFrame, taken: int, scan: int = 5, keep: int = 3) -> DataFrame:
    """The first ``taken`` addresses of a plan, and of the next ``scan`` at most ``keep`` that name a page."""
    w = Window.partitionBy("query_id").orderBy("arrival")
    x = candidates.withColumns({"__n": F.row_number().over(w), "__s": urls.specific(F.col("url")).cast("int")})
    late = (F.col("__n") > taken) & (F.col("__n") <= taken + scan) & (F.col("__s") == 1)
    x = x.withColumn("__k", F.sum(late.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.where((F.col("__n") <= taken) | (late & (F.col("__k") <= keep))).drop("__n", "__s", "__k")


def unusable(status: Column, body: Column, url: Column, intent: Column) -> Column:
    """Why a fetch gave no page to rank: dead, thin, root (a site's front page for a topical query), or null."""
    front = F.regexp_replace(urls.path_of(url), "^/+|/+$", "") == ""
    return F.when(status != 200, "dead").when(F.length(F.coalesce(body, F.lit(""))) < v.THIN_TEXT, "thin").when((intent != "navigational") & front, "root")


def title_fit(vocabularies: Column, title: Column) -> Column:
    return text.best_fit(vocabularies, text.title_bag(F.lower(title)))


def admitted(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits of routes whose title fits the query at all; hits without a title, other sources and queries without words pass. Needs source, title."""
    x = hits.join(queries.select("query_id", "vocabularies"), "query_id", "left")
    judged = F.startswith("source", F.lit("route:")) & (F.coalesce("title", F.lit("")) != "") & (F.coalesce(F.size(F.flatten("vocabularies")), F.lit(0)) > 0)
    return x.where(~judged | (title_fit(F.col("vocabularies"), F.coalesce("title", F.lit(""))) >= v.ROUTE_TITLE_FIT)).drop("vocabularies")


def presentable(rows: DataFrame) -> DataFrame:
    """Rows that were fetched, or whose candidate has both a title and a snippet."""
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    return rows.where((F.col("status") == 200) | (said("title") & said("snippet")))


def hosts_by_fit(pages: DataFrame, most: int = v.SITE_SEARCH_HOSTS) -> DataFrame:
    """The sites whose best page fits a query best, those worth asking with their own search: query_id, site, fit, place. Needs site and fit."""
    best = pages.groupBy("query_id", "site").agg(F.max("fit").alias("fit"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fit"), "site"))).where(F.col("place") <= most)


def hosts_to_recover(failed: DataFrame, cached: DataFrame) -> DataFrame:
    """Hosts of unusable pages whose catalogue is worth reading: query_id, host, cached.

    ``failed`` has query_id, arrival, url and why; ``cached`` the hosts with a known catalogue,
    which cost nothing. Eight others are asked in order of arrival, and three more that were
    named by their front page.
    """
    x = failed.withColumn("host", urls.host_of(F.col("url"))).where("host <> ''").groupBy("query_id", "host").agg(F.min("arrival").alias("arrival"), F.min_by("why", "arrival").alias("why"))
    x = x.join(cached.select("host").distinct().withColumn("cached", F.lit(True)), "host", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "cached").orderBy("arrival", "host")))
    extra = ~F.col("cached") & (F.col("n") > v.SITEMAP_HOSTS) & (F.col("why") == "root")
    x = x.withColumn("e", F.sum(extra.cast("int")).over(Window.partitionBy("query_id", "cached").orderBy("arrival", "host").rowsBetween(Window.unboundedPreceding, 0)))
    return x.where(F.col("cached") | (F.col("n") <= v.SITEMAP_HOSTS) | (extra & (F.col("e") <= v.SITEMAP_ROOT_EXTRA))).select("query_id", "host", "cached")


def recovered(failed: DataFrame, locs: DataFrame, queries: DataFrame) -> DataFrame:
    """Addresses from the catalogues of hosts that failed: query_id, url, prior, reason. ``locs`` has host and loc; ``queries`` query_id, words and lang."""
    hosts = hosts_to_recover(failed, locs.select("host"))
    wanted = hosts.select("query_id", "host").join(queries.select("query_id", F.col("words").alias("terms"), "lang"), "query_id")
    same = failed.select("query_id", urls.canonical_url(F.col("url")).alias("__u")).distinct()
    x = pick(locs, wanted).withColumn("__u", urls.canonical_url(F.col("loc"))).join(same, ["query_id", "__u"], "left_anti")
    return x.select("query_id", F.col("loc").alias("url"), F.lit(v.SITEMAP_PRIOR).alias("prior"), F.concat("host", F.lit(" sitemap")).alias("reason"))


def degraded(planned: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """A plan's own addresses, unverified and with score 0, for queries that have no result: query_id, place, url, title, site, score, unverified."""
    x = planned.where("kind <> 'H'").join(results.select("query_id").distinct(), "query_id", "left_anti")
    first = F.row_number().over(Window.partitionBy("query_id", "__u").orderBy("arrival"))
    x = x.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy("arrival"))).where(F.col("__n") <= k)
    x = x.withColumn("__u", urls.canonical_url(F.col("url"))).withColumn("__f", first).where("__f = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("arrival"))
    return x.select("query_id", place.alias("place"), "url", F.col("url").alias("title"), urls.bare(urls.host_of(F.col("url"))).alias("site"), F.lit(0.0).alias("score"), F.lit(True).alias("unverified"))


def counters(fetched: DataFrame, results: DataFrame) -> DataFrame:
    """Figures of each search: query_id, dispatched, fetched_ok, from plan, routes, links, domains. ``fetched`` has kind and status, ``results`` site."""
    kind = lambda *k: F.count_if(F.col("kind").isin(*k))
    f = fetched.groupBy("query_id").agg(F.count(F.lit(1)).alias("dispatched"), F.count_if(F.col("status") == 200).alias("fetched_ok"), kind("U", "P").alias("from_plan"), kind("R").alias("from_routes"), kind("E", "D", "S", "M").alias("from_links"))
    d = results.groupBy("query_id").agg(F.count_distinct(urls.registrable(F.col("site"))).alias("domains"))
    return f.join(d, "query_id", "left").fillna({"domains": 0})


def usage(calls: DataFrame) -> DataFrame:
    """Tokens of the model calls of each query: query_id, calls, prompt_tokens, completion_tokens, total_tokens."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    x = calls.groupBy("query_id").agg(F.count(F.lit(1)).alias("calls"), n("prompt_tokens").alias("prompt_tokens"), n("completion_tokens").alias("completion_tokens"))
    return x.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
