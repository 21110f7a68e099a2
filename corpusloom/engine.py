"""Batch search over a page corpus: many queries at once, every stage keyed by query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import text, urls
from .functions import values as v
from .operators import dedup, expand, extract, passages, ranking, serp
from .operators.cut import kept
from .plans import recall
from .sources import routes as site_routes
from .sources import stores

#: What a candidate carries besides its address; plans give the first few, routes the rest.
CANDIDATE = {"query_id": None, "arrival": None, "kind": None, "url": None, "prior": "double", "pinned": "int", "reason": "string", "source": "string", "title": "string", "snippet": "string", "content": "string", "skip_fetch": "boolean"}
RESULT = ["query_id", "place", "url", "title", "snippet", "score", "relevance", "published", "site", "text", "passages", "passage_scores", "source"]


class Options:
    """Checked search options."""

    def __init__(self, top_k: int = 10, depth: str = "standard", max_per_host: int = 2, weights: dict | None = None, min_relevance: float = v.MIN_RELEVANCE, snippet_chars: int = 340, snippet_windows: int = 1, token_budget: int = 0, token_budget_per_page: int = 0, passages_per_page: int = 0, after: str | None = None, before: str | None = None, require_date: bool = False, freshness: str | None = None, today: str | None = None, rounds: int = 1, page: int = 1, follow: bool = True) -> None:
        if depth not in v.TIERS:
            raise ValueError(f"depth must be one of {', '.join(v.TIERS)}")
        if not 1 <= top_k <= 100:
            raise ValueError("top_k must be 1 to 100")
        if rounds not in (1, 2):
            raise ValueError("rounds must be 1 or 2")
        if not 1 <= page <= v.MAX_PAGE:
            raise ValueError(f"page must be 1 to {v.MAX_PAGE}")
        if after and before and after > before:
            raise ValueError("after must not be later than before")
        if freshness is not None and freshness not in v.FRESH_DAYS:
            raise ValueError(f"freshness must be one of {', '.join(v.FRESH_DAYS)}")
        if freshness and after:
            raise ValueError("give freshness or after, not both")
        for name, x in (("max_per_host", max_per_host), ("snippet_chars", snippet_chars), ("snippet_windows", snippet_windows)):
            if x < 1:
                raise ValueError(f"{name} must be positive")
        self.__dict__ |= {k: x for k, x in locals().items() if k not in ("self", "name", "x")}


def analysed(queries: DataFrame) -> DataFrame:
    """query_id, query, words, years, recent, guessed intent and language. Needs query_id and query; empty queries are left out."""
    q = F.substring(F.trim(F.regexp_replace(F.coalesce("query", F.lit("")), r"\s+", " ")), 1, v.MAX_QUERY)
    x = queries.select("query_id", q.alias("query")).where("query <> ''")
    return x.select("query_id", "query", F.array_distinct(text.tokens(F.col("query"))).alias("words"), text.query_years(F.col("query")).alias("years"), text.wants_recent(F.col("query")).alias("recent"), text.guess_intent(F.col("query")).alias("guessed_intent"), text.guess_lang(F.col("query")).alias("guessed_lang"))


def with_plan(q: DataFrame) -> DataFrame:
    """Adds what depends on the plan: terms (16 at most, those of other wordings after the query's own), vocabularies, and the text that lexical scores go by."""
    none = F.array().cast("array<string>")
    q = q.withColumns({"intent": F.coalesce("intent", "guessed_intent"), "lang": F.coalesce("lang", "guessed_lang"), "expansions": F.coalesce("expansions", none)})
    said = F.filter(F.flatten(F.transform("expansions", lambda e: text.query_terms(e))), lambda t: F.length(t) >= 3)
    own = text.query_terms(F.col("query"), F.col("lang"))
    return q.withColumns({
        "terms": F.slice(F.array_distinct(F.concat(own, said)), 1, 16),
        "vocabularies": F.concat(F.array("words"), F.transform(F.slice("expansions", 1, 6), lambda e: F.array_distinct(text.tokens(e)))),
        "asked": F.concat_ws(" ", "query", F.array_join(F.slice("expansions", 1, 3), " ")),
    })


def generated_plans(queries: DataFrame, extracted: DataFrame, most: int) -> DataFrame:
    """Candidates for queries without a plan: the corpus pages that share their rarest words (an addition of this engine)."""
    docs = extracted.select(F.col("url").alias("doc_id"), F.concat_ws(" ", "title", "text").alias("text"))
    scored = ranking.bm25_corpus(docs, queries.select("query_id", F.col("query").alias("text")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    x = scored.withColumn("arrival", place).where(F.col("arrival") <= most)
    return x.select("query_id", "arrival", F.lit("U").alias("kind"), F.col("doc_id").alias("url"), F.lit(0.5).alias("prior"), F.lit(None).cast("int").alias("pinned"), F.lit("").alias("reason"))


def candidates(x: DataFrame, kind: str | None = None, first: int = 0) -> DataFrame:
    """Rows with all columns of a candidate; ``kind`` and the first arrival are set if given, else they are there."""
    if kind is not None:
        x = x.withColumn("kind", F.lit(kind))
        x = x.withColumn("arrival", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("prior"), "url")) + first)
    return x.select(*[F.col(c).cast(t) if t and c in x.columns else F.col(c) if c in x.columns else F.lit(None).cast(t).alias(c) for c, t in CANDIDATE.items()])


class Engine:
    """Searches a corpus of pages (page_id, url, html).

    ``extracted`` may hold pages that were extracted before (see ``operators.extract``); it is
    worth writing them to a table once, with ``stores.keyed`` and bucketed by url_key, as
    extraction costs more than all else. ``sitemaps`` (host, loc) are known catalogues.

    ``refine`` plans a second round: it takes reports (see ``expand.findings``, with query) and
    returns plans (query_id, raw). ``rerank`` takes windows to read (query_id, doc_id, i, window,
    query) and returns scores (query_id, doc_id, ce); ``similar`` takes passages (query_id,
    doc_id, pos, text, query) and returns (query_id, doc_id, emb). Each may hold pandas UDFs.
    """

    def __init__(self, pages: DataFrame | None = None, extracted: DataFrame | None = None, sitemaps: DataFrame | None = None, refine=None, rerank=None, similar=None) -> None:
        if (pages is None) == (extracted is None):
            raise ValueError("give pages or extracted pages")
        self.corpus = extracted if extracted is not None else extract.pages(pages)
        self.sitemaps, self.refine, self.rerank, self.similar = sitemaps, refine, rerank, similar

    def plan(self, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Settings and candidates of raw plans (query_id, raw)."""
        parsed = recall.lines(plans)
        return recall.settings(parsed), recall.candidates(parsed)

    def extract(self, addresses: DataFrame, query: str | None = None, token_budget_per_page: int = 0, passages_per_page: int = 1) -> DataFrame:
        """Pages of addresses (url), at most 20; an address without a page gives an error row.

        With ``query`` the passages that answer it take the place of the text; with a budget a
        page is cut to so many tokens.
        """
        x = addresses.select(F.lit(0).alias("query_id"), "url").limit(20)
        out = stores.pages_of(x, self.corpus).withColumnRenamed("url_key", "doc_id")
        if query is not None:
            terms = text.query_terms(F.lit(query))
            cut = passages.windows(out.select("query_id", "doc_id", "text", F.col("description").alias("seed"), terms.alias("terms")), 340 * passages_per_page, passages_per_page)
            out = out.drop("text").join(cut.select("doc_id", "passages", "passage_scores"), "doc_id", "left").withColumn("text", F.lit("").cast("string"))
        elif token_budget_per_page:
            out = out.withColumn("passages", F.array().cast("array<string>"))
        if token_budget_per_page:
            out = serp.fit_page(out.withColumn("title", F.coalesce("title", F.lit(""))), token_budget_per_page)
        return out.drop("query_id", "doc_id")

    def like(self, addresses: DataFrame) -> DataFrame:
        """A query for pages like each address: title without the site's name (or eight words of the description), then the four most telling new words of the description."""
        x = addresses.select(F.col("url").alias("asked")).join(self.corpus.select("url", "title", "description"), F.col("asked") == F.col("url"))
        title = F.trim(F.regexp_replace("title", r"\s+[|–—·-]\s+[^|–—·-]{1,40}$", ""))
        base = F.when(title != "", title).otherwise(text.keyword_query(F.col("description"), 8))
        known = F.transform(text.content_terms(F.col("base")), F.lower)
        x = x.withColumn("base", base)
        new = F.array_join(F.filter(text.content_terms(F.col("description")), lambda t: ~F.array_contains(known, F.lower(t))), " ")
        q = F.substring(F.trim(F.concat_ws(" ", "base", F.when(F.trim(new) != "", text.keyword_query(new, 4)))), 1, 400)
        return x.select("url", q.alias("query"), urls.registrable(urls.host_of(F.col("url"))).alias("exclude"))

    def search(self, queries: DataFrame, plans: DataFrame | None = None, allow: DataFrame | None = None, deny: DataFrame | None = None, shown: DataFrame | None = None, answers: DataFrame | None = None, **options) -> DataFrame:
        """Result lists: the columns ``RESULT``.

        ``queries`` has query_id and query; ``plans`` raw plans by query_id; ``allow`` and ``deny``
        domains; ``shown`` addresses (query_id, url) not to show again, which a later ``page``
        needs; ``answers`` what site searches replied (query_id, route, status, body).
        """
        o = Options(**options)
        q = analysed(queries)
        most, taken, _, _ = v.TIERS[o.depth]
        hubs = planned = None
        if plans is not None:
            settings, planned = self.plan(plans)
            planned = kept(planned)
            hubs = planned.where("kind = 'H'")
            cands = planned.where("kind <> 'H'")
            if taken:
                cands = expand.tail_specific(cands, taken)
            q = q.join(settings, "query_id", "left")
        else:
            cands = generated_plans(q, self.corpus, most)
            q = q.withColumns({"intent": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "expansions": F.lit(None).cast("array<string>")})
        q = kept(with_plan(q))
        cands = candidates(cands)
        if answers is not None:
            hits = site_routes.parsed(answers.join(q.select("query_id", "lang"), "query_id") if "lang" not in answers.columns else answers)
            cands = cands.unionByName(candidates(expand.admitted(hits, q), "R", 1_000))
        if hubs is not None:
            cands = cands.unionByName(candidates(self.linked(hubs, q), "E", 10_000))

        def gated(x: DataFrame, upto: int) -> DataFrame:
            x = dedup.distinct_candidates(x).drop("url_key")
            for listed, keep in ((allow, True), (deny, False)):
                if listed is not None:
                    x = dedup.allowed(x, listed, keep)
            if shown is not None:
                x = dedup.unseen(x, shown)
            n = F.row_number().over(Window.partitionBy("query_id").orderBy("arrival"))
            return kept(x.withColumn("__n", n).where(F.col("__n") <= upto).drop("__n"))

        cands = gated(cands, most)
        docs = kept(self.fetched(cands))
        if o.follow and plans is not None:
            more = self.further(docs, q)
            cands = gated(cands.unionByName(candidates(more, "D", 20_000)), most + v.DEEP_LINKS + v.SITEMAP_LINKS * v.SITEMAP_HOSTS)
            docs = kept(docs.unionByName(self.fetched(dedup.unseen(cands, docs))))
        if o.rounds == 2 and self.refine is not None:
            again = self.second(docs, q, shown)
            cands = gated(again, v.REFINE_FETCH)
            docs = kept(docs.unionByName(self.fetched(dedup.unseen(cands, docs))))
        out = self.ranked(q, docs, o, shown)
        if planned is not None:
            spare = expand.degraded(planned, out, o.top_k)
            out = out.unionByName(spare.drop("unverified"), allowMissingColumns=True)
        return out

    def linked(self, hubs: DataFrame, q: DataFrame, limit: int = v.HUB_LINKS) -> DataFrame:
        """Links to follow from each query's first index pages: query_id, url, prior."""
        n = F.row_number().over(Window.partitionBy("query_id").orderBy("arrival"))
        first = hubs.withColumn("__n", n).where(F.col("__n") <= v.HUBS).select("query_id", F.col("url").alias("src"))
        return expand.follow_hubs(self.links_of(first, q), limit).select("query_id", "url", "prior")

    def links_of(self, sources: DataFrame, q: DataFrame) -> DataFrame:
        """Links of pages (query_id, src) with their fit to the query."""
        pages = self.corpus.select(F.col("url").alias("src"), "links")
        links = sources.join(pages, "src").select("query_id", "src", F.explode("links").alias("l")).select("query_id", "src", "l.url", "l.anchor", "l.context")
        return expand.scored_links(links, q.select("query_id", "vocabularies", "years"))

    def fetched(self, cands: DataFrame) -> DataFrame:
        """Candidates with their page, and those without one; what a route already gave in full stands for the page."""
        told = [F.col(c).alias(f"given_{c}") if c in ("title", "content", "snippet") else F.col(c) for c in CANDIDATE]
        pages = self.corpus.drop("links", "images", "favicon", "search_url").withColumnRenamed("lang", "page_lang")
        x = stores.pages_of(cands.select(*told), pages)
        whole = F.coalesce("skip_fetch", F.lit(False)) & (F.coalesce("given_content", F.lit("")) != "")
        x = x.withColumns({
            "status": F.when(whole, 200).otherwise(F.col("status")),
            "title": F.coalesce("title", "given_title", F.lit("")),
            "text": F.coalesce(F.when(whole, F.col("given_content")), "text", "given_snippet", F.lit("")),
            "description": F.coalesce("description", "given_snippet", F.lit("")),
            "snippet": F.coalesce("given_snippet", F.lit("")),
            "named": F.col("url"),
            "url": F.coalesce("final_url", "url"),
        })
        return x.drop("given_title", "given_content", "given_snippet", "url_key")

    def further(self, docs: DataFrame, q: DataFrame) -> DataFrame:
        """What landed pages lead to: links into their own section, links that fit better than the page itself, and pages from the catalogues of hosts that failed: query_id, url, prior."""
        x = docs.join(q.select("query_id", "vocabularies", "intent", "words", "lang"), "query_id")
        path = F.lower(urls.decoded(urls.path_of(F.col("url"))))
        ident = F.greatest(expand.title_fit(F.col("vocabularies"), F.col("title")), text.best_fit(F.col("vocabularies"), urls.path_words(path)), text.best_fit(F.col("vocabularies"), urls.path_parts(path)))
        good = x.where("status = 200").select("query_id", F.col("url").alias("src"), ident.alias("ident")).distinct()
        links = kept(self.links_of(good.select("query_id", "src"), q))
        out = expand.follow_section(links, good).select("query_id", "url", "prior").unionByName(expand.follow_deep(links, good).select("query_id", "url", "prior"))
        if self.sitemaps is not None:
            failed = x.withColumn("why", expand.unusable(F.col("status"), F.col("text"), F.col("url"), F.col("intent"))).where("why IS NOT NULL").select("query_id", "arrival", "url", "why")
            out = out.unionByName(expand.recovered(failed, self.sitemaps, q).select("query_id", "url", "prior"))
        return out.groupBy("query_id", "url").agg(F.max("prior").alias("prior"))

    def second(self, docs: DataFrame, q: DataFrame, shown: DataFrame | None) -> DataFrame:
        """Candidates of a second round, planned over the report of the first."""
        x = docs.join(q.select("query_id", "vocabularies"), "query_id")
        x = x.withColumn("relevance", expand.title_fit(F.col("vocabularies"), F.col("title")))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "url"))
        rows = x.select("query_id", F.when(F.col("status") == 200, place).alias("place"), "url", "title", "relevance", F.substring(F.concat_ws(" ", "description", "text"), 1, 220).alias("snippet"), "status")
        if shown is not None:
            seen = shown.select("query_id", F.lit(0).alias("place"), "url", F.lit("").alias("title"), F.lit(0.0).alias("relevance"), F.lit("").alias("snippet"), F.lit(0).alias("status"))
            rows = rows.unionByName(seen)
        reports = expand.findings(rows).join(q.select("query_id", "query"), "query_id")
        _, planned = self.plan(self.refine(reports))
        planned = kept(planned)
        pages = candidates(planned.where("kind <> 'H'"))
        return pages.unionByName(candidates(self.linked(planned.where("kind = 'H'"), q), "E", 10_000))

    def ranked(self, q: DataFrame, docs: DataFrame, o: Options, shown: DataFrame | None = None) -> DataFrame:
        docs = dedup.by_opening(dedup.by_address(expand.presentable(docs))).withColumn("doc_id", F.col("url_key"))
        x = docs.join(q.drop("guessed_intent", "guessed_lang"), "query_id").withColumnRenamed("url", "address").withColumn("url", F.col("address"))
        x = kept(x)
        anchors = urls.anchor_terms(F.col("named"))
        pool = passages.passages(x.select("query_id", "doc_id", "title", "description", "text", "terms", anchors.alias("anchors")))
        lex = ranking.best_passage(ranking.bm25(pool, q.select("query_id", F.col("asked").alias("text"), "lang"))).select("query_id", "doc_id", F.col("score").alias("bm25"))
        ident = F.array_distinct(F.concat(text.tokens(F.concat_ws(" ", "title", "description")), urls.path_parts(F.lower(urls.path_of(F.col("address")))), text.tokens(F.substring("text", 1, v.ASPECT_HEAD))))
        vocabs = q.select("query_id", F.posexplode("vocabularies").alias("vocab_id", "terms"))
        aspect = ranking.aspect_coverage(x.select("query_id", "doc_id", ident.alias("ident")), vocabs)
        blob = F.lower(F.concat_ws(" ", "title", "text"))
        rare = ranking.rare_coverage(x.select("query_id", "doc_id", blob.alias("blob")), q.select("query_id", F.transform(text.content_terms(F.col("query"), F.col("lang")), lambda t: F.lower(F.regexp_replace(t, '^"+|"+$', ""))).alias("terms")))
        if self.similar is not None:
            emb = self.similar(pool.join(q.select("query_id", "query"), "query_id")).groupBy("query_id", "doc_id").agg(F.greatest(F.max("emb"), F.lit(0.0)).alias("emb_raw"))
            x = x.join(emb, ["query_id", "doc_id"], "left")
        else:
            x = x.withColumn("emb_raw", F.lit(0.0))
        x = x.withColumns({"__p": F.lower(F.concat_ws(" ", urls.decoded(urls.path_of(F.col("address"))), urls.fragment_of(F.col("address")))), "__h": urls.host_of(F.col("address"))})
        path, host = F.col("__p"), F.col("__h")
        today = F.lit(o.today).cast("date") if o.today else F.current_date()
        navigational = F.col("intent") == "navigational"
        x = x.withColumns({"__day": text.parse_date(F.col("published")), "site": urls.registrable(host)})
        dated = F.col("__day")
        x = x.join(lex, ["query_id", "doc_id"], "left").join(aspect, ["query_id", "doc_id"], "left").join(rare, ["query_id", "doc_id"], "left")
        whole = F.coalesce("skip_fetch", F.lit(False))
        x = x.fillna({"bm25": 0.0, "aspect": 0.0, "rare": 0.0, "emb_raw": 0.0}).withColumns({
            "lex": ranking.minmax("bm25"),
            "emb": ranking.minmax("emb_raw"),
            "ce": F.lit(None).cast("double"),
            "covered": ranking.term_coverage(F.col("terms"), blob),
            "__title": expand.title_fit(F.col("vocabularies"), F.col("title")),
            "__path": F.greatest(text.best_fit(F.col("vocabularies"), urls.path_words(path)), text.best_fit(F.col("vocabularies"), urls.path_parts(path))),
            "host": text.host_fit(F.col("site"), F.array_distinct(F.flatten("vocabularies"))),
            "authority": urls.authority(host),
            "consensus": (F.least(F.col("consensus"), F.lit(3)) - 1) / 2.0,
            "prior": F.coalesce("prior", F.lit(0.5)) * recall.route_fit(F.coalesce("source", F.lit("")), F.col("intent")),
            "fresh": text.freshness(dated, today),
            "date": text.date_fit(dated, urls.path_of(F.col("address")), F.col("title"), F.col("years")),
            "thin": F.when((F.length("text") < 200) & ~whole, 1.0).otherwise(0.0),
            "dead": F.when(F.col("status") != 200, 1.0).otherwise(0.0),
            "root": F.when(~navigational & (F.regexp_replace(path, "^[/ ]+|[/ ]+$", "") == "") & (urls.query_of(F.col("address")) == ""), 1.0).otherwise(0.0),
            "spam": urls.spam(F.col("address"), F.col("title"), F.col("words")).cast("double"),
        })
        x = x.withColumn("orphan", F.when(~navigational & (F.greatest("__title", "__path", "host") < v.ORPHAN_FIT), 1.0).otherwise(0.0))
        w = ranking.weights(F.col("intent"), F.col("lang"), F.col("recent") | (F.size("years") > 0), o.weights)
        named = x.withColumns({"heading": F.col("title"), "title": F.col("__title"), "url": F.col("__path")})
        s = ranking.fused(named, w)
        if self.rerank is not None:
            s = kept(s)
            read = s.select("query_id", "doc_id", F.col("heading").alias("title"), "text", "description", "terms", "prelim", "url").withColumn("ce", F.lit(1.0))
            head = ranking.reranked(read, read.select("query_id", "doc_id", "ce")).where("ce IS NOT NULL")
            scores = self.rerank(passages.reader_windows(head).join(q.select("query_id", "query"), "query_id"))
            s = ranking.fused(ranking.reranked(s.drop("score", "relevance"), scores).drop("prelim"), w)
        s = s.drop("title", "url").withColumnRenamed("heading", "title").withColumn("url", F.col("address"))
        after = F.lit(o.after).cast("date") if o.after else text.freshness_floor(F.lit(o.freshness), today) if o.freshness else None
        if after is not None or o.before:
            day = text.parse_date(F.col("published"))
            inside = (day >= (after if after is not None else F.lit("0001-01-01").cast("date"))) & (day <= F.lit(o.before or "9999-12-31").cast("date"))
            s = s.where(F.coalesce(inside, F.lit(not o.require_date)))
        if shown is not None:
            s = dedup.unseen(s, shown)  # a redirect may have led to what was shown
        s = kept(s.withColumn("cap", F.when(navigational, 4).otherwise(0)))
        rows = serp.assembled(s, o.top_k, o.max_per_host, o.min_relevance)
        full = rows.join(s.select("query_id", "url", "doc_id", "title", "published", "site", "text", "description", F.col("snippet").alias("given"), "terms", F.coalesce("source", F.col("kind")).alias("source")), ["query_id", "url"])
        seed = F.coalesce(F.nullif("description", F.lit("")), "given")
        cut = passages.windows(full.select("query_id", "doc_id", "text", seed.alias("seed"), "terms"), o.snippet_chars, o.snippet_windows)
        out = full.drop("terms", "description", "given").join(cut, ["query_id", "doc_id"]).drop("doc_id").withColumns({"title": F.substring("title", 1, 200), "published": F.substring("published", 1, 10), "relevance": F.round("relevance", 4)})
        if o.passages_per_page:
            out = serp.passage_cap(out, o.passages_per_page)
        if o.token_budget_per_page:
            out = serp.fit_page(out, o.token_budget_per_page)
        if o.token_budget:
            out = serp.budget_fit(out, o.token_budget)
        return out.select(*RESULT)
