"""From scored pages to a result list."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions import values as v


def top(scored: DataFrame, k: int = 10, key: str = "query_id") -> DataFrame:
    """The k best of each query: pinned rows first in their order, then by score, then by url. Adds ``place``."""
    order = [F.coalesce("pinned", F.lit(1 << 20)), F.desc("score"), "url"] if "pinned" in scored.columns else [F.desc("score"), "url"]
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= k)


def host_capped(scored: DataFrame, k: int = 10, cap: int = 2, key: str = "query_id") -> DataFrame:
    """At most ``cap`` rows of a site, refilled by a second pass of up to three more; no relevance floor.

    Without the floor the greedy choice is two ranks: a row's rank in its site decides the
    pass, its score the order in the pass. Adds ``place``.
    """
    in_site = F.row_number().over(Window.partitionBy(key, "site").orderBy(F.desc("score"), "url"))
    x = scored.withColumn("__s", in_site).where(F.col("__s") <= cap + 3).withColumn("__pass", (F.col("__s") > cap).cast("int"))
    x = x.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__pass", F.desc("score"), "url"))).where(F.col("__n") <= k)
    return x.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "url"))).drop("__s", "__pass", "__n")


def assembled(scored: DataFrame, k: int = 10, cap: int = 2, floor: float = v.MIN_RELEVANCE, least: int = v.MIN_RESULTS, key: str = "query_id") -> DataFrame:
    """The list as a reader takes it from the top: site cap with a relaxed second pass, a relevance floor after ``least`` rows, pinned places.

    Needs ``key``, url, site, score, relevance; status, pinned and cap (the least site cap of
    the whole query) may be there. Returns ``key``, place, url, score, relevance.

    Taking a row depends on the rows taken before only through counts, and these are running
    counts: while fewer than ``least`` are taken, a row is taken if it is among its site's
    first; from there on, if it is relevant and its site's taken and relevant rows before it
    are few enough. So both passes are windows over the query and over its sites; no row is
    cut off before that could be taken: of each site the first rows that pass the floor, and
    the first that don't, are all that can matter. Pinned rows of one rank follow one another.
    """
    x = scored
    for name, kind, value in (("status", "int", 200), ("pinned", "int", None), ("cap", "int", 0)):
        if name not in x.columns:
            x = x.withColumn(name, F.lit(value).cast(kind))
    x = x.select(key, "url", "site", "score", "relevance", "pinned", F.coalesce("cap", F.lit(0)).alias("own"), F.coalesce(F.col("status").isin(404, 410), F.lit(False)).alias("gone"))
    whole, site = Window.partitionBy(key), Window.partitionBy(key, "site")
    order = [F.col("pinned").isNull(), "pinned", F.desc("score"), "url"]
    down, in_site = whole.orderBy(*order), site.orderBy(*order)
    fixed = F.col("pinned").isNotNull()
    count = lambda c, w: F.sum(F.coalesce(c, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow) if w in (down, in_site) else w)

    x = x.withColumns({"some": F.max(~F.col("gone")).over(whole), "cap": F.greatest(F.max("own").over(whole), F.lit(cap)), "able": F.coalesce(F.col("relevance") >= floor, F.lit(False))})
    x = x.where(~F.col("some") | ~F.col("gone") | fixed)
    nth = F.row_number().over(Window.partitionBy(key, "site", "able").orderBy(*order))
    x = x.withColumn("nth", nth).where(fixed | (F.col("nth") <= F.col("cap") + 3 + least))

    def taken(x: DataFrame, of: Column, had: Column, room: Column, free: Column) -> DataFrame:
        """Adds ``now``: the rows among ``of`` taken in a pass, with ``had`` of a site taken before, ``room`` for a site and ``free`` rows that need no relevance."""
        x = x.withColumns({"of": of, "ok": of & (fixed | (had + count(of, in_site) <= room))})
        x = x.withColumn("sofar", count(F.col("ok"), down))
        early = F.col("ok") & (fixed | (F.col("sofar") <= free))
        late = F.col("of") & ~fixed & (F.col("sofar") - F.col("ok").cast("int") >= free) & F.col("able")
        x = x.withColumns({"early": early, "may": early | late})
        return x.withColumn("now", F.col("early") | (F.col("may") & (had + count(F.col("may"), in_site) <= room)))

    x = taken(x, F.lit(True), F.lit(0), F.col("cap"), F.lit(least))
    x = x.withColumn("first", F.col("now") & (count(F.col("now"), down) <= k))
    x = x.withColumns({"n": count(F.col("first"), whole), "had": count(F.col("first"), site)})
    x = taken(x, ~F.col("first"), F.col("had"), F.col("cap") + 3, F.greatest(F.lit(least) - F.col("n"), F.lit(0)))
    x = x.withColumn("second", F.col("now") & ~F.col("first") & (F.col("n") + count(F.col("now") & ~F.col("first"), down) <= k))
    x = x.where("first OR second").withColumns({"full": F.col("score"), "score": F.round("score", 4)})

    loose = F.row_number().over(Window.partitionBy(key, fixed).orderBy(F.desc("score"), F.desc("first"), F.desc("full"), "url"))
    rank = F.row_number().over(Window.partitionBy(key, fixed).orderBy("pinned", F.desc("full"), "url"))
    x = x.withColumns({"f": loose, "j": rank, "loose": count(~fixed, whole)})
    running = Window.partitionBy(key, fixed).orderBy("j")
    x = x.withColumn("at", F.when(fixed, F.least(F.col("j") + F.max(F.col("pinned") - F.col("j")).over(running), F.col("loose") + F.col("j"))).cast("int"))
    x = x.withColumn("held", F.array_sort(F.collect_list("at").over(whole)))
    place = F.coalesce("at", F.aggregate("held", F.col("f"), lambda a, p: F.when(p <= a, a + 1).otherwise(a)))
    return x.select(key, place.cast("int").alias("place"), "url", "score", "relevance")


def page_cost(df: DataFrame) -> DataFrame:
    """Adds ``cost``: tokens of title, url, passages and text."""
    of_passages = F.aggregate(F.transform("passages", text.count_tokens), F.lit(0).cast("long"), lambda a, b: a + b)
    return df.withColumn("cost", text.count_tokens(F.col("title")) + text.count_tokens(F.col("url")) + F.coalesce(of_passages, F.lit(0)) + text.count_tokens(F.col("text")))


def budget_prefix(costed: DataFrame, budget: int, key: str = "query_id") -> DataFrame:
    """Rows in order of ``place`` while their running cost fits; the first row always stays, marked ``shrink`` if it alone is too large."""
    run = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = costed.withColumn("spent", F.sum("cost").over(run))
    first = F.row_number().over(Window.partitionBy(key).orderBy("place")) == 1
    return x.withColumn("shrink", first & (F.col("spent") > budget)).where((F.col("spent") <= budget) | F.col("shrink"))


def budget_fit(rows: DataFrame, budget: int, key: str = "query_id") -> DataFrame:
    """Rows whose cost fits a budget together; a first row that alone is too large is cut down to it."""
    x = budget_prefix(page_cost(rows), budget, key)
    return x.where(~F.col("shrink")).unionByName(fit_page(x.where("shrink"), budget)).drop("cost", "spent", "shrink")


def passage_cap(df: DataFrame, n: int) -> DataFrame:
    """At most ``n`` passages of a page, with their scores."""
    return df.withColumns({"passages": F.slice("passages", 1, n), "passage_scores": F.slice("passage_scores", 1, n)})


def fit_page(rows: DataFrame, max_tokens: int) -> DataFrame:
    """Passages and text cut to a page's budget: title and url first, then passages in order, then text."""
    left0 = F.lit(max_tokens).cast("long") - text.count_tokens(F.col("title")) - text.count_tokens(F.col("url"))
    start = F.struct(left0.alias("left"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("done"))

    def add(a, p):
        n = text.count_tokens(p)
        fits = ~a["done"] & (a["left"] > 0) & (n <= a["left"])
        first = ~a["done"] & (a["left"] > 0) & (n > a["left"]) & (F.size(a["kept"]) == 0)
        cut = text.truncate(p, a["left"])
        return F.struct(
            F.when(fits, a["left"] - n).when(first, F.lit(0).cast("long")).otherwise(a["left"]).alias("left"),
            F.when(fits, F.array_append(a["kept"], p)).when(first, F.array_append(a["kept"], cut)).otherwise(a["kept"]).alias("kept"),
            (a["done"] | first).alias("done"),
        )

    x = rows.withColumn("__f", F.when(left0 > 0, F.aggregate("passages", start, add)).otherwise(start))
    used = F.aggregate(F.transform("__f.kept", text.count_tokens), F.lit(0).cast("long"), lambda a, b: a + b)
    return x.withColumns({"passages": F.col("__f.kept"), "text": text.truncate(F.col("text"), F.greatest(left0 - used, F.lit(0)))}).drop("__f")


def judged(results: DataFrame, pages: DataFrame, read: int = 8, keep: int = 3, key: str = "query_id") -> DataFrame:
    """Results reordered by a reader's judgement: listed pages in its order, pages it did not read, then rejected pinned ones.

    ``results`` has place (from 1); ``pages`` has ``key`` and ``pages``, an array of places. A
    query without a judgement keeps its order; at least ``keep`` rows stay if there are as many.
    """
    x = results.join(pages, key, "left")
    at = F.array_position("pages", F.col("place"))
    none = F.coalesce(F.size("pages"), F.lit(0)) <= 0
    pinned = F.col("pinned").isNotNull() if "pinned" in results.columns else F.lit(False)
    group = F.when(none, 0).when(at > 0, 0).when(F.col("place") > read, 1).when(pinned, 2).otherwise(3)
    x = x.withColumns({"__g": group, "__o": F.when(none | (at == 0) | at.isNull(), F.col("place")).otherwise(at)})
    x = x.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("__g", "__o")))
    return x.where((F.col("__g") < 3) | (F.col("place") <= keep)).drop("__g", "__o", "pages")


def parse_judgement(answers: DataFrame, n: int = 8) -> DataFrame:
    """Splits a line ``PAGES: 2, 1`` off an answer: ``pages`` (places within 1..n, once each) and ``body``."""
    line = r"(?im)^\s*PAGES?\s*:\s*([0-9][0-9 ,]*)\s*$"
    found = F.regexp_extract("answer", line, 1)
    nums = F.filter(F.transform(F.split(F.trim(found), "[ ,]+"), lambda t: F.try_to_number(t, F.lit("999999999")).cast("int")), lambda i: i.isNotNull() & (i >= 1) & (i <= n))
    return answers.withColumns({"pages": F.array_distinct(nums), "body": F.regexp_replace(F.regexp_replace("answer", line, ""), r"^\s+|\s+$", "")})


