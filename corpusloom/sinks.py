"""Replies as JSON, as event-stream frames and as text, and what goes back into stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import expand
from .plans import recall
from .sources import stores

SHOWN = ("place", "url", "title", "site", "score", "relevance", "passages", "published", "source")


def replies(queries: DataFrame, results: DataFrame, plans: DataFrame | None = None, with_text: bool = False) -> DataFrame:
    """One JSON object a query: query_id, reply. Queries without results have an empty list; ``plans`` (query_id, plan) is shown if given."""
    cols = [c for c in (*SHOWN, *(("text",) if with_text else ())) if c in results.columns]
    listed = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("results"))
    x = queries.join(listed, "query_id", "left")
    if plans is not None:
        x = x.join(plans.select("query_id", "plan"), "query_id", "left")
    empty = F.array().cast(listed.schema["results"].dataType)
    body = [F.col("query_id"), F.col("query"), *[F.col(c) for c in ("intent", "lang", "plan") if c in x.columns], F.coalesce("results", empty).alias("results")]
    return x.select("query_id", F.to_json(F.struct(*body)).alias("reply"))


def frames(events: DataFrame) -> DataFrame:
    """Event-stream frames: query_id, seq, frame. Needs event, data (JSON text) and created (seconds)."""
    payload = F.to_json(F.struct(F.col("query_id").cast("string").alias("id"), F.lit("search.chunk").alias("object"), F.col("created").cast("long").alias("created"), "event", F.lit("\u0001").alias("data")))
    return events.select("query_id", "seq", F.concat(F.lit("data: "), F.replace(payload, F.lit('"\\u0001"'), F.coalesce("data", F.lit("null"))), F.lit("\n\n")).alias("frame"))


def cut_note(url: Column, shown: Column, whole: Column) -> Column:
    """What to ask for where a page did not fit: how much is shown, and a budget that holds it all, at three characters a token up to the next thousand; empty if nothing was cut."""
    budget = F.ceil(F.ceil(whole / 3) / 1000) * 1000
    said = F.concat(F.lit("[cut: "), F.format_number(shown, 0), F.lit(" of "), F.format_number(whole, 0), F.lit(" chars shown; extract "), url, F.lit(" with token_budget_per_page="), budget.cast("string"), F.lit(" for all of it]"))
    return F.when((F.coalesce(whole, F.lit(0)) == 0) | (shown >= whole), "").otherwise(said)


def rendered(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Result lists as text for a terminal or a tool: query_id, text. Shows text and a note where ``text`` and ``text_chars`` are there."""
    head = F.concat(F.col("place").cast("string"), F.lit(". "), F.coalesce(F.nullif("title", F.lit("")), F.col("url")))
    about = F.concat_ws("  ", F.concat(F.lit("   "), "url"), F.concat(F.lit("relevance="), F.format_string("%.2f", F.coalesce("relevance", F.lit(0.0)))), F.nullif("published", F.lit("")))
    quoted = F.array_join(F.transform(F.coalesce("passages", F.array().cast("array<string>")), lambda p: F.concat(F.lit("   > "), p)), "\n")
    parts = [head, about, F.nullif(quoted, F.lit(""))]
    if "text" in results.columns and "text_chars" in results.columns:
        parts += [F.nullif("text", F.lit("")), F.nullif(cut_note(F.col("url"), F.length("text"), F.col("text_chars")), F.lit(""))]
    x = results.select("query_id", "place", F.concat_ws("\n", *parts).alias("b")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "b"))).alias("bs"))
    x = queries.join(x, "query_id", "left")
    n = F.coalesce(F.size("bs"), F.lit(0))
    return x.select("query_id", F.concat_ws("\n\n", F.concat("query", F.lit(" ("), n.cast("string"), F.lit(" pages)")), F.array_join(F.transform("bs", lambda b: b["b"]), "\n\n")).alias("text"))


def catalogue_store(store: DataFrame, read: DataFrame) -> DataFrame:
    """A store of catalogues after an upsert (host, locs, updated); a host without one is kept as an empty list, a known miss."""
    return stores.upserted(store, read.withColumn("locs", F.coalesce("locs", F.array().cast("array<string>"))), "host", "updated")


def offers(parsed: DataFrame) -> DataFrame:
    """Plans that are worth sharing, as text: query_id, plan."""
    return recall.rendered(parsed).join(recall.storable(parsed).where("storable").select("query_id"), "query_id", "left_semi")


def outcomes(planned: DataFrame, fetched: DataFrame, results: DataFrame) -> DataFrame:
    """What became of each planned address, for the shared cache: query_id, url, ok, serp."""
    return expand.report(planned, fetched, results)


def complete_plans(stream: DataFrame, path: str, checkpoint: str):
    """Starts a sink that stores every complete plan of a stream (query_id, raw), whether or not its search is still there; returns the running query."""

    def store(batch: DataFrame, n: int) -> None:
        good = recall.storable(recall.lines(batch)).where("storable").select("query_id")
        batch.join(good, "query_id", "left_semi").write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).start()
