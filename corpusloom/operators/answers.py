"""What an answering model is given, and what is made of its reply; the call itself is the caller's."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as v
from . import serp

GIVEN = (
    "You get web pages that were found and ranked for a question. Each has a number, its address, its site, a score from 0 to 1 and a note of how it "
    "was found (plan, route or link). Below is its opening and the passages chosen for the question, not the whole page. Use nothing but these pages; "
    "where they disagree, go by the primary source."
)
JUDGE = "Begin with a line 'PAGES: ' and the numbers of the pages that are about the question, the most useful first; leave all others out. Then an empty line."
TASKS = {
    "extract": f"{GIVEN} {JUDGE} Then give the answer alone, in the pages' own units and spelling. If the pages do not hold it, reply NOT FOUND.",
    "synthesize": f"{GIVEN} {JUDGE} Then answer in a few plain sentences, each claim followed by the numbers of the pages that say it, as in [2]. Say what the pages leave open and where they differ.",
    "structured": f"{GIVEN} Reply with the JSON object that the schema describes and nothing else. A field that the pages do not support is null. For each other field add to _grounding its name, the numbers of the pages that support it, and high, medium or low confidence.",
}


def page_body(text: Column, passages: Column, snippet: Column, chars: Column) -> Column:
    """A page's opening, then its passages that are not in what is there already."""
    lead = F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, v.LEAD_CHARS)
    start = F.filter(F.array(lead), lambda x: x != "")
    said = F.when(F.coalesce(F.size(passages), F.lit(0)) > 0, passages).when(F.coalesce(snippet, F.lit("")) != "", F.array(snippet)).otherwise(F.array().cast("array<string>"))

    def add(parts: Column, p: Column) -> Column:
        known = F.exists(parts, lambda x: F.contains(x, F.substring(p, 1, 120)))
        return F.when((p == "") | known, parts).otherwise(F.array_append(parts, p))

    body = F.array_join(F.aggregate(F.transform(said, lambda p: F.trim(p)), start, add), "\n[...]\n")
    return F.substring(body, F.lit(1), chars.cast("int"))


def page_blocks(results: DataFrame, numbered: bool = True, pages: int = v.ANSWER_PAGES) -> DataFrame:
    """The pages of each query as one text: query_id, pages. Needs place, url, title, site, score, source, text, passages, snippet."""
    chars = F.when(F.col("place") <= v.TOP_PAGES, v.TOP_PAGE_CHARS).otherwise(v.PAGE_CHARS)
    or_dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    head = F.concat(F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] ")) if numbered else F.lit(""), F.coalesce(F.nullif("title", F.lit("")), F.col("url")))
    about = F.concat(F.lit("site: "), or_dash("site"), F.lit("  score: "), F.format_string("%.2f", "score"), F.lit("  found_by: "), or_dash("source"))
    block = F.concat_ws("\n", head, F.concat(F.lit("url: "), "url"), about, F.trim(page_body(F.col("text"), F.col("passages"), F.col("snippet"), chars)))
    x = results.where(F.col("place") <= pages).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))).alias("bs"))
    return x.select("query_id", F.array_join(F.transform("bs", lambda b: b["b"]), "\n\n").alias("pages"))


def messages(queries: DataFrame, results: DataFrame, mode: str = "extract", pages: int = v.ANSWER_PAGES) -> DataFrame:
    """Messages for an answering model: query_id, messages of (role, content). A query without results has none."""
    if mode not in TASKS:
        raise ValueError(f"unknown answer mode: {mode}")
    x = queries.select("query_id", "query").join(page_blocks(results, mode != "extract", pages), "query_id")
    ask = F.concat(F.lit("Question: "), "query", F.lit("\n\nPages:\n\n"), "pages", F.lit("\n\nJSON:" if mode == "structured" else "\n\nAnswer:"))
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return x.select("query_id", F.array(said("system", F.lit(TASKS[mode])), said("user", ask)).alias("messages"))


def with_grounding(schema: dict) -> str:
    """A caller's object schema as a response format, with ``_grounding``: an entry for each field that was filled in."""
    if not isinstance(schema, dict) or not schema.get("properties"):
        raise ValueError("the schema must be of an object with properties")
    entry = {"field": {"type": "string"}, "pages": {"type": "array", "items": {"type": "integer"}}, "confidence": {"type": "string", "enum": ["high", "medium", "low"]}}
    grounding = {"type": "array", "items": {"type": "object", "properties": entry, "required": list(entry), "additionalProperties": False}}
    body = schema | {"type": "object", "properties": dict(schema["properties"]) | {"_grounding": grounding}}
    return json.dumps({"type": "json_schema", "json_schema": {"name": "answer", "schema": body}})


def read(replies: DataFrame, n: int = v.ANSWER_PAGES) -> DataFrame:
    """Replies as answers: query_id, answer, pages, error. Needs reply and error; a failed call costs the answer and nothing else."""
    x = serp.parse_judgement(replies.withColumn("answer", F.coalesce("reply", F.lit(""))), n)
    body = F.when(F.col("error").isNotNull() | F.startswith(F.upper("body"), F.lit("NOT FOUND")), "").otherwise(F.col("body"))
    return x.select("query_id", body.alias("answer"), F.when(F.col("error").isNull(), F.col("pages")).otherwise(F.array().cast("array<int>")).alias("pages"), "error")


def read_object(replies: DataFrame) -> DataFrame:
    """Replies that should be one JSON object: query_id, object (as text, null if it is none), error. Fences around it are taken off."""
    bare = F.regexp_replace(F.trim(F.coalesce("reply", F.lit(""))), r"(?s)^```(?:json)?\s*|\s*```$", "")
    ok = F.startswith(bare, F.lit("{")) & F.try_parse_json(bare).isNotNull()
    error = F.coalesce("error", F.when(~ok, "the reply is no JSON object"))
    return replies.select("query_id", F.when(F.col("error").isNull() & ok, bare).alias("object"), error.alias("error"))
