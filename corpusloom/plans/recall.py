"""Recall plans: the line protocol, the JSON form, and plans as text again.

A line is a tag and its content: I intent, L language, R routes, X expansions, H hub,
P pinned address, U address with confidence. Everything is a DataFrame of lines; what a
later line may change depends only on the line number, so no loop over lines is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions import values as v
from ..functions.text import let

ROUTE_NAMES = list(v.ROUTES)
PLAN_JSON = "candidates array<string>, routes string, hubs array<string>, expansions array<string>, intent string, lang string"
GRAMMAR = (
    "Write one item a line, the surest first:\n"
    "I intent (" + ", ".join(v.INTENTS) + ")\nL language code\nU confidence address :: why\nR route: query | route: query (routes: " + ", ".join(n for n in v.ROUTES if n not in v.ROUTES_OFF) + ")\n"
    "X another wording | another wording\nH address of an index page\nName only addresses that you are sure exist."
)


def lines(plans: DataFrame, key: str = "query_id") -> DataFrame:
    """One row a line that counts: ``key``, line (from 0), tag, rest. Needs ``raw``."""
    x = plans.select(key, F.posexplode(F.split(F.coalesce("raw", F.lit("")), "\n")).alias("line", "s"))
    s = F.trim(F.regexp_replace("s", r"^\s+|\s+$", ""))
    x = x.withColumn("s", s).where((F.length("s") > 0) & (F.length("s") <= v.MAX_LINE) & ~F.rlike("s", F.lit(r"^\s*(```|~~~)")))
    bare = F.trim(F.regexp_replace("s", r"^(?:[-*+]\s+|\d+[.)]\s+|>\s+|#+\s+)+", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[*_`]{1,2}\s*([A-Za-z])\s*[*_`]{1,2}\s", "$1 "), r"^[*`]+|[*`]+$", "")
    x = x.withColumn("s", bare).where(F.length("s") > 0)
    return x.select(key, "line", F.regexp_replace(F.upper(F.regexp_extract("s", r"^([^ ]*)", 1)), ":+$", "").alias("tag"), F.trim(F.regexp_extract("s", r"^[^ ]* ?(.*)$", 1)).alias("rest"))


def settings(parsed: DataFrame, key: str = "query_id") -> DataFrame:
    """Intent (the last valid one), language, expansions in order: one row a plan that has lines."""
    first = F.lower(F.regexp_extract("rest", r"^(\S+)", 1))
    intent = F.when((F.col("tag") == "I") & first.isin(*v.INTENTS), first)
    lang = F.when((F.col("tag") == "L") & F.rlike(first, F.lit("^[a-z]{2,3}([-_][a-z]{2,4})?$")), F.regexp_extract(first, "^([a-z]+)", 1))
    parts = F.filter(F.transform(F.split("rest", r"\|"), lambda t: F.trim(t)), lambda p: (F.length(p) > 1) & (F.length(p) < 160))
    said = F.when(F.col("tag") == "X", F.struct("line", parts.alias("p")))
    got = parsed.groupBy(key).agg(F.max_by(intent, F.when(intent.isNotNull(), F.col("line"))).alias("intent"), F.max_by(lang, F.when(lang.isNotNull(), F.col("line"))).alias("lang"), F.array_sort(F.collect_list(said)).alias("x"))
    return got.select(key, F.coalesce("intent", F.lit("informational")).alias("intent"), F.coalesce("lang", F.lit("en")).alias("lang"), F.flatten(F.transform("x", lambda s: s["p"])).alias("expansions"))


def routes(parsed: DataFrame, key: str = "query_id") -> DataFrame:
    """Routes of a plan in the order of their first mention, at most eight, with the last query given: ``key``, place, name, query."""
    part = parsed.where("tag = 'R'").select(key, "line", F.posexplode(F.split("rest", r"\|")).alias("i", "s")).withColumn("s", F.trim("s")).where("s <> ''")
    name = F.lower(F.trim(F.regexp_extract("s", r"^([^:]*)", 1)))
    query = F.nullif(F.substring(F.trim(F.regexp_extract("s", r"^[^:]*:(.*)$", 1)), 1, 240), F.lit(""))
    single = part.where(name.isin(*ROUTE_NAMES)).select(key, "line", "i", F.lit(0).alias("j"), name.alias("name"), query.alias("query"))
    several = part.where(~name.isin(*ROUTE_NAMES)).select(key, "line", "i", F.posexplode(F.split(F.lower("s"), r"[,\s]+")).alias("j", "name")).where(F.col("name").isin(*ROUTE_NAMES)).withColumn("query", F.lit(None).cast("string"))
    at = F.struct("line", "i", "j")
    got = single.unionByName(several).groupBy(key, "name").agg(F.min(at).alias("first"), F.max_by("query", F.when(F.col("query").isNotNull(), at)).alias("query"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first"))
    return got.withColumn("place", place).where("place <= 8").select(key, "place", "name", "query")


def candidates(parsed: DataFrame, key: str = "query_id") -> DataFrame:
    """Addresses of a plan in order: ``key``, arrival, kind (H, P or U), url, prior, pinned, reason.

    The first line that names an address has it, whatever its tag.
    """
    rest, tag = F.col("rest"), F.col("tag")
    sure = r"^([01](?:\.\d+)?|\.\d+)\s+(\S+)(?:\s*::\s*(.*))?$"
    scored = F.rlike(rest, F.lit(sure))
    loose = F.regexp_extract(rest, r"^([^ ]*)", 1)
    address = (
        F.when(tag == "H", F.regexp_extract(F.regexp_extract(rest, r"^(.*?)(?: :: .*)?$", 1), r"^([^ ]*)", 1))
        .when(tag == "P", F.regexp_extract(rest, r"^\d{1,2}\s+(\S+)$", 1))
        .when((tag == "U") & scored, F.regexp_extract(rest, sure, 2))
        .when(tag == "U", loose)
    )
    reason = F.when((tag == "U") & scored, F.regexp_extract(rest, sure, 3)).when(tag == "U", F.regexp_extract(rest, r"^.*? :: (.*)$", 1)).otherwise("")
    x = parsed.where(tag.isin("H", "P", "U")).select(
        key,
        F.col("line").alias("arrival"),
        tag.alias("kind"),
        let(address, urls.clean_url).alias("url"),
        F.when(tag == "P", 1.0).when((tag == "U") & scored, F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.try_to_number(F.concat(F.lit("0"), F.regexp_extract(rest, sure, 1)), F.lit("99.999999")).cast("double")))).when(tag == "U", 0.55).alias("prior"),
        F.when(tag == "P", F.greatest(F.lit(1), F.least(F.lit(10), F.regexp_extract(rest, r"^(\d{1,2})\s", 1).try_cast("int")))).alias("pinned"),
        F.substring(F.trim(reason), 1, 200).alias("reason"),
    ).where(urls.valid_url(F.col("url")))
    first = F.row_number().over(Window.partitionBy(key, "url").orderBy("arrival"))
    return x.withColumn("__n", first).where("__n = 1").drop("__n")


def from_json(plans: DataFrame, key: str = "query_id") -> DataFrame:
    """Addresses of plans given as JSON in ``raw``: the same checks, at most 40; entries are strings or objects."""
    x = plans.select(key, F.from_json("raw", PLAN_JSON).alias("p")).select(key, F.posexplode(F.slice("p.candidates", 1, 40)).alias("arrival", "c"))
    obj = F.from_json("c", "url string, prior string, reason string")
    given = F.startswith("c", F.lit("{"))
    prior = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.coalesce(F.when(given, obj["prior"].try_cast("double")), F.lit(0.55))))
    x = x.select(key, "arrival", F.lit("U").alias("kind"), urls.clean_url(F.when(given, obj["url"]).otherwise(F.col("c"))).alias("url"), prior.alias("prior"), F.lit(None).cast("int").alias("pinned"), F.substring(F.coalesce(F.when(given, obj["reason"]), F.lit("")), 1, 200).alias("reason"))
    x = x.where(urls.valid_url(F.col("url")))
    return x.withColumn("__n", F.row_number().over(Window.partitionBy(key, "url").orderBy("arrival"))).where("__n = 1").drop("__n")


def rendered(parsed: DataFrame, key: str = "query_id") -> DataFrame:
    """A plan as lines again: I, L, R, the best address, X, H, the other addresses."""
    def number(c: Column) -> Column:
        return F.regexp_replace(F.format_string("%.2f", c), r"\.?0+$", "")

    s = settings(parsed, key)
    r = routes(parsed, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(": ", "name", "query").alias("t")))).alias("rs"))
    c = candidates(parsed, key)
    u = c.where("kind = 'U'").withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("prior"), "arrival")))
    u = u.select(key, "n", F.concat(F.lit("U "), number(F.col("prior")), F.lit(" "), "url", F.when(F.col("reason") != "", F.concat(F.lit(" :: "), "reason")).otherwise("")).alias("t"))
    u = u.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("us"))
    h = c.where("kind = 'H'").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("arrival", F.concat(F.lit("H "), "url").alias("t")))).alias("hs"))
    x = s.join(r, key, "left").join(u, key, "left").join(h, key, "left")
    texts = lambda col: F.coalesce(F.transform(col, lambda e: e["t"]), F.array().cast("array<string>"))
    joined = lambda tag, arr: F.when(F.size(arr) > 0, F.array(F.concat(F.lit(f"{tag} "), F.array_join(arr, " | ")))).otherwise(F.array().cast("array<string>"))
    all_lines = F.concat(F.array(F.concat(F.lit("I "), "intent"), F.concat(F.lit("L "), "lang")), joined("R", texts("rs")), F.slice(texts("us"), 1, 1), joined("X", F.col("expansions")), texts("hs"), F.slice(texts("us"), 2, 1000))
    return x.select(key, F.array_join(all_lines, "\n").alias("plan"))


def storable(parsed: DataFrame, refined: bool = False, key: str = "query_id") -> DataFrame:
    """Plans worth storing: five U lines and an X or H; of a second pass, three U lines."""
    n = lambda t: F.count_if(F.col("tag") == t)
    got = parsed.groupBy(key).agg(n("U").alias("u"), (n("X") + n("H")).alias("xh"))
    return got.select(key, ((F.col("u") >= 3) if refined else (F.col("u") >= 5) & (F.col("xh") > 0)).alias("storable"))


def speculative(intents: DataFrame) -> DataFrame:
    """Routes that an intent fires before its plan: one row each. Needs ``intent``."""
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, i)).cast("array<string>").alias("fires")) for n, i in v.ROUTES.items() if n not in v.ROUTES_OFF])
    return intents.select("*", F.explode(F.filter(table, lambda r: F.array_contains(r["fires"], F.col("intent")))).alias("__r")).select(*intents.columns, F.col("__r.name").alias("route"))


def route_fit(source: Column, intent: Column) -> Column:
    """Trust in a route's own confidence once the intent is known."""
    name = F.regexp_extract(source, "^route:(.*)$", 1)
    out = F.lit(1.0)
    for route, fires in v.ROUTES.items():
        out = F.when(name == route, F.when(intent.isin(*fires), 1.0).otherwise(v.ROUTE_DISTRUST) if fires else F.lit(v.ROUTE_DISTRUST)).otherwise(out)
    return out


def json_parts(plans: DataFrame, key: str = "query_id") -> DataFrame:
    """Everything else of plans given as JSON: ``key``, intent, lang, expansions (8), hubs (6, checked), routes of (name, query); the first of each route name in the order given."""
    p = plans.select(key, F.from_json("raw", PLAN_JSON).alias("p")).select(key, "p.*")
    none = F.array().cast("array<string>")
    intent, lang = F.lower(F.trim("intent")), F.lower(F.regexp_extract(F.trim("lang"), r"^([A-Za-z]{2,3})(?:[-_][A-Za-z]{2,4})?$", 1))
    said = F.filter(F.transform(F.coalesce("expansions", none), lambda e: F.trim(e)), lambda e: (F.length(e) > 1) & (F.length(e) < 160))
    hubs = F.array_distinct(F.filter(F.transform(F.slice(F.coalesce("hubs", none), 1, 6), urls.clean_url), urls.valid_url))
    pairs = F.from_json("routes", "map<string,string>")
    listed = F.transform(F.from_json("routes", "array<string>"), lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("query")))
    mapped = F.transform(F.map_entries(pairs), lambda e: F.struct(e["key"].alias("name"), F.nullif(F.substring(F.trim(e["value"]), 1, 240), F.lit("")).alias("query")))
    every = F.coalesce(F.when(F.startswith(F.trim("routes"), F.lit("{")), mapped), F.when(F.startswith(F.trim("routes"), F.lit("[")), listed), F.array().cast("array<struct<name:string,query:string>>"))
    routes = F.filter(every, lambda r: r["name"].isin(*ROUTE_NAMES))
    return p.select(key, F.when(intent.isin(*v.INTENTS), intent).otherwise("informational").alias("intent"), F.coalesce(F.nullif(lang, F.lit("")), F.lit("en")).alias("lang"), F.slice(said, 1, 8).alias("expansions"), hubs.alias("hubs"), F.slice(routes, 1, 8).alias("routes"))


def prompts(queries: DataFrame) -> DataFrame:
    """What a planning model is asked first: query_id, prompt."""
    return queries.select("query_id", F.concat(F.lit("Which web pages answer this, from memory?\n"), F.lit(GRAMMAR), F.lit("\n\nQuestion: "), "query").alias("prompt"))


def refine_prompts(queries: DataFrame, reports: DataFrame) -> DataFrame:
    """What it is asked for a second round, over the report of the first (see ``expand.findings``): query_id, prompt."""
    x = queries.join(reports, "query_id")
    found = F.array_join(F.transform("found", lambda f: F.concat(F.format_string("%.2f", f["relevance"]), F.lit(" "), f["title"], F.lit(" "), f["url"], F.lit("\n  "), f["excerpt"])), "\n")
    block = lambda name, body: F.when(body != "", F.concat(F.lit(f"\n\n{name}:\n"), body)).otherwise("")
    return x.select("query_id", F.concat(F.lit("The first round left gaps. Name pages that fill them, and none of those below.\n"), F.lit(GRAMMAR), F.lit("\n\nQuestion: "), "query", block("Found", found), block("Dead", F.array_join("dead", "\n")), block("Shown", F.array_join("shown", "\n"))).alias("prompt"))
