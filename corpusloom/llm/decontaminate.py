"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The index is a table of postings (doc, key, pos), stored once as Parquet in the shared folder
and partitioned by documents as they were read: one row for each place where a term of the
benchmark stands (terms that the benchmark lacks can't match), and one more for each document
with its id and number of words. Corpus counts of terms are counts of postings.

A window of an item looks first at its rarest term by those counts: each of that term's
postings, less the term's offset in the item, is an alignment of the item with the document.
Then the lists of the terms around it are intersected with the alignments: a term at offset j
counts at alignment a where the document has its posting at a + j. Offsets that follow one
another make a run, and a run as long as a window is a match, so overlapping windows of a
passage cost one row for each word. What is shuffled is alignments and postings, never words
or texts; the joins are on (doc, pos, key), which a frequent term can't make hot.

Proximity (``slop`` > 0) takes a term's posting within so many places of a + j.

Terms are known by 64 bits of a hash of the word with A-Z lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import checkpointed, numbered, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SMALL = 500_000  # rows of a few numbers that are broadcast at most; beyond, the same join shuffles


def words(text: Column) -> Column:
    """Words of a text in order, case kept; no words for null."""
    return F.coalesce(F.array_remove(F.split(text, SEPARATORS), ""), F.array().cast("array<string>"))


def _key(word: Column) -> Column:
    """Term number. ``lower`` changes A-Z only where all characters are ASCII; ``translate`` is slower and right everywhere."""
    return F.xxhash64(F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER)))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def index(docs: DataFrame, terms: DataFrame, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored postings of ``terms`` (key): doc (the row's number), key, pos, last, id, h.

    A row with ``last`` closes a document: ``pos`` is its number of words, ``id`` its id and
    ``h`` a hash of its text. Other rows have neither.
    """
    d, name = numbered(docs)
    text = F.col(name[text_col])
    d = d.select(F.monotonically_increasing_id().alias("doc"), F.col(name[id_col]).alias("id"), F.xxhash64(text).alias("h"), F.concat(words(text), F.array(F.lit(None).cast("string"))).alias("ws"))
    every = d.select("doc", "id", "h", F.posexplode("ws").alias("pos", "w"))
    last = F.col("w").isNull()
    every = every.select("doc", F.when(last, 0).otherwise(_key(F.col("w"))).alias("key"), "pos", last.alias("last"), F.when(last, F.col("id")).alias("id"), F.when(last, F.col("h")).alias("h"))
    known = terms.select("key").union(terms.sparkSession.range(1).select(F.lit(0).cast("long"))).distinct()  # 0 is the last row's
    return stored(every.join(_sized(known, n_terms), "key", "left_semi"), "postings")


def _runs(matched: DataFrame, n: int) -> DataFrame:
    """Places (doc, no, pos) in runs of matched offsets that are as long as a window."""
    at = Window.partitionBy("doc", "no", "a")
    x = matched.withColumn("g", F.col("j") - F.row_number().over(at.orderBy("j")))
    x = x.withColumn("run", F.count(F.lit(1)).over(Window.partitionBy("doc", "no", "a", "g")))
    return x.where(F.col("run") >= F.least(F.col("size"), F.lit(n))).select("doc", "no", (F.col("a") + F.col("j")).alias("pos"))


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """Distinct items with words: no (a number), item, ws."""
    b, name = numbered(benchmark)
    ws = words(F.translate(name[item_text], UPPER, LOWER))
    return checkpointed(b.select(F.col(name[item_col]).alias("item"), ws.alias("ws")).where("size(ws) > 0").distinct().withColumn("no", F.monotonically_increasing_id()))


def aligned(postings: DataFrame, places: DataFrame, n_places: int, n: int, slop: int) -> DataFrame:
    """Matched offsets (doc, no, size, a, j, gap) of items at the alignments that their windows' rarest terms give; ``gap`` is the distance of the nearest posting."""
    own = postings.where("NOT last").select("doc", "key", "pos")
    seen = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    low, high = F.greatest(F.col("off") - (n - 1), F.lit(0)), F.greatest(F.least(F.col("off"), F.col("size") - n), F.lit(0))
    windows = places.select("no", "size", "off", "key", F.explode(F.sequence(low, high)).alias("i"))
    wide = F.least(F.col("size"), F.lit(n))
    rarest = windows.join(_sized(seen, n_places), "key").groupBy("no", "i", "size").agg(F.count(F.lit(1)).alias("have"), F.min(F.struct("n", "off", "key")).alias("r")).where(F.col("have") == wide)  # else some term stands nowhere
    anchors = rarest.groupBy(F.col("r.key").alias("key"), "no", F.col("r.off").alias("off"), "size").agg(F.min("i").alias("low"), (F.max("i") + wide - 1).alias("high"))
    anchors = checkpointed(anchors)
    found = own.join(_sized(anchors, n_places), "key").select("doc", "no", "size", (F.col("pos") - F.col("off")).alias("a"), "low", "high")
    found = stored(found, "alignments")
    in_docs = found.select("doc").distinct()
    near = own.join(_sized(in_docs, in_docs.count()), "doc", "left_semi")
    want = found.select("doc", "no", "size", "a", F.explode(F.sequence("low", "high")).alias("j")).join(_sized(places.select("no", F.col("off").alias("j"), "key"), n_places), ["no", "j"])
    want = want.withColumn("d", F.explode(F.sequence(F.lit(-slop), F.lit(slop)))) if slop else want.withColumn("d", F.lit(0))
    want = want.withColumn("pos", F.col("a") + F.col("j") + F.col("d"))
    got = want.join(near, ["doc", "pos", "key"]).select("doc", "no", "size", "a", "j", F.abs("d").alias("gap"))
    # the aggregate and the windows over runs all find their rows together after this one shuffle
    return checkpointed(got.repartition("doc", "no", "a").groupBy("doc", "no", "size", "a", "j").agg(F.min("gap").alias("gap")))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 10, slop: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents (doc, id, h, n_words), matched offsets (see ``aligned``), and items (no, item)."""
    items = _items(benchmark, item_col, item_text)
    places = items.select("no", F.size("ws").alias("size"), F.posexplode("ws").alias("off", "w")).select("no", "size", "off", F.xxhash64("w").alias("key"))
    n_places = places.count()
    postings = index(docs, places.select("key").distinct(), n_places, id_col, text_col)
    rows = postings.where("last").select("doc", "id", "h", F.col("pos").cast("long").alias("n_words"))
    return rows, aligned(postings, places, n_places, n, slop), items.select("no", "item")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """Ids and text hashes (id, h) of the documents that hold a window of the benchmark, each once."""
    rows, matched, _ = matches(docs, benchmark, id_col, text_col, item_col, item_text, n)
    return rows.join(_runs(matched, n).select("doc").distinct(), "doc", "left_semi").select("id", "h").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all columns; nulls, empty texts and repeats stay as they are."""
    found = checkpointed(contaminated(docs, benchmark, id_col, text_col, item_col, item_text, n))
    d, name = numbered(docs)
    same = F.col("id").eqNullSafe(F.col(name[id_col])) & (F.col("h") == F.xxhash64(name[text_col]))
    return d.join(_sized(found, found.count()), same, "left_anti").toDF(*docs.columns)


def _by_doc(hits: DataFrame, items: DataFrame, hit: str, names: str) -> DataFrame:
    return hits.join(items, "no").groupBy("doc").agg(F.size(F.collect_set("pos")).cast("long").alias(hit), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias(names))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 10, slop: int = 0, near: int = 0) -> DataFrame:
    """Words of each document that stand in passages of the benchmark.

    Returns, for every row of ``docs``: ``id_col``, n_words, n_hit (words inside any matched
    window), n_items, items_sha256, contaminated (n_hit > 0), and ``items``, the sorted ids.
    A window's words count as matched within ``slop`` places of where they would stand, its
    rarest one exactly there. With ``near`` > ``slop`` the columns n_near and near_items say
    the same of matches within ``near`` places.

    Null and wordless texts have no words and no hits. Each of several equal rows, null ids
    included, returns the same counts. Items without words match nothing; repeated items
    count once; an item with a null id counts for hits but isn't listed. Empty tables give
    no rows or no hits. A very long text is as many postings as it has benchmark terms, in
    one task's stream. Other columns, whatever their names, are not read.
    """
    rows, matched, items = matches(docs, benchmark, id_col, text_col, item_col, item_text, n, max(slop, near))
    out = rows.select("doc", F.col("id"), "n_words").join(_by_doc(_runs(matched.where(F.col("gap") <= slop), n), items, "n_hit", "items"), "doc", "left")
    none = F.array().cast("array<string>")
    extra = []
    if near > slop:
        out = out.join(_by_doc(_runs(matched, n), items, "n_near", "near_items"), "doc", "left")
        extra = [F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("near_items", none).alias("near_items")]
    out = out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), *extra)
    more = ["n_near", "near_items"] if extra else []
    return out.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", *more)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, len(part) AS k, array_to_string(part, ' ') AS s
  FROM (SELECT item_id, list_slice(ws, i, i + 9) AS part FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0))
), spot AS (
  SELECT doc_id, i, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS s
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k)
), hit AS (
  SELECT doc_id, i, spot.k AS k, item_id FROM spot JOIN win ON spot.k = win.k AND spot.s = win.s
), inside AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN inside USING (doc_id) LEFT JOIN items USING (doc_id)
"""
