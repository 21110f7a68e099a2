"""Near-duplicates at a similarity of word shingles: SimHash groups first, then shared minima; all verified.

A text is the set of its shingles of ``WORDS`` words (lower-cased; a shorter text is one
shingle); the similarity of two is Jaccard's, and every link is verified on both whole sets.

Candidates come from the Golay keys of the sets' SimHash fingerprints first: each set of a
group within two bits is tried with the group's first. Exact and all but exact copies go so.
Fingerprints of sets at similarity 0.8 differ in ten of 64 bits, more than any key that is
selective can bridge, so among the rest candidates share one of ``BANDS`` keys of ``ROWS``
minima each: a pair at similarity s is missed with probability (1 - s^ROWS)^BANDS, 3 in a
million at 0.8, less above.

Only distinct sets take part. In rounds, the sets of a key are compared with a few of them,
its pivots; what links to a smaller set leaves all keys, and from the round on that takes
all keys, pivots leave their key. The first round takes few of the keys, so most of a large
group of near copies leaves after a comparison or two each. The number of pivots grows until
no key holds two sets. Of two similar sets that share a key neither leaves unseen: one
becomes a pivot while the other is there, or one links to a smaller set. So a large group
gives stars and not all pairs, but a set that left may be similar to one that its star does
not reach. Therefore, last, the sets of each key that are in different groups by then, one of
which had left, are compared too: those with a near sketch in another group, in blocks, so
neither a row nor a copy of the sets is made for each pair. Every pair that shares a key is
thus compared or joined by other links, and groups are whole: a chain of similar texts is one.

Texts that share half of their shingles, as with a passage that very many hold, share keys
often. So each set has a sketch beside its keys, three bits of each minimum, and a set is
paired with a pivot only if their sketches differ in at most ``FAR`` of 480 bits: 48 are
expected at 0.8, and over 86 come about once in 70,000 such pairs; at 0.5 some 120 are
expected. The sketches are compared in the join itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .arrow import slices
from .cluster import checkpointed, components, forgotten, gathered, numbered, stored, swept
from .simhash import SEED, first_rows

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 5
FIRST = 4  # keys taken in the first round
SKETCH = [f"s{i}" for i in range(8)]  # of 20 minima each
FAR = 86
SMALL = 500_000  # rows of a few numbers that are broadcast at most; beyond, the same join shuffles
FEW = 100_000  # rows with sketches that one task takes at most
SIDE = 64  # sets that are held against as many others in one place
BLOCK = 1 << 10  # shingles hashed by all functions at a time


def shingles(data: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; none if it has no words."""
    words = data.lower().split() if data else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= WORDS:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    start = np.concatenate([[0], stop[:-1] + 1])[: n - WORDS + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(start, stop[WORDS - 1 :].tolist(), strict=True)), np.uint64, len(start)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


class Bands:
    """Keys of sets: minima under multiply-add functions, mixed by bands."""

    def __init__(self) -> None:
        r = np.random.default_rng(SEED)
        draw = lambda *shape: r.integers(0, 1 << 63, shape, np.uint64) << np.uint64(1) | np.uint64(1)
        self.a, self.b, self.mix, self.own = draw(BANDS * ROWS), draw(BANDS * ROWS), draw(BANDS, ROWS), draw(BANDS)

    def keys(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and sketch of a set."""
        least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), BLOCK):
            np.minimum(least, (hashes[at : at + BLOCK, None] * self.a + self.b).min(0), out=least)
        bits = (least >> np.uint64(29) & np.uint64(7)).reshape(len(SKETCH), -1) << (np.uint64(3) * np.arange(BANDS * ROWS // len(SKETCH), dtype=np.uint64))
        return ((least.reshape(BANDS, ROWS) * self.mix).sum(1, dtype=np.uint64) + self.own).view(np.int64), bits.sum(1, dtype=np.uint64).view(np.int64)


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns id, h (hash of the text), k (hash of the set), fp (SimHash of the set), bands, and the sketch; a set without shingles has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, none = Bands(), (np.zeros(0, np.int64), np.zeros(len(SKETCH), np.int64))
        for b in batches:
            for part in slices(b, 2, 1024, 1 << 20):
                sets = [shingles(t.as_py()) for t in part.column(2)]
                k, fp = (np.fromiter(x, np.uint64, len(sets)).view(np.int64) for x in ((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), map(simhash.of_hashes, sets)))
                found = [of.keys(s) if len(s) else none for s in sets]
                sketch = np.array([x for _, x in found], np.int64).reshape(-1, len(SKETCH))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(k), pa.array(fp), pa.array([x for x, _ in found], pa.list_(pa.int64())), *map(pa.array, np.ascontiguousarray(sketch.T))], names=["id", "h", "k", "fp", "bands", *SKETCH])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, ", ".join([f"id {kind}, h bigint, k bigint, fp bigint, bands array<bigint>", *(f"{c} bigint" for c in SKETCH)]))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The stored sets (k, s) of ``wanted`` (k, at): read from the text of each one's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, 1024, 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], names=["k", "s"])

    d, name = numbered(docs.select(id_col, text_col))
    of = wanted.select("k", F.col("at.id").alias("id"), F.col("at.h").alias("h"))
    found = d.join(_sized(of, wanted.count()), F.col("id").eqNullSafe(F.col(name[id_col])) & (F.col("h") == F.xxhash64(name[text_col])))
    return stored(found.dropDuplicates(["k"]).select("k", F.col(name[text_col]).cast("binary").alias("t")).mapInArrow(run, "k bigint, s binary"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is at least ``SIMILAR``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
            good = pa.array([jaccard(one(x), one(y)) >= SIMILAR for x, y in zip(b.column(2), b.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(good)

    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    return gathered(checkpointed(both.select("a", "b", "sa", "sb").mapInArrow(check, "a bigint, b bigint")))


def _simhash_pairs(distinct: DataFrame) -> DataFrame:
    """Each set of a SimHash group (within two bits, by Golay keys) with the group's first: (a, b)."""
    groups = components(simhash.links(checkpointed(distinct.select("fp").distinct())))
    named = distinct.join(groups, F.col("fp") == F.col("node"), "left").select("k", "at", F.coalesce("root", "fp").alias("g"))
    first = named.groupBy("g").agg(F.min(F.struct("at", "k")).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1").select("g", F.col("p.k").alias("b"))
    return named.join(first, "g").where("k <> b").select(F.col("k").alias("a"), "b")


def _alone_left_out(rows: DataFrame) -> DataFrame:
    """Rows (k, at, band, key, sketch) whose key another set has too; few of them in one partition."""
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return gathered(checkpointed(rows.join(several, "key").select("k", "at", "band", "key", *SKETCH)), FEW)


def _across(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (g, k, out, root, left, sketch) of sets that share a key and have near sketches with a set of another group by ``found``, not both there to the end of the rounds.

    ``rows`` has the sets of the keys that several have. ``g`` is the largest group of the key,
    ``out`` whether the set is of another. The sets of the largest group are not held against
    one another, so a large group costs no more than its rows for each set of another group;
    and a set is told to be near without a row for each of those that are.
    """
    swept(rows.sparkSession)
    groups, left = components(found), found.select(F.col("a").alias("k"), F.lit(True).alias("left")).distinct()
    of = checkpointed(groups.withColumnRenamed("node", "k").join(left, "k", "left"))
    rows = rows.select("k", "key", *SKETCH).join(_sized(of, of.count()), "k", "left").withColumns({"root": F.coalesce("root", "k"), "left": F.coalesce("left", F.lit(False))})
    mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("left").alias("some")).where("lo <> hi AND some").select("key")
    rows = gathered(checkpointed(rows.join(mixed, "key")), FEW)
    main = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("g"))
    rows = checkpointed(rows.join(main, "key").withColumn("out", F.col("root") != F.col("g")))
    other = rows.toDF(*[f"{c}_y" for c in rows.columns])
    apart = reduce(lambda p, q: p + q, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_y"))) for c in SKETCH])
    near = (F.col("key") == F.col("key_y")) & F.expr("root <> root_y AND (left OR left_y)") & (apart <= FAR)
    some = rows.where("out").join(other, near, "left_semi").union(rows.where("NOT out").join(other.where("out_y"), near, "left_semi"))
    return checkpointed(some.select("g", "k", "out", "root", "left", *SKETCH).distinct())


def _joined(some: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links (a, b) between the sets of different groups of each ``g`` in ``some``.

    The sets of a ``g`` are dealt into blocks of some ``SIDE``, and each two blocks are compared
    in one place, so a set is sent once for ``SIDE`` others and not for each.
    """

    def check(t: pa.Table) -> pa.Table:
        block, k, root, left = (t.column(c).to_numpy() for c in ("block", "k", "root", "left"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("s")]
        sketch = np.stack([t.column(c).to_numpy() for c in SKETCH], 1)
        lo, hi, found = t.column("lo")[0].as_py(), t.column("hi")[0].as_py(), []
        others = np.flatnonzero(block == hi)
        for i in np.flatnonzero(block == lo):
            apart = np.bitwise_count(sketch[others] ^ sketch[i]).sum(1, dtype=np.int64)
            for j in others[(apart <= FAR) & (root[others] != root[i]) & (left[others] | left[i]) & ((lo < hi) | (others > i))]:
                if jaccard(sets[i], sets[j]) >= SIMILAR:
                    found.append((k[i], k[j]))
        return pa.table({c: pa.array([p[n] for p in found], pa.int64()) for n, c in enumerate("ab")})

    sizes = some.groupBy("g").agg(F.count_if("out").alias("outs"), F.count_if(~F.col("out")).alias("ins"))
    sizes = sizes.select("g", *[F.ceil(F.col(c) / SIDE).alias(c) for c in ("outs", "ins")])
    own = F.expr("if(out, pmod(xxhash64(k), outs), outs + pmod(xxhash64(k), ins))")  # the largest group's blocks come after the others
    cells = some.join(sizes, "g").withColumn("block", own).withColumn("with", F.explode(F.expr("sequence(0L, outs + if(out, ins, 0L) - 1L)")))
    cells = cells.withColumns({"lo": F.least("block", "with"), "hi": F.greatest("block", "with")}).drop("with", "outs", "ins", "out")
    return checkpointed(cells.join(sets, "k").groupBy("g", "lo", "hi").applyInArrow(check, "a bigint, b bigint"))


def links(distinct: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified links (a, b) that connect all similar ones among the distinct sets ``k``, whose first row is ``at``, fingerprint ``fp`` and keys ``bands``."""
    full = distinct.where("size(bands) > 0")
    tried = checkpointed(_simhash_pairs(full))
    held = _alone_left_out(full.select("k", "at", F.posexplode("bands").alias("band", "key"), *SKETCH))
    shared = held
    wanted = held.select("k").union(tried.select("a")).union(tried.select("b")).distinct()
    sets = _sets(checkpointed(full.select("k", "at").join(wanted, "k")), docs, id_col, text_col)
    found = near = _verified(tried, sets)
    gone = lambda rows, near: rows.join(near.select(F.col("a").alias("k")).distinct(), "k", "left_anti")
    held = _alone_left_out(gone(held, near))

    def compared(rows: DataFrame, pivots: int) -> tuple[DataFrame, DataFrame]:
        """Links of sets to the pivots of their keys, and the pivots (key, k)."""
        first = rows.groupBy("key", F.pmod(F.xxhash64("k"), F.lit(pivots)).alias("part")).agg(F.min(F.struct("at", "k", *SKETCH)).alias("p"))
        first = checkpointed(first.select("key", F.col("p.k").alias("b"), F.col("p.at").alias("b_at"), *[F.col(f"p.{c}").alias(f"b_{c}") for c in SKETCH]))
        apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"b_{c}"))) for c in SKETCH])
        pair = F.when(F.col("b_at") < F.col("at"), F.struct("b", F.col("k").alias("a"))).otherwise(F.struct(F.col("k").alias("b"), F.col("b").alias("a")))  # b comes before a
        near = (rows["key"] == first["key"]) & (F.col("k") != F.col("b")) & (apart <= FAR)
        some = rows.join(first, near).select(pair.alias("p")).select("p.a", "p.b").distinct()
        return _verified(some, sets), first.select("key", F.col("b").alias("k"))

    swept(docs.sparkSession)
    near, _ = compared(held.where(F.col("band") < FIRST), 1)
    found, held, pivots = found.union(near), _alone_left_out(gone(held, near)), 1
    while held.limit(1).count():
        swept(docs.sparkSession)
        near, first = compared(held, pivots)
        found = found.union(near)
        held = _alone_left_out(gone(held, near).join(first, ["key", "k"], "left_anti"))
        pivots *= 4
    found = found.union(_joined(_across(shared, found), sets))
    forgotten(sets)
    return found


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, for each group of near-duplicates: that of the smallest id.

    Ids, repeated rows and nulls count as in ``simhash.representatives``. Texts without words
    are one group.
    """
    rows = checkpointed(_sketches(docs, id_col, text_col))
    at = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    distinct = checkpointed(rows.groupBy("k").agg(F.min(at).alias("at"), F.min("fp").alias("fp"), F.min("bands").alias("bands"), *[F.min(c).alias(c) for c in SKETCH]))
    joined = components(links(distinct, docs, id_col, text_col))
    rooted = distinct.select("k").join(joined, F.col("k") == joined["node"], "left").select("k", F.coalesce("root", "k").alias("root"))
    return first_rows(docs, rows.select("id", "h", "k").join(rooted, "k").select("id", "h", "root"), id_col, text_col)
