"""SimHash near-duplicates by fuzzy keys of the binary Golay code.

A fingerprint has 64 bits in three segments of 22, 21 and 21 bits. If two fingerprints
differ in at most two bits, then for one of the ordered pairs (0,1), (1,2), (2,0) of
segments the first is equal and the second differs in at most one bit: the errors are
(2,0,0), (0,2,0), (0,0,2), (1,1,0), (1,0,1) or (0,1,1) at worst, and each has such a
pair. A segment, padded to 23 bits, decodes to one of the 4,096 codewords of the perfect
[23,12,7] code. Two words one bit apart need not decode alike, but the decoded word of
one is always among the decoded words of the other and its 23 neighbours (1 or 6 of
them). So each fingerprint is stored under (pair, first segment, codeword) for those
codewords, is looked up under its own codeword, and every link within two bits is found
and then verified on all 64 bits.

Only distinct fingerprints take part, so exact copies cost nothing. A key held by more
than ``bucket`` fingerprints is not paired off: its fingerprints go another exact way,
linear in their number. Two fingerprints are within two bits if and only if some 64-bit
word is within one bit of both; so each is put under its 65 such words, at most 65
fingerprints can share a word, and the smallest of them links to the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import checkpointed, components, numbered

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, bits)
SEED = 42
BLOCK = 1 << 15  # shingles whose bits are counted at a time


def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


class Golay:
    """Decoding tables of the [23,12,7] code, from its generator polynomial."""

    def __init__(self) -> None:
        one = np.array([_remainder(1 << i) for i in range(23)], np.int64)
        self.low = self._xor_table(one[:12])
        self.high = self._xor_table(one[12:])
        self.error = np.zeros(2048, np.int64)
        for i in range(23):
            self.error[one[i]] = 1 << i
            for j in range(i):
                self.error[one[i] ^ one[j]] = 1 << i | 1 << j
                for k in range(j):
                    self.error[one[i] ^ one[j] ^ one[k]] = 1 << i | 1 << j | 1 << k

    @staticmethod
    def _xor_table(parts: np.ndarray) -> np.ndarray:
        table = np.zeros(1, np.int64)
        for p in parts:
            table = np.concatenate([table, table ^ p])
        return table

    def index(self, words: np.ndarray) -> np.ndarray:
        """Number (0 to 4095) of the codeword nearest to each 23-bit word."""
        syndrome = self.low[words & 4095] ^ self.high[words >> 12]
        return (words ^ self.error[syndrome]) >> 11

    def near(self, words: np.ndarray) -> np.ndarray:
        """For each word, the codewords of itself and its 23 neighbours: an array of 24 columns."""
        flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.int64)
        return self.index(words[:, None] ^ flips[None, :])


def fingerprint(data: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of UTF-8 text, as an unsigned integer; 0 if it has no words."""
    words = data.lower().split() if data else []
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    start = np.concatenate([[0], stop[:-1] + 1])[: n - width + 1].tolist()
    stop = stop[width - 1 :].tolist()
    digest, counts, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(start)
    for at in range(0, total, BLOCK):
        h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(start[at : at + BLOCK], stop[at : at + BLOCK], strict=True)), np.uint64, min(BLOCK, total - at))
        counts += _bits(h)
    return _signs(counts, total)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _signs(counts: np.ndarray, total: int) -> int:
    """The bits that more than half of ``total`` have."""
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def of_hashes(hashes: np.ndarray) -> int:
    """64-bit SimHash of hashed shingles; 0 if there are none."""
    return _signs(sum((_bits(hashes[at : at + BLOCK]) for at in range(0, len(hashes), BLOCK)), np.zeros(64, np.int64)), len(hashes))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Columns ``id``, ``h`` (a hash of the text) and ``fp`` (a signed long of the 64 bits), one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["id", "h", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, h bigint, fp bigint")


def _keys(fps: DataFrame) -> DataFrame:
    """Rows (fp, key, stored): one to six stored keys and one looked-up key for each pair of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = fp.view(np.uint64)
            seg = [(bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
            for p, (exact, fuzzy) in enumerate(((0, 1), (1, 2), (2, 0))):
                base = (p << 34) | (seg[exact] << 12)
                near = np.sort(golay.near(seg[fuzzy]), axis=1)
                new = np.concatenate([np.ones((len(fp), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
                row, _ = np.nonzero(new)
                for f, k, stored in ((fp[row], base[row] | near[new], True), (fp, base | golay.index(seg[fuzzy]), False)):
                    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(k), pa.array(np.full(len(f), stored))], names=["fp", "key", "stored"])

    return fps.mapInArrow(run, "fp bigint, key bigint, stored boolean")


def links(fps: DataFrame, bits: int = 2, bucket: int = 48) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all within two bits of each other.

    Every pair within ``bits`` (0 to 2) has a path of such links; crowded keys give the
    links of stars and not all pairs.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the keys guarantee links of up to two bits")
    keys = checkpointed(_keys(fps.select("fp")))
    stored = keys.where("stored").select("key", "fp")
    crowded = checkpointed(stored.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("key"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    left = keys.where("not stored").select("key", F.col("fp").alias("a")).join(crowded, "key", "left_anti")
    right = stored.withColumnRenamed("fp", "b").join(crowded, "key", "left_anti")
    paired = left.join(right, (left["key"] == right["key"]) & (F.col("a") != F.col("b")) & (apart <= bits)).select("a", "b")
    hot = stored.join(crowded, "key", "left_semi").select("fp").distinct()
    return paired.union(_around(hot, bits))


def _around(fps: DataFrame, bits: int) -> DataFrame:
    """Links by the words that lie between two fingerprints; at most 65 share a word."""
    if not bits:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    words = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    held = fps.select("fp", F.explode(words).alias("w")).groupBy("w").agg(F.collect_set("fp").alias("s")).where("size(s) > 1")
    if bits == 1:  # one of the two is the word itself
        held = held.where(F.array_contains("s", F.col("w"))).select(F.explode("s").alias("a"), F.col("w").alias("b"))
    else:
        held = held.select(F.explode("s").alias("a"), F.array_min("s").alias("b"))
    return held.where("a <> b").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, bits: int, bucket: int) -> DataFrame:
    """Rows (id, h, fp, root, component_id); the root names the group."""
    fps = checkpointed(fingerprints(docs, id_col, text_col, width))
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("id").alias("least")))
    joined = components(links(distinct, bits, bucket))
    rooted = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.select("fp", "root").join(smallest, "root"), "fp").select("id", "h", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 2, bucket: int = 48) -> DataFrame:
    """Fingerprint and group of every row of ``docs``.

    Returns ``id_col``, ``fingerprint`` (16 lowercase hex digits) and ``component_id``, the
    smallest id reachable over links of at most ``bits`` differing bits.

    Null and wordless texts have fingerprint zero and are linked like others. Repeated rows
    stay and fall in one group. A row with a null id stays, with the group's smallest id
    (null if the group has none). An empty table gives no rows. Other columns of ``docs``
    are not read.
    """
    of = _grouped(docs, id_col, text_col, width, bits, bucket)
    return of.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 2, bucket: int = 48) -> DataFrame:
    """One row of ``docs``, with all its columns, for each group of near-duplicates: that of the smallest id.

    A null id stands for its group only if all ids in it are null; null and wordless texts are
    one group. If several rows have the id and text that stand for a group, the one whose
    columns as JSON have the smallest hash stays. Column names may be any.
    """
    return first_rows(docs, _grouped(docs, id_col, text_col, width, bits, bucket).select("id", "h", "root"), id_col, text_col)


def first_rows(docs: DataFrame, of: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of the smallest id of each group, where ``of`` has (id, h, root) of every row."""
    of = checkpointed(of)
    first = of.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("r")).select(F.col("r.id").alias("id"), F.col("r.h").alias("h"))
    d, name = numbered(docs)
    kept = d.join(first, F.col("id").eqNullSafe(F.col(name[id_col])) & (F.col("h") == F.xxhash64(name[text_col])), "left_semi")
    if of.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        same = Window.partitionBy(name[id_col], name[text_col]).orderBy(F.xxhash64(F.to_json(F.struct(*d.columns))))
        kept = kept.withColumn("n", F.row_number().over(same)).where("n = 1").drop("n")
    return kept.toDF(*docs.columns)
