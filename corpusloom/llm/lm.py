"""Masked pseudo-likelihood of documents under a bidirectional window network.

Tokens are the words of the text (A-Z lower-cased, cut at ASCII white space). A word is known
by 56 bits of a hash and by its shape, one of ``SHAPES`` classes by length, first and last
byte. All documents' words are counted; the ``TOP`` most frequent are tokens of their own, and
every other word falls into the token of its shape, within which its probability is its own
share of that token's occurrences: counts of all words stay a table that scoring joins. Each
token is predicted from the two before and the two after it: embeddings, a hidden layer, and
a softmax in three levels. The sum of the conditional log probabilities is the
document's score.

Training is data parallel over all documents: equal texts are coded once, with the number of
their copies as weight, and dealt by hash to workers of some ``WORKER`` tokens. In a round each
worker starts from the same weights, takes every position of its texts in order of their hash
through Adagrad in numpy, and sends the change of its weights; changes are averaged by
positions in the order of workers. So the result does not depend on partitions or cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import raw, slices
from .cluster import checkpointed

LEVELS = (16, 8, 32)  # choices at each level of a prediction
SIZE = math.prod(LEVELS)
SHAPES = 255
PAD = SIZE - 1  # stands outside the text
TOP = PAD - SHAPES
WIDTH, HIDDEN, SPAN = 8, 16, 2  # of an embedding, of the hidden layer; tokens seen on each side
BATCH, RATE, ROUNDS = 4096, 0.15, 2
WORKER = 2_000_000  # tokens that one set of weights learns from in a round, or so
BLOCK = 8192  # floats of a block of weights
ROWS, BYTES = 1024, 1 << 19  # texts cut into words at a time
EXACT = 4096  # counts below this have a row each in the histogram

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
DIGIT = LOWER.astype(np.uint64) + np.uint64(1)  # of a byte in the polynomial
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
GOLD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93  # of the polynomial over a word's bytes; odd, so it has an inverse


class Powers:
    """Powers of ``BASE`` and of its inverse modulo 2^64, as many as were ever needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(pow(BASE, -1, 1 << 64), k, 1 << 64))])
        return self.up[:n], self.down[:n]


def words(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words of all texts in order (the low byte is the shape), and how many words each text has."""
    data, at = raw(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    space = SPACE[data]
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0] = last[-1] = True
    first[1:], last[:-1] = space[:-1], space[1:]
    inner = at[(at > 0) & (at < n)]
    first[inner] = True
    last[inner - 1] = True
    start, stop = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1
    up, down = powers.of(n)
    total = np.zeros(n + 1, np.uint64)
    digits = DIGIT[data]
    digits *= up
    np.cumsum(digits, out=total[1:])
    x = (total[stop] - total[start]) * down[start]
    size = stop - start
    x ^= size.astype(np.uint64) * GOLD
    x += GOLD  # from here the finaliser of splitmix64
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    shape = (np.minimum(size, 40) * 131 + LOWER[data[start]].astype(np.int64) * 31 + LOWER[data[stop - 1]].astype(np.int64) * 7) % SHAPES
    return x & ~np.uint64(255) | shape.astype(np.uint64), np.diff(np.searchsorted(start, at))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Columns word (key) and n: every word of every document, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            for several in slices(b, 0, 1 << 20, 8 * BYTES):  # counted together
                keys, n = np.unique(np.concatenate([words(part.column(0), powers)[0] for part in slices(several, 0, ROWS, BYTES)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Keys of the frequent words by rank, and counts of all tokens."""

    def __init__(self, top: list[tuple[int, int]], shape_counts: np.ndarray) -> None:
        keys = np.array([w for w, _ in top], np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order
        # keys are evenly spread, so their first 16 bits lead to the few that share them
        self.slot = np.append(np.searchsorted(self.keys, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)), len(keys))
        self.counts = np.zeros(SIZE)
        self.counts[: len(top)] = [n for _, n in top]
        self.counts[TOP:PAD] = shape_counts
        self.share = np.zeros(SIZE)
        self.share[TOP:PAD] = np.log(np.maximum(shape_counts, 1))
        self.rare: DataFrame | None = None  # word and n of the others that occur more than once

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rare": None}  # tasks get no table

    def ids(self, keys: np.ndarray) -> np.ndarray:
        """Token of each word."""
        out = TOP + (keys & np.uint64(255)).astype(np.int64)
        first = (keys >> np.uint64(48)).astype(np.int64)
        at, size = self.slot[first], self.slot[first + 1] - self.slot[first]
        rows = np.flatnonzero(size)
        while len(rows):
            here = at[rows]
            hit = self.keys[here] == keys[rows]
            out[rows[hit]] = self.rank[here[hit]]
            rows = rows[~hit]
            at[rows] += 1
            size[rows] -= 1
            rows = rows[size[rows] > 0]
        return out


def _bucket(n: Column) -> Column:
    return F.when(n < EXACT, n).otherwise(EXACT + F.floor(F.log2(n) * 64)).cast("long")


def vocabulary(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    """Counts all documents. The driver gets a histogram of the counts, the ``TOP`` words and a row for each shape."""
    counts = checkpointed(word_counts(docs, text_col))
    rows = sorted(counts.groupBy(_bucket(F.col("n")).alias("b")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True)
    above, least, pool = 0, 0, counts
    for r in rows:
        if above + r.k >= TOP:
            least, spare = r.b, TOP - above
            cut = min(1.0, (1.2 * spare + 100) / r.k) if least < EXACT else 1.0  # words of one count come in order of their keys, which are evenly spread
            b = _bucket(F.col("n"))
            pool = counts.where((b > least) | ((b == least) & (F.col("word") <= min((1 << 63) - 1, int(-(1 << 63) + cut * (1 << 64))))))
            break
        above += r.k
    best = [F.desc("n"), "word"]
    top = [(r.word, r.n) for r in pool.orderBy(*best).limit(TOP).collect()]
    if len(top) < min(TOP, sum(r.k for r in rows)):  # the keys were not so evenly spread after all
        top = [(r.word, r.n) for r in counts.orderBy(*best).limit(TOP).collect()]
    total = np.zeros(SHAPES)
    for r in counts.groupBy(F.col("word").bitwiseAND(F.lit(255)).alias("shape")).agg(F.sum("n").alias("n")).collect():
        total[r["shape"]] = r["n"]
    for w, n in top:
        total[w & 255] -= n
    vocab = Vocabulary(top, total)
    if top:
        word, n = top[-1]
        vocab.rare = counts.where((F.col("n") > 1) & ((F.col("n") < n) | (F.col("n") == n) & (F.col("word") > F.lit(word))))
    return vocab


class Window:
    """The network. ``flat`` and ``load`` turn its weights into one array and back."""

    NAMES = ("e", "w", "b", "c1", "d1", "c2", "d2", "c3", "d3")

    def __init__(self, counts: np.ndarray, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        by = (counts + 0.1).reshape(LEVELS)
        self.e = r.normal(0, 0.3, (SIZE, WIDTH)).astype(np.float32)
        self.w = r.normal(0, 0.3, (2 * SPAN * WIDTH, HIDDEN)).astype(np.float32)
        self.b = np.zeros(HIDDEN, np.float32)
        for k, times in enumerate((by.sum((1, 2))[None], by.sum(2), by.reshape(-1, LEVELS[2])), 1):
            setattr(self, f"c{k}", np.zeros((len(times), HIDDEN, times.shape[1]), np.float32))
            setattr(self, f"d{k}", np.log(times / times.sum(1, keepdims=True)).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, x: np.ndarray) -> Window:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, x[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def _levels(self, h: np.ndarray, target: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
        """For each level of rows in order of their targets: its number, exponentials of the scores, the right choices, and (group, first row, one past the last).

        Scores are cut at +-60, where exponentials are still numbers, so rows need no maximum.
        """
        below = SIZE
        for k, n in enumerate(LEVELS, 1):
            group = target // below
            below //= n
            c = getattr(self, f"c{k}")
            edge = np.searchsorted(group, np.arange(len(c) + 1))
            live = [(int(g), int(edge[g]), int(edge[g + 1])) for g in np.flatnonzero(np.diff(edge))]
            q = np.empty((len(h), n), c.dtype)
            for g, a, b in live:
                np.matmul(h[a:b], c[g], out=q[a:b])
            q += getattr(self, f"d{k}")[group]
            np.clip(q, -60, 60, out=q)
            yield k, np.exp(q, out=q), target // below % n, live

    def gradient(self, around: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted sum of -log p of ``target`` (n) given ``around`` (n, 2 SPAN), and its gradient."""
        n = len(target)
        order = np.argsort(target.astype(np.int16), kind="stable")
        around, target, weight = around[order], target[order], weight[order]
        x = self.e[around].reshape(n, -1)
        h = np.tanh(x @ self.w + self.b)
        loss, rows, dh, grad = 0.0, np.arange(n), np.zeros_like(h), {}
        for k, q, own, live in self._levels(h, target):
            q /= q.sum(1, keepdims=True)
            loss -= float((np.log(np.maximum(q[rows, own], 1e-20)) * weight).sum())
            q[rows, own] -= 1
            q *= weight[:, None]
            c = getattr(self, f"c{k}")
            grad[f"c{k}"], grad[f"d{k}"] = np.zeros_like(c), np.zeros_like(getattr(self, f"d{k}"))
            if live:
                grad[f"d{k}"][[g for g, _, _ in live]] = np.add.reduceat(q, [a for _, a, _ in live], axis=0)
            for g, a, b in live:
                np.matmul(h[a:b].T, q[a:b], out=grad[f"c{k}"][g])
                dh[a:b] += q[a:b] @ c[g].T
        dh *= 1 - h * h
        grad["b"], grad["w"] = dh.sum(0), x.T @ dh
        seen, dx = around.ravel(), (dh @ self.w.T).reshape(-1, WIDTH)
        grad["e"] = np.stack([np.bincount(seen, dx[:, j], SIZE) for j in range(WIDTH)], 1).astype(self.e.dtype)
        return loss, grad

    def log_probs(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability of the token at each place ``at`` of ``ids`` given its neighbours."""
        out = np.empty(len(at), np.float64)
        sides = [o for o in range(-SPAN, SPAN + 1) if o]
        for low in range(0, len(at), 16_384):
            here = at[low : low + 16_384]
            target = ids[here]
            order = np.argsort(target.astype(np.int16), kind="stable")
            here, target = here[order], target[order]
            around = np.stack([ids[here + o] for o in sides], 1)
            h = np.tanh(self.e[around].reshape(len(here), -1) @ self.w + self.b)
            rows, got = np.arange(len(here)), np.zeros(len(here))
            for _, q, own, _ in self._levels(h, target):
                got += np.log(q[rows, own] / q.sum(1))
            out[low : low + len(here)][order] = got
        return out


def joined(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts' tokens one after the other, ``SPAN`` pads on each side of every text, and the places of the tokens."""
    start = np.cumsum(size + 2 * SPAN) - size - SPAN
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(ids))
    out = np.full(len(ids) + 2 * SPAN * len(size), PAD, np.int64)
    out[at] = ids
    return out, at


class Learner:
    """One worker's pass of a round."""

    def __init__(self, vocab: Vocabulary, weights: np.ndarray) -> None:
        self.net = Window(vocab.counts).load(weights)
        self.sums = {k: np.full_like(getattr(self.net, k), 1e-2) for k in self.net.NAMES}
        self.seen, self.held = 0.0, (np.zeros((0, 2 * SPAN), np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))

    def take(self, ids: np.ndarray, size: np.ndarray, copies: np.ndarray) -> None:
        flat, at = joined(ids, size)
        new = (np.stack([flat[at + o] for o in range(-SPAN, SPAN + 1) if o], 1), flat[at], np.repeat(copies.astype(np.float32), size))
        self.held = tuple(np.concatenate(p) for p in zip(self.held, new, strict=True))
        while len(self.held[1]) >= BATCH:
            self._step()

    def _step(self) -> None:
        part, self.held = tuple(x[:BATCH] for x in self.held), tuple(x[BATCH:] for x in self.held)
        total = float(part[2].sum())
        self.seen += total
        for k, g in self.net.gradient(*part)[1].items():
            g *= np.float32(512 / total)
            np.clip(g, -5, 5, out=g)
            self.sums[k] += g * g
            setattr(self.net, k, getattr(self.net, k) - np.float32(RATE) * g / np.sqrt(self.sums[k]))

    def end(self) -> np.ndarray:
        """The weights after all that was taken."""
        if len(self.held[1]):
            self._step()
        return self.net.flat()


def coded(docs: DataFrame, text_col: str, vocab: Vocabulary) -> DataFrame:
    """Texts dealt to workers: w, h (hash of the text), ids (tokens as 16-bit numbers), copies; in order of (w, h) within partitions.

    Copies are counted before the shuffle, so of a text that many rows repeat a batch sends one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            _, first, copies = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True, return_counts=True)
            b = pa.RecordBatch.from_arrays([*b.take(pa.array(first)).columns, pa.array(copies)], names=["h", "t", "copies"])
            for part in slices(b, 1, ROWS, BYTES):
                keys, size = words(part.column(1), powers)
                ids = vocab.ids(keys).astype("<u2")
                at = np.append(0, 2 * np.cumsum(size)).astype(np.int32)
                got = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), got, part.column(2)], names=["h", "ids", "copies"]).filter(pa.array(size > 0))

    workers = max(1, math.ceil(vocab.counts.sum() / WORKER))
    each = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "h long, ids binary, copies long")
    each = each.withColumn("w", F.pmod("h", F.lit(workers)).cast("int")).select("w", "h", "ids", "copies")
    return checkpointed(each.repartition(4 * workers, "w").sortWithinPartitions("w", "h"))  # more partitions than workers, so that few share one


def _round(texts: DataFrame, vocab: Vocabulary, weights: np.ndarray) -> np.ndarray:
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, own, last, n = None, None, None, 0
        held: list[tuple[np.ndarray, int]] = []

        def push(upto: int) -> None:
            part = held[:upto]
            del held[:upto]
            if part:
                own.take(np.concatenate([x for x, _ in part]).astype(np.int64), np.fromiter((len(x) for x, _ in part), np.int64), np.fromiter((k for _, k in part), np.int64))

        def sent() -> pa.RecordBatch:
            push(len(held))
            change = ((own.end() - weights) * np.float32(own.seen)).astype("<f4")
            parts = [change[i : i + BLOCK].tobytes() for i in range(0, len(change), BLOCK)]
            return pa.RecordBatch.from_arrays([pa.array([worker] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array([own.seen] * len(parts)), pa.array(parts, pa.binary())], names=["w", "block", "seen", "change"])

        for b in batches:
            data, at = raw(b.column(2))
            flat, at = np.frombuffer(data.tobytes(), "<u2"), (at // 2).tolist()
            for i, (w, h, copies) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if w != worker:
                    if own is not None:
                        yield sent()
                    worker, own, last, n = w, Learner(vocab, weights), None, 0
                if h == last:
                    held[-1] = (held[-1][0], held[-1][1] + copies)
                    continue
                held.append((flat[at[i] : at[i + 1]], copies))
                last, n = h, n + at[i + 1] - at[i]
                if n >= 8 * BATCH:
                    push(len(held) - 1)  # the last may have more copies
                    n = 0
        if own is not None:
            yield sent()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[float, np.ndarray]] = {}
        for b in batches:
            for k, n, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                old = total.get(k, (0.0, 0.0))
                total[k] = (old[0] + n, old[1] + np.frombuffer(x.as_buffer(), "<f4").astype(np.float64))
        for k, (n, x) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(x / n).tobytes()], pa.binary())], names=["block", "mean"])

    changes = texts.mapInArrow(learn, "w int, block int, seen double, change binary")
    blocks = changes.repartition("block").sortWithinPartitions("block", "w").mapInArrow(add, "block int, mean binary").collect()
    out = weights.astype(np.float64)
    for r in blocks:
        mean = np.frombuffer(r["mean"], np.float64)
        out[r.block * BLOCK : r.block * BLOCK + len(mean)] += mean
    return out.astype(np.float32)


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> tuple[Vocabulary, Window]:
    """Counts and learns from all of ``docs``; without any word the network stays as it starts."""
    vocab = vocabulary(docs, text_col)
    net = Window(vocab.counts)
    if vocab.counts.any():
        texts = coded(docs, text_col, vocab)
        for _ in range(rounds):
            net.load(_round(texts, vocab, net.flat()))
    return vocab, net


def scores(docs: DataFrame, vocab: Vocabulary, net: Window, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every row: ``id_col``, n_tokens, log_likelihood (sum over tokens), mean_log_prob, perplexity.

    Null and wordless texts have no tokens: 0, 0.0, 0.0 and 1.0. Repeated rows and null ids
    stay; an empty table gives no rows. Other columns are not read. A word that was not
    counted scores as one of its shape that occurs once. Equal texts are scored once for each
    batch that holds them. A very long text takes memory in
    proportion to its length.
    """
    weights = net.flat()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, powers = Window(vocab.counts).load(weights), Powers()
        for b in batches:
            b = b.take(pa.array(np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True)[1]))
            for part in slices(b, 2, ROWS, BYTES):
                keys, size = words(part.column(2), powers)
                token = vocab.ids(keys)
                ids, at = joined(token, size)
                got = own.log_probs(ids, at) - vocab.share[token]
                sums = np.add.reduceat(np.append(got, 0.0), np.minimum(np.cumsum(size) - size, len(got))) * (size > 0)
                rare = np.flatnonzero(token >= TOP)
                row = pa.array(np.concatenate([np.arange(len(size)), np.repeat(np.arange(len(size)), size)[rare]]))
                h, bytes_ = part.column(0).take(row), part.column(1).take(row)
                word = np.concatenate([part.column(0).to_numpy(zero_copy_only=False), keys[rare].view(np.int64)])
                yield pa.RecordBatch.from_arrays([h, bytes_, pa.array(word), pa.array(np.append(size, np.full(len(rare), -1))), pa.array(np.append(sums, np.zeros(len(rare))))], names=["h", "bytes", "word", "n_tokens", "base"])

    # a row for each text of a batch, and one for each of its words that is not a token of its own (n_tokens -1)
    key = [F.xxhash64(text_col).alias("h"), F.octet_length(text_col).alias("bytes")]
    rows = docs.select(*key, F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "h long, bytes int, word long, n_tokens long, base double")
    if vocab.rare is not None:
        rows = rows.join(vocab.rare, "word", "left").where("n_tokens >= 0 OR n IS NOT NULL")
    else:
        rows = rows.where("n_tokens >= 0").withColumn("n", F.lit(1))
    part = F.when(F.col("n_tokens") < 0, F.log("n")).otherwise(0.0)
    sums = rows.groupBy("h", "bytes").agg(F.sum(part).alias("part"), F.count_if(F.col("n_tokens") >= 0).alias("times"), F.max("n_tokens").alias("n_tokens"), F.min("base").alias("base"))
    # a text that several batches hold has its words once for each
    sums = sums.select(F.col("h").alias("__h"), F.col("bytes").alias("__bytes"), "n_tokens", (F.col("base") + F.col("part") / F.col("times")).alias("base"))
    out = docs.select(F.col(id_col).alias("id"), *key).join(sums, F.col("h").eqNullSafe(F.col("__h")) & F.col("bytes").eqNullSafe(F.col("__bytes")))
    mean = F.col("base") / F.greatest("n_tokens", F.lit(1))
    return out.select(F.col("id").alias(id_col), "n_tokens", F.col("base").alias("log_likelihood"), mean.alias("mean_log_prob"), F.exp(F.least(-mean, F.lit(700.0))).alias("perplexity"))
