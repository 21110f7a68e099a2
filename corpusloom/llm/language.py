"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes.

Two gated recurrent units, one in each direction, read a text byte by byte; their states
at a byte are added up into scores of the languages there, so every position gets a label
distribution, and a document's probabilities are the mean over its positions. Trained here
in numpy by backpropagation through time.

A text of any length is read whole. The network is defined on stretches: a text is cut into
stretches of ``CORE`` bytes, and the unit of each direction runs from a zero state ``WARM``
bytes before its stretch (after it, for the backward unit; spaces stand outside the text) to
the stretch's end. So every byte's label depends on the bytes around it and not on the text's
length, stretches run side by side, and memory and step count don't depend on the longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .cluster import numbered

SAMPLE, PIECES, PIECE = 4000, 6, 64  # documents to learn from, pieces of each, bytes of a piece
HIDDEN, STEPS, BATCH, RATE = 6, 500, 192, 0.02
CORE, WARM, SIDE = 240, 16, 1024  # SIDE: stretches that run side by side
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")  # and some signs that are numbers; see has_letter
ROWS, BYTES = 512, 1 << 20  # texts labelled at a time


def _tanh_gate(a: np.ndarray) -> np.ndarray:
    """Sigmoid of 2a, in place."""
    np.tanh(a, out=a)
    a += 1
    a *= 0.5
    return a


def has_letter(text: bytes | None) -> bool:
    """Whether a text has a letter (of any script; fractions, superscripts and Roman number signs are none)."""
    s = (text or b"").decode("utf-8", "replace")
    first = LETTER.search(s)
    return first is not None and (first[0].isalpha() or any(map(str.isalpha, s[first.end() :])))


class Network:
    """Weights by direction: gates ``wg`` (2,256,2H) and ``ug`` (2,H,2H), candidate ``wc`` (2,256,H) and ``uc`` (2,H,H), output ``v`` (2,H,K) and ``b`` (K).

    h' = h + z (tanh(wc[x] + r (h uc)) - h), with z, r = sigmoid(2 (wg[x] + h ug)).
    """

    NAMES = ("wg", "ug", "wc", "uc", "v", "b")

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 0) -> None:
        r, k = np.random.default_rng(seed), len(langs)
        self.langs, self.hidden = langs, hidden
        self.wg = r.normal(0, 0.1, (2, 256, 2 * hidden)).astype(np.float32)
        self.ug = r.normal(0, 0.3, (2, hidden, 2 * hidden)).astype(np.float32)
        self.wc = r.normal(0, 0.5, (2, 256, hidden)).astype(np.float32)
        self.uc = r.normal(0, 0.3, (2, hidden, hidden)).astype(np.float32)
        self.v = r.normal(0, 0.3, (2, hidden, k)).astype(np.float32)
        self.b = np.zeros(k, np.float32)

    def states(self, x: np.ndarray) -> list[tuple]:
        """Per step: inputs, old state, gates, inner product and candidate; ``x`` is (2, steps, n), the second already backward."""
        n, h, out = x.shape[2], self.hidden, []
        s = np.zeros((2, n, h), np.float32)
        d = np.arange(2)[:, None]
        for t in range(x.shape[1]):
            xt = x[:, t]
            g = _tanh_gate(self.wg[d, xt] + s @ self.ug)
            q = s @ self.uc
            c = np.tanh(self.wc[d, xt] + g[..., h:] * q)
            new = s + g[..., :h] * (c - s)
            out.append((xt, s, g, q, c, new))
            s = new
        return out

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions of ``x`` (steps, n) against a label a column, and its gradient."""
        steps, n = x.shape
        h = self.hidden
        run = self.states(np.stack([x, x[::-1]]))
        new = np.stack([r[5] for r in run], 1)  # (2, steps, n, h)
        forward, backward = new[0], new[1][::-1]
        logits = forward @ self.v[0] + backward @ self.v[1] + self.b
        logits -= logits.max(-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(-1, keepdims=True)
        loss = float(-np.log(np.maximum(p[:, np.arange(n), y], 1e-12)).mean())
        p[:, np.arange(n), y] -= 1
        p /= steps * n
        grad = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        grad["b"] += p.sum((0, 1))
        for k, s in enumerate((forward, backward)):
            grad["v"][k] = np.tensordot(s, p, ([0, 1], [0, 1]))
        into = np.stack([p @ self.v[0].T, (p @ self.v[1].T)[::-1]])
        carry = np.zeros((2, n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            xt, s, g, q, c, _ = run[t]
            carry = carry + into[:, t]
            z, r = g[..., :h], g[..., h:]
            dc = carry * z * (1 - c * c)
            dg = np.concatenate([carry * (c - s), dc * q], -1) * (2 * g * (1 - g))
            dq = dc * r
            grad["ug"] += s.transpose(0, 2, 1) @ dg
            grad["uc"] += s.transpose(0, 2, 1) @ dq
            for k in (0, 1):
                np.add.at(grad["wg"][k], xt[k], dg[k])
                np.add.at(grad["wc"][k], xt[k], dc[k])
            carry = carry * (1 - z) + dg @ self.ug.transpose(0, 2, 1) + dq @ self.uc.transpose(0, 2, 1)
        return loss, grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 1) -> None:
        """Adam on batches of pieces ``x`` (n, bytes) with labels ``y``, each language equally often."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        for t in range(1, steps + 1):
            ids = np.array([rng.choice(of[k]) for k in rng.integers(0, len(of), BATCH)])
            _, grad = self.loss_and_gradient(np.ascontiguousarray(x[ids].T), y[ids])
            rate = RATE * min(1.0, 2 * (1 - t / (steps + 1)))
            for k, g in grad.items():
                np.clip(g, -0.5, 0.5, out=g)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                setattr(self, k, (getattr(self, k) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32))

    def _half(self, x: np.ndarray, k: int, skip: int) -> np.ndarray:
        """Scores of direction ``k`` at the steps after ``skip``; ``x`` is (steps, n) in reading order."""
        n, h = x.shape[1], self.hidden
        wg, ug, wc, uc, v = self.wg[k], self.ug[k], self.wc[k], self.uc[k], self.v[k]
        s = np.zeros((n, h), np.float32)
        g, c, q, u = (np.empty((n, w), np.float32) for w in (2 * h, h, h, 2 * h))
        out = np.empty((x.shape[0] - skip, n, len(self.langs)), np.float32)
        for t in range(x.shape[0]):
            np.take(wg, x[t], 0, out=g, mode="clip")
            np.matmul(s, ug, out=u)
            g += u
            _tanh_gate(g)
            np.matmul(s, uc, out=q)
            q *= g[:, h:]
            np.take(wc, x[t], 0, out=c, mode="clip")
            c += q
            np.tanh(c, out=c)
            c -= s
            c *= g[:, :h]
            s += c
            if t >= skip:
                np.matmul(s, v, out=out[t - skip])
        return out

    def position_sums(self, texts: list[bytes]) -> np.ndarray:
        """Sum over the positions of each text of its label distributions, (texts, languages)."""
        total = np.zeros((len(texts), len(self.langs)))
        spans = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t), CORE)]
        spans.sort(key=lambda s: min(CORE, len(texts[s[0]]) - s[1]))  # short stretches run together
        for first in range(0, len(spans), SIDE):
            part = spans[first : first + SIDE]
            size = np.array([min(CORE, len(texts[i]) - at) for i, at in part])
            core = int(size.max())
            x = np.full((len(part), core + 2 * WARM), 32, np.uint8)
            for row, (i, at) in enumerate(part):
                low, high = max(0, at - WARM), min(len(texts[i]), at + int(size[row]) + WARM)
                x[row, low - at + WARM : high - at + WARM] = np.frombuffer(texts[i], np.uint8, high - low, low)
            x = np.ascontiguousarray(x.T)
            logits = self._half(x[: WARM + core], 0, WARM)
            logits += self._half(x[WARM:][::-1], 1, WARM)[::-1]
            logits += self.b
            logits -= logits.max(-1, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(-1, keepdims=True)
            logits *= (np.arange(core)[:, None] < size[None, :])[..., None]
            np.add.at(total, [i for i, _ in part], logits.sum(0))
        return total

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        """Language and its pooled probability; ``und`` and 0 for null and for texts without a letter."""
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known and self.langs:
            sums = self.position_sums([texts[i] for i in known])
            p = sums / sums.sum(1, keepdims=True)
            best = p.argmax(1)
            score[known] = np.clip(p[np.arange(len(known)), best], 0, 1)
            for i, b in zip(known, best, strict=True):
                names[i] = self.langs[b]
        return names, score


def _remainder(id_col: str, modulus: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(0))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, steps: int = STEPS) -> Network:
    """Learns from pieces, at hashed places, of at most ``sample`` documents with a language whose crc32(id) mod 4 is not 2.

    Without any such document the network knows no language and predicts ``und``.
    """
    raw = F.col("t")
    at = F.transform(F.sequence(F.lit(1), F.lit(PIECES)), lambda i: (F.pmod(F.xxhash64("id", i), F.greatest(F.octet_length(raw) - PIECE, F.lit(0)) + 1) + 1).cast("int"))
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (_remainder(id_col, 4) != 2))
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 40))
    # tasks send only rows below a place that a little more than the sample is expected to be below
    below = min(1 << 40, int((1 << 40) * (1.2 * sample + 100) / max(known.count(), 1)))
    base = known.where(place < below).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("t"), place.alias("place")).where("length(t) > 0")
    rows = base.select("id", "lang", "place", F.transform(at, lambda p: F.substring(raw, p, F.lit(PIECE))).alias("p")).orderBy("place", "id").limit(sample).collect()
    langs = sorted({r.lang for r in rows})
    if not langs:
        return Network([])
    x = np.full((len(rows) * PIECES, PIECE), 32, np.uint8)
    y = np.repeat([langs.index(r.lang) for r in rows], PIECES)
    for i, p in enumerate(p for r in rows for p in r.p):
        x[i, : len(p)] = np.frombuffer(bytes(p), np.uint8)
    net = Network(langs)
    net.fit(x, y, steps)
    return net


def predictions(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every row: ``id_col``, held_out, lang_pred, score.

    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter. Repeated rows
    and null ids (held_out false) stay; an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, ROWS, BYTES):
                names, score = net.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), (_remainder("id", 4) == 2).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, net: Network, sure: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language has at least the probability ``sure``, with all columns.

    A row's columns go through the worker once, in small parts; its text is read where it
    stands. Null texts and texts without a letter go; repeated rows stay or go together.
    """
    d, name = numbered(docs)
    at = d.columns.index(name[text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, at, ROWS, BYTES):
                names, score = net.predict(part.column(at).cast(pa.binary()).to_pylist())
                yield part.filter(pa.array([n != UNKNOWN and p >= sure for n, p in zip(names, score, strict=True)], pa.bool_()))

    return d.mapInArrow(run, d.schema).toDF(*docs.columns)
