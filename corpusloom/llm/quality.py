"""Document quality from a linear-chain conditional random field over lines.

Each line that is not blank is a node, good or bad; its features are its own shape and that
of the lines before and after. Labels are of documents, so the field is fitted in three
steps: a line classifier learns from the documents' labels; lines of bad documents that it
takes for good become good (the worst line stays bad); then the field learns emissions and
transitions from these line labels by its exact conditional likelihood. A document's
quality is the share of good in the forward-backward marginals of its lines, weighted by
their length, put on a probability scale by a logistic curve.

Fitting takes ``SAMPLE`` labelled documents of at most ``LINES`` lines, in the order of a hash
of their id; all documents are scored, whole. Chains run side by side in groups of like
length whose cells are bounded, so a document's memory follows its own lines and never
widens others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .cluster import numbered

SAMPLE, LINES = 6000, 2000  # labelled documents to learn from at most, and lines of each at most
ROWS, BYTES = 512, 1 << 20  # texts turned into features at a time
CELLS = 1 << 17  # of chains that run side by side: chains times the longest
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
UPPERS = bytes(range(65, 91))
DIGITS = b"0123456789"
SPACES = b" \t\r\x0b\x0c"
PROSE = b".,;:?'\"()-"
N_OWN = 13


def _left(line: bytes, drop: bytes) -> int:
    return len(line) - len(line.translate(None, drop))


def line_features(line: bytes) -> tuple[float, ...]:
    """Shape of one line of UTF-8 text that is not blank."""
    n = len(line)
    words = line.split()
    k = len(words) or 1
    letters, upper = _left(line, LETTERS), _left(line, UPPERS)
    digits, spaces, prose = _left(line, DIGITS), _left(line, SPACES), _left(line, PROSE)
    other = n - letters - digits - spaces - prose
    distinct = len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return (
        min(len(str(n)), 6) / 3.0,
        letters / n,
        upper / (letters or 1),
        min(1.0, 4.0 * other / n),
        min(1.0, 4.0 * digits / n),
        min(1.0, 4.0 * prose / n),
        min(1.0, line.count(b"!") / k),
        min(1.0, line.count(b"|") * 2 / k),
        min(2.0, (n - spaces) / k / 6.0),
        distinct / k,
        again / k,
        1.0 if line.rstrip()[-1:] in b".?!:\"'" else 0.0,
        (pairs + 1) / k,
    )


def chain(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x own) and lengths of the lines that are not blank."""
    lines = [x for x in (text or b"").split(b"\n") if x.strip()]
    if not lines:
        return np.zeros((0, N_OWN), np.float32), np.zeros(0, np.float32)
    seen: dict[bytes, tuple[float, ...]] = {}
    rows = [seen[x] if x in seen else seen.setdefault(x, line_features(x)) for x in lines]
    return np.array(rows, np.float32), np.fromiter(map(len, lines), np.float32, len(lines))


def widened(own: np.ndarray) -> np.ndarray:
    """A line's features beside those of its neighbours, with marks for the first and last line and a constant."""
    n = len(own)
    out = np.zeros((n, 3 * N_OWN + 3), np.float32)
    out[:, :N_OWN] = own
    out[1:, N_OWN : 2 * N_OWN] = own[:-1]
    out[:-1, 2 * N_OWN : 3 * N_OWN] = own[1:]
    if n:
        out[0, -3] = out[-1, -2] = 1
        out[:, -1] = 1
    return out


def _side_by_side(size: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the chains that have lines, in groups of like length of at most ``CELLS`` cells (or one chain)."""
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    high = len(order)
    while high:
        low = max(0, high - max(1, CELLS // int(size[order[high - 1]])))
        yield order[low:high]
        high = low


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(score: np.ndarray, size: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains side by side: log odds of good (chains x steps), their lengths, 2 x 2 transition scores.

    Returns each chain's log partition, the marginal of good (chains x steps) and the
    expected number of each transition over all chains.
    """
    d, steps = score.shape
    alpha = np.zeros((steps, 2, d))
    beta = np.zeros((steps, 2, d))
    inside = np.arange(steps)[:, None] < size[None, :]
    alpha[0, 1] = score[:, 0]
    for t in range(1, steps):
        for s in (0, 1):
            a = _log_add(alpha[t - 1, 0] + move[0, s], alpha[t - 1, 1] + move[1, s]) + (score[:, t] if s else 0.0)
            alpha[t, s] = np.where(inside[t], a, alpha[t - 1, s])
    for t in range(steps - 2, -1, -1):
        for s in (0, 1):
            b = _log_add(beta[t + 1, 0] + move[s, 0], beta[t + 1, 1] + move[s, 1] + score[:, t + 1])
            beta[t, s] = np.where(inside[t + 1], b, 0.0)
    z = _log_add(alpha[-1, 0], alpha[-1, 1])
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - z, 0.0)).T
    pairs = np.zeros((2, 2))
    for r in (0, 1):
        for s in (0, 1):
            e = alpha[:-1, r] + move[r, s] + (score.T[1:] if s else 0.0) + beta[1:, s] - z
            pairs[r, s] = np.exp(np.minimum(e, 0.0))[inside[1:]].sum() if steps > 1 else 0.0
    return z, good, pairs


def _adam(grad, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class LineField:
    """The fitted field: standardisation, emission weights, transitions and the final curve."""

    def __init__(self, mean, scale, weights, move, curve) -> None:
        self.mean, self.scale, self.weights, self.move, self.curve = mean, scale, weights, move, curve

    def shares(self, chains: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted share of good of each chain; 0 for a chain without lines."""
        out = np.zeros(len(chains))
        sizes = np.fromiter((len(x) for x, _ in chains), np.int64, len(chains))
        for ids in _side_by_side(sizes):
            size = sizes[ids]
            score, weight = np.zeros((len(ids), size.max())), np.zeros((len(ids), size.max()))
            for row, i in enumerate(ids):
                score[row, : size[row]] = ((widened(chains[i][0]) - self.mean) * self.scale) @ self.weights
                weight[row, : size[row]] = chains[i][1]
            _, good, _ = forward_backward(score, size, self.move)
            out[ids] = (good * weight).sum(1) / weight.sum(1)
        return out

    def score(self, chains: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return _sigmoid(self.curve[0] + self.curve[1] * self.shares(chains))


def fit(chains: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> LineField:
    """Fits the field to documents' line features and 0/1 labels."""
    used = [i for i, (x, _) in enumerate(chains) if len(x)]
    width = 3 * N_OWN + 3
    share = float(np.mean(labels)) if len(labels) else 0.5
    odds = np.log((share * len(labels) + 1) / ((1 - share) * len(labels) + 1)) if len(labels) else 0.0
    if not used or share in (0.0, 1.0):
        return LineField(np.zeros(width, np.float32), np.ones(width, np.float32), np.zeros(width), np.zeros((2, 2)), (odds, 0.0))
    size = np.array([len(chains[i][0]) for i in used])
    x = np.concatenate([widened(chains[i][0]) for i in used])
    weight = np.concatenate([chains[i][1] for i in used])
    doc = np.repeat(np.arange(len(used)), size)
    y_doc = labels[used].astype(float)
    mean, scale = x.mean(0), 1 / np.maximum(x.std(0), 1e-3)
    mean[-1], scale[-1] = 0, 1
    x = ((x - mean) * scale).astype(np.float64)
    y, per = y_doc[doc], 1.0 / size[doc]
    balance = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) * per

    def line_grad(w):
        return x.T @ (balance * (_sigmoid(x @ w) - y)) / balance.sum() + 1e-4 * w

    w = _adam(line_grad, np.zeros(width), 300, 0.05)
    p = _sigmoid(x @ w)
    worst = np.full(len(used), 2.0)
    np.minimum.at(worst, doc, p)
    line = np.where((y == 0) & (p > 0.5) & (p > worst[doc]), 1.0, y)

    start = np.cumsum(size) - size
    groups = []  # of chains that run side by side: their cells that hold lines, those lines, sizes
    gold = np.zeros((2, 2))
    for ids in _side_by_side(size):
        inside = np.arange(size[ids].max())[None, :] < size[ids][:, None]
        groups.append((inside, np.concatenate([np.arange(start[k], start[k] + size[k]) for k in ids]), size[ids]))
        pos = np.zeros(inside.shape)
        pos[inside] = line[groups[-1][1]]
        np.add.at(gold, (pos[:, :-1][inside[:, 1:]].astype(int), pos[:, 1:][inside[:, 1:]].astype(int)), 1.0)
    total = float(len(line))

    def field_grad(v):
        flat, good, pairs = x @ v[:width], np.empty(len(line)), np.zeros((2, 2))
        for inside, rows, sizes in groups:
            score = np.zeros(inside.shape)
            score[inside] = flat[rows]
            _, marginal, more = forward_backward(score, sizes, v[width:].reshape(2, 2))
            good[rows] = marginal[inside]
            pairs += more
        return np.concatenate([x.T @ (good - line) / total + 1e-4 * v[:width], (pairs - gold).ravel() / total + 1e-3 * v[width:]])

    v = _adam(field_grad, np.concatenate([w, np.zeros(4)]), 80, 0.05)
    field = LineField(mean, scale, v[:width], v[width:].reshape(2, 2), (0.0, 0.0))
    s = np.stack([np.ones(len(used)), field.shares([chains[i] for i in used])])
    curve = _adam(lambda c: s @ (_sigmoid(c @ s) - y_doc) / len(used) + np.array([0, 1e-4]) * c, np.array([-2.0, 4.0]), 1500, 0.05)
    field.curve = (float(curve[0]), float(curve[1]))
    return field


def _remainder(id_col: str, modulus: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, lines: int = LINES) -> LineField:
    """Fits on at most ``sample`` labelled documents whose crc32(id) mod 3 is not 1, each of at most ``lines`` lines.

    The lowest label counts where an id has several, and one of the texts where rows repeat an
    id. Only line features reach the driver. Null ids, labels and texts teach nothing.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (_remainder(id_col, 3) != 1))
    known = known.groupBy(F.col(id_col).alias("lid")).agg(F.min(label_col).cast("int").alias("y")).orderBy(F.xxhash64("lid"), "lid").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 2, ROWS, BYTES):
                got = [chain(t.as_py()) for t in part.column(2)]
                fits = pa.array([len(n) <= lines for _, n in got])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.astype("<f4").tobytes() for x, _ in got], pa.binary()), pa.array([n.astype("<f4").tobytes() for _, n in got], pa.binary())], names=["did", "y", "x", "n"]).filter(fits)

    # the sample is of bounded size, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("did"), F.col(text_col).cast("binary").alias("t")).join(F.broadcast(known), F.col("did") == F.col("lid")).select("did", "y", "t")
    kind = rows.schema["did"].dataType.simpleString()
    seen = rows.mapInArrow(run, f"did {kind}, y int, x binary, n binary").groupBy("did", "y").agg(F.min(F.struct("x", "n")).alias("r"))
    got = seen.select("did", "y", "r.x", "r.n").collect()
    chains = sorted(((r.y, len(r.n), bytes(r.x), bytes(r.n)) for r in got))  # the same order however the rows arrive
    held = [(np.frombuffer(x, "<f4").reshape(-1, N_OWN), np.frombuffer(n, "<f4")) for _, _, x, n in chains]
    return fit(held, np.array([c[0] for c in chains], int))


def scores(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Quality of every row: ``id_col``, held_out, score, predicted.

    Null, empty and blank texts have no lines and score as all bad. Repeated rows and null
    ids (held_out false) stay; an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, ROWS, BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_scored(part.column(1), field))], names=["id", "score"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), (_remainder("id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _scored(texts: pa.Array, field: LineField) -> np.ndarray:
    return field.score([chain(t.as_py()) for t in texts])


def good(docs: DataFrame, field: LineField, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the field predicts to be good (a score of one half or more), with all columns.

    A row's columns go through the worker once, in small parts; its text is read where it
    stands. Null, empty and blank texts go; repeated rows stay or go together.
    """
    d, name = numbered(docs)
    at = d.columns.index(name[text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, at, ROWS, BYTES):
                yield part.filter(pa.array(_scored(part.column(at).cast(pa.binary()), field) >= 0.5))

    return d.mapInArrow(run, d.schema).toDF(*docs.columns)
