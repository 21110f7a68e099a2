"""SentencePiece encoding, decoding, and distinct sampled segmentations.

``encode`` gives the ids of the model file's own merges; ``decode`` gives the text back.
No piece of such a model holds a word start (U+2581) after another character, so a text's
lattice is a row of lattices, one for each run of word starts with what follows; equal runs
of the documents taken together share one lattice. A literal U+2581 in a text, which the
model would take for a space, goes by its bytes, so that decoding gives every text back
exactly.

Sampling is Gumbel top-k without replacement by A* over perturbed log probabilities. A
segmentation's probability is the normalised product of its pieces' weights, which fall
with a piece's rank in the file as 1 / (rank + 10), to the power ``alpha``. The search
starts with the whole document as one region, whose largest perturbed value is a Gumbel
variable. The best segmentation in a region is drawn piece by piece with the backward sums
of the lattice; what it leaves aside at each piece, namely all segmentations that part from
it there, becomes a region with the Gumbel maximum of its mass, cut off at the value of the
region it comes from. Popping regions by value gives distinct segmentations in the order
of their perturbed values; the value that would come next is the threshold from which the
inclusion scores follow: log P(log p + Gumbel > threshold).

Of ``k`` samples no more than the ``k`` highest regions of a path can be popped or be the
threshold, so each path keeps those. Pieces without an alternative leave nothing aside and
are passed over. Masses fall along a path, and a region whose noise can't lift it to the
lowest kept value is told by its random number alone.

Each step is taken for all documents of a group at once, in arrays as long as the group's
text. All random numbers are hashes of (row key, sample, run, step) and all sums are taken
within a document or run, so results don't depend on how rows are grouped.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
START, LITERAL = "▁", "\udfff"  # a lone surrogate, which no text holds, stands for a literal U+2581 meanwhile
RUN = re.compile(f"{START}+[^{START}]*")
SAMPLES, ALPHA, OFFSET = 3, 1.0, 10.0
GROUP, GROUP_BYTES = 384, 800_000  # documents taken together: so many, or the one that passes so many bytes
GOLD = np.uint64(0x9E3779B97F4A7C15)
ALPHABET = 64  # of the trie's dense table
JOINED = 64  # words given to the model at a time
LEARNT = 8  # groups from which a worker takes the words whose lattices it keeps: those that two of them have


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator."""
    x = x + GOLD
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    x = _mixed(key)
    x >>= np.uint64(11)
    u = x.astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return np.minimum(u, 1 - 2.0**-53, out=u)


def _gumbel(key: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(_uniform(key)))


#: The noise of such numbers is at most this, so a region whose log mass is further below can't be reached.
MOST_NOISE = 37.0


def _cut_off(value: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """A Gumbel value made the value of the same variable given that it is at most ``bound``."""
    return -np.logaddexp(-bound, -value)


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers from each ``first``, ``size`` of them, one after the other."""
    stop = np.cumsum(size)
    return np.repeat(first - stop + size, size) + np.arange(int(stop[-1]) if len(stop) else 0)


def _sums(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of each stretch of ``x``; stretches follow one another."""
    return np.add.reduceat(np.append(x, 0.0), np.minimum(start, len(x))) * (size > 0) if len(start) else np.zeros(0)


def _joined(words: pa.Array, n: int, by: str) -> pa.Array:
    """Every ``n`` words that follow one another as one string."""
    cut = np.append(np.arange(0, len(words), n), len(words)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cut), words), by)


class Model:
    """Pieces of a model file and their sampling weights."""

    def __init__(self, path: str = MODEL, alpha: float = ALPHA) -> None:
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte = [0] * 256
        self.table: list[bytes] = []
        self.known: dict[str, int] = {}
        ordinary = 0
        self.weight = np.zeros(n)  # logarithms
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.table.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.table.append(b"")
            else:
                self.table.append(piece.replace(START, " ").encode())
                self.known[piece] = i
                self.weight[i] = -alpha * math.log(ordinary + OFFSET)
                ordinary += 1
        self.unknown = -3 * alpha * math.log(n + OFFSET)
        self.starts = np.array([t[:1] == b" " and not sp.is_byte(i) for i, t in enumerate(self.table)])
        self.bytes = np.frombuffer(b"".join(self.table), np.uint8)
        self.bytes0 = np.cumsum([0, *map(len, self.table)])
        self._plant()

    def _plant(self) -> None:
        """The pieces as a trie: a dense table for the characters of most moves, sorted (state, character) keys for the rest, and each state's piece or -1."""
        states, piece = {"": 0}, [-1]
        moves: list[tuple[int, int, int]] = []
        for text, i in self.known.items():
            for k in range(1, len(text) + 1):
                if text[:k] not in states:
                    states[text[:k]] = len(piece)
                    moves.append((states[text[: k - 1]], ord(text[k - 1]), len(piece)))
                    piece.append(-1)
            piece[states[text]] = i
        state, char, target = np.array(moves, np.int64).reshape(-1, 3).T
        # states with moves come first, so the table has rows for them alone and a walk ends where there is no move
        order = np.argsort(np.bincount(state, minlength=len(piece)) == 0, kind="stable")
        place = np.argsort(order)
        state, target, piece = place[state], place[target], np.array(piece)[order]
        self.inner = int(state.max(initial=0)) + 1
        used, times = np.unique(char, return_counts=True)
        often = used[np.argsort(-times, kind="stable")[: ALPHABET - 1]]
        self.code = np.zeros(0x110000, np.uint8)  # 0: not in the dense table
        self.code[often] = np.arange(1, len(often) + 1)
        self.dense = np.full(self.inner * ALPHABET, -1, np.int32)
        at = self.code[char]
        self.dense[(state * ALPHABET + at)[at > 0]] = target[at > 0]
        key = (state << 21 | char)[at == 0]
        order = np.argsort(key)
        self.moves, self.target = np.append(key[order], -1), np.append(target[at == 0][order], -1)
        self.piece = np.array([*piece, -1], np.int32)  # the last for no state
        self.longest = max(map(len, self.known))

    def runs(self, text: str) -> list[str]:
        if not text:
            return []
        if START in text:
            text = text.replace(START, LITERAL)
        return RUN.findall(START + text.replace(" ", START))

    def own_ids(self, runs: list[str]) -> list[list[int]]:
        """The model's ids of runs; a literal word start goes by its bytes."""
        return [[self.known[START]] if r == START else self._mixed_ids(r) if LITERAL in r else self.processor.encode(r[1:].replace(START, " "), num_threads=1) for r in runs]

    def own_ids_of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs that are one word start and a word: one after the other, and how many each has.

        Words are encoded many at a time; a run's first id is the only one of a piece that starts with a word start.
        """
        flat = np.fromiter(chain.from_iterable(self.processor.encode(_joined(words, JOINED, " ").to_pylist(), num_threads=1)), np.int32)
        return flat, np.diff(np.append(np.flatnonzero(self.starts[flat]), len(flat)))

    def _mixed_ids(self, run: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(run.split(LITERAL)):
            if k:
                out += self.of_char(LITERAL)
                if part:  # without the word start that the processor puts before it
                    ids, start = self.processor.encode("\u0001" + part, num_threads=1), self.processor.encode("\u0001", num_threads=1)
                    out += ids[len(start) :]
            elif part != START:
                out += self.processor.encode(part[1:].replace(START, " "), num_threads=1)
            elif part:
                out.append(self.known[START])
        return out

    def of_char(self, c: str) -> list[int]:
        return [self.byte[b] for b in (START if c == LITERAL else c).encode()]

    def decode(self, ids) -> str:
        """The text of ids, without the space that stands for the start of the text."""
        ids = np.asarray(ids, np.int64)
        raw = self.bytes[spans(self.bytes0[ids], self.bytes0[ids + 1] - self.bytes0[ids])].tobytes()
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.own_ids(self.runs(text)) for i in ids]


class Lattices:
    """Lattices of runs, as arrays: a node for each place in a run, its edges together, the longest first.

    ``cum`` holds, for each edge, the probability of it and the edges before it at its node:
    an edge is drawn by walking a node's few edges.
    """

    NODES, EDGES = ("left", "count"), ("step", "id", "logp", "cum")

    def __init__(self, model: Model) -> None:
        self.model, self.held = model, None
        self.groups, self.seen, self.kept, self.later = 0, Counter(), None, None

    def numbers(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Each document's runs by number; lattices of these runs take the place of those before."""
        of = {r: i for i, r in enumerate(dict.fromkeys(r for d in docs for r in d))}
        if list(of) != self.held or len(self.words):
            self.build(pa.array([], pa.string()), list(of))
        return [np.fromiter(map(of.__getitem__, d), np.int64, len(d)) for d in docs]

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of texts without nulls: their numbers one after the other, how many each text has, and the order in which the texts are taken."""
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, START)), pc.or_(pc.starts_with(texts, " "), pc.or_(pc.ends_with(texts, " "), pc.equal(texts, ""))))
        odd = odd.to_numpy(zero_copy_only=False)
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        words = pc.split_pattern(texts.take(pa.array(plain)), " ")
        coded = words.flatten().dictionary_encode()
        known = coded.dictionary
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        fresh, self.kept = known, self.later
        if self.kept:
            old = pc.fill_null(pc.index_in(known, value_set=self.kept["words"]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            new = old < 0
            fresh, n_kept = known.filter(pa.array(new)), len(self.kept["words"])
            old[new] = n_kept + np.arange(len(fresh))
            at, known = old[at], pa.concat_arrays([self.kept["words"], fresh])
        whole = [self.model.runs(t) for t in texts.take(pa.array(rest)).to_pylist()]
        more = list(dict.fromkeys(chain.from_iterable(whole)))
        if more:
            of = {r: len(known) + i for i, r in enumerate(more)}
            at = np.concatenate([at, np.fromiter((of[r] for d in whole for r in d), np.int64)])
        self._learn(known)
        self.build(fresh, more)
        if self.kept:
            self._add_kept(known)
        size = np.concatenate([pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64), np.fromiter(map(len, whole), np.int64, len(whole))])
        return at, size, np.concatenate([plain, rest])

    def _learn(self, words: pa.Array) -> None:
        """Counts the words of the first groups, and after these builds the lattices of those that recur, to be kept; only the time taken depends on them."""
        if self.groups > LEARNT:
            return
        if self.groups < LEARNT:
            self.seen.update(words.to_pylist())
        else:
            self.build(pa.array([w for w, n in self.seen.items() if n > 1], pa.string()), [])
            self.later = {c: getattr(self, c) for c in ("words", "first", "edge0", "src", "own", "own0", *self.NODES, *self.EDGES)}
            self.seen.clear()
        self.groups += 1

    def _add_kept(self, words: pa.Array) -> None:
        """Puts the lattices that are kept before those just built."""
        kept = self.kept
        nodes, edges, own = len(kept["left"]), len(kept["step"]), len(kept["own"])
        for c in (*self.NODES, *self.EDGES, "own"):
            setattr(self, c, np.concatenate([kept[c], getattr(self, c)]))
        for c, by in (("first", nodes), ("src", nodes), ("edge0", edges)):
            setattr(self, c, np.concatenate([kept[c], getattr(self, c) + by]))
        self.own0 = np.concatenate([kept["own0"][:-1], self.own0 + own])
        self.words = words

    def build(self, words: pa.Array, runs: list[str]) -> None:
        """Builds the lattices of words (each with a word start before it) and other runs at once: a walk of the trie from all places, then sums from the ends."""
        model = self.model
        self.words, self.held = words, runs
        n_words = len(words)
        own, n_own = model.own_ids_of_words(words)
        more = model.own_ids(runs)
        n_own = np.concatenate([n_own, np.fromiter(map(len, more), np.int64, len(more))])
        self.own = np.concatenate([own, np.fromiter(chain.from_iterable(more), np.int32)])
        self.own0 = np.append(0, np.cumsum(n_own))
        size = np.concatenate([pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1, np.fromiter(map(len, runs), np.int64, len(runs))])
        # a character for each node: the run's, and one that is not looked at for its end
        nodes = START + _joined(words, n_words, "\0" + START)[0].as_py() + "\0" if n_words else ""
        nodes += "".join(chain.from_iterable(zip(runs, repeat("\0"))))
        chars = np.frombuffer((nodes + "\0" * model.longest).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.first = np.cumsum(size + 1) - size - 1
        n = len(nodes)
        self.left = left = (np.repeat(self.first + size, size + 1) - np.arange(n)).astype(np.int32)
        places = np.flatnonzero(left > 0)
        codes = model.code[chars]
        found: list[tuple[np.ndarray, np.ndarray]] = []  # of each length: nodes and pieces
        count = np.zeros(n, np.int32)
        at, state = places, np.zeros(len(places), np.int64)
        for k in range(1, model.longest + 1):
            c = codes[at + (k - 1)]
            to = model.dense[state * ALPHABET + c] if k > 1 else model.dense[c]
            rare = np.flatnonzero(c == 0)
            if len(rare):
                key = state[rare] << 21 | chars[at[rare] + (k - 1)]
                i = np.searchsorted(model.moves[:-1], key)
                to[rare] = np.where(model.moves[i] == key, model.target[i], -1)
            piece = model.piece[to]
            if k == 1:
                piece = np.where(piece < 0, -1 - chars[at].astype(np.int64), piece).astype(np.int32)  # a character without a piece
                hit = slice(None)
            else:
                hit = np.flatnonzero(piece >= 0)
            found.append((at[hit], piece[hit]))
            count[found[-1][0]] += 1
            on = np.flatnonzero((to.view(np.uint32) < model.inner) & (left[at] > k))
            at, state = at[on], to[on].astype(np.int64)
            if not len(at):
                break
        self.count = count
        self.edge0 = edge0 = np.cumsum(count, dtype=np.int64) - count
        m = int(count.sum())
        self.step, self.id, self.src = np.empty(m, np.int32), np.empty(m, np.int32), np.repeat(np.arange(n), count)
        filled = edge0.copy()
        for k in range(len(found), 0, -1):
            node, piece = found[k - 1]
            place = filled[node]
            self.step[place], self.id[place] = k, piece
            filled[node] += 1
        weight = np.where(self.id >= 0, model.weight[np.maximum(self.id, 0)], model.unknown)
        beta = np.zeros(n)
        deep = int(size.max(initial=0))
        order = np.argsort(left.astype(np.int16) if deep < 1 << 15 else left, kind="stable")
        bounds = np.searchsorted(left[order], np.arange(1, deep + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            nodes = order[a:b]
            if not len(nodes):
                continue
            each = count[nodes]
            e = spans(edge0[nodes], each)
            x = weight[e] + beta[np.repeat(nodes, each) + self.step[e]]
            cut = np.cumsum(each) - each
            top = np.maximum.reduceat(x, cut)
            x -= np.repeat(top, each)
            beta[nodes] = top + np.log(np.add.reduceat(np.exp(x, out=x), cut))
        self.logp = np.minimum(weight + beta[self.src + self.step] - beta[self.src], 0.0)
        self.logp[edge0[count == 1]] = 0.0
        p = np.exp(self.logp)
        self.cum, run = np.empty(m), np.zeros(n)
        nodes = places
        for k in range(int(count.max(initial=0))):
            nodes = nodes[count[nodes] > k]
            e = edge0[nodes] + k
            run[nodes] += p[e]
            self.cum[e] = run[nodes]
        self.cum[edge0[places] + count[places] - 1] = 1.0

    def draw(self, nodes: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segmentations from nodes to the ends of their runs: edges in order, and how many for each node."""
        count = np.zeros(len(nodes), np.int64)
        rows = np.flatnonzero(self.left[nodes] > 0)
        node, key, taken, turn = nodes[rows], key[rows], [], 0
        while len(rows):
            u = _uniform(key + np.uint64(turn << 1))
            edge = self.edge0[node]
            more = np.flatnonzero(u > self.cum[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] > self.cum[edge[more]]]
            taken.append((rows, edge))
            count[rows] += 1
            node = node + self.step[edge]
            on = np.flatnonzero(self.left[node] > 0)
            rows, node, key = rows[on], node[on], key[on]
            turn += 1
        base = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for t, (rows, edge) in enumerate(taken):
            out[base[rows] + t] = edge
        return out, count

    def flat_ids(self, edges: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of paths that follow one another, ``size`` edges each, and how many each has; characters without a piece become their bytes."""
        ids = self.id[edges]
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, size
        times = np.ones(len(ids), np.int64)
        chars, which = np.unique(-1 - ids[odd], return_inverse=True)
        parts = [self.model.of_char(chr(c)) for c in chars.tolist()]
        times[odd] = np.array([len(p) for p in parts])[which]
        stop = np.cumsum(times)
        out = np.repeat(ids, times)
        where = (stop - times)[odd]
        for k in range(max(map(len, parts))):
            has = np.array([len(p) > k for p in parts])[which]
            out[where[has] + k] = np.array([p[k] if len(p) > k else 0 for p in parts], np.int32)[which[has]]
        ends = np.cumsum(size)
        total = np.append(0, stop)
        return out, total[ends] - total[ends - size]

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Ids of one path."""
        return self.flat_ids(edges, np.array([len(edges)]))[0]

    def own_of(self, runs: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The model's own ids of documents (stretches of ``runs``), and how many each has."""
        each = self.own0[runs + 1] - self.own0[runs]
        total = np.append(0, np.cumsum(each))
        return self.own[spans(self.own0[runs], each)], total[start + size] - total[start]

    def faithful(self) -> np.ndarray:
        """For each run, whether its own ids decode to it."""
        model, n = self.model, len(self.words)
        each = model.bytes0[self.own + 1] - model.bytes0[self.own]
        got = model.bytes[spans(model.bytes0[self.own], each)]
        stop = np.append(0, np.cumsum(each))[self.own0]
        text = got.tobytes()
        want = b" " + _joined(self.words, n, " ")[0].as_buffer().to_pybytes() if n else b""
        out = np.ones(len(stop) - 1, bool)
        out[:n] = got[stop[:n]] == 32  # words hold no space, so equal texts with spaces at the starts have equal words
        if text[: stop[n]] != want:
            parts = [b" " + w for w in want[1:].split(b" ")]
            out[:n] = [text[a:b] == w for a, b, w in zip(stop[:n].tolist(), stop[1 : n + 1].tolist(), parts, strict=True)]
        for i, r in enumerate(self.held):
            out[n + i] = text[stop[n + i] : stop[n + i + 1]] == r.replace(START, " ").replace(LITERAL, START).encode()
        return out


def _keys(seed: np.ndarray, sample: int, run: np.ndarray) -> np.ndarray:
    return _mixed(seed + np.uint64(sample) * GOLD) ^ (run.astype(np.uint64) << np.uint64(24))


HEAD, BLOCK = 24, 128  # pieces with alternatives looked at first, and then at a time


class Regions:
    """The highest regions of each document's paths: ``keep`` of each of ``paths`` paths.

    Columns of a document's row: value, place in the path, edge taken there, log mass before it
    and run. ``used`` holds the edges at that node that are no longer in the region.
    """

    def __init__(self, n: int, paths: int, keep: int) -> None:
        self.keep = keep
        self.value = np.full((n, paths * keep), -np.inf)
        self.place, self.run = np.zeros((2, n, paths * keep), np.int64)
        self.node = np.zeros((n, paths * keep), np.int64)
        self.before = np.zeros((n, paths * keep))
        self.used = np.full((n, paths * keep, paths + 1), -1, np.int64)
        self.n_used = np.ones((n, paths * keep), np.int64)

    def add(self, lat: Lattices, path: int, docs: np.ndarray, edges: np.ndarray, size: np.ndarray, run: np.ndarray, low: np.ndarray, before: np.ndarray, bound: np.ndarray, seeds: np.ndarray) -> None:
        """The regions that part from paths at ``edges``, ``size`` of each of ``docs``, the first at place ``low`` with log mass ``before``."""
        lp = lat.logp[edges]
        fork = np.flatnonzero(lp < -1e-12)
        start = np.cumsum(size) - size
        cut = np.append(np.searchsorted(fork, start), len(fork))
        first, count = cut[:-1], np.diff(cut)
        here = np.flatnonzero(count > 0)
        if not len(here):
            return
        lp, place = lp[fork], (fork - np.repeat(start - low, count))
        first, count, bound, carry = first[here], count[here], bound[here], before[here]
        base = _mixed(seeds[docs[here]] + np.uint64(path) * GOLD)

        def block(rows: np.ndarray, at: int, width: int):
            column = np.arange(at, at + width)
            inside = column < count[rows, None]
            i = np.minimum(first[rows, None] + column, len(lp) - 1)
            part = np.where(inside, lp[i], 0.0)
            total = carry[rows, None] + np.cumsum(part, 1)
            key = base[rows, None] ^ (place[i].astype(np.uint64) << np.uint64(24)) ^ np.uint64(1 << 62)
            return i, inside, part, total - part, total[:, -1], key

        keep = self.keep
        width = max(HEAD, 2 * keep)
        all_rows = np.arange(len(here))
        i, inside, part, ahead, last, key = block(all_rows, 0, width)
        with np.errstate(divide="ignore"):
            value = _cut_off(ahead + np.log(-np.expm1(part)) + _gumbel(key), bound[:, None])
        value[~inside] = -np.inf
        best = np.argpartition(-value, keep - 1, axis=1)[:, :keep]
        top, which, mass = (np.take_along_axis(x, best, 1) for x in (value, i, ahead))
        carry = last.copy()
        at = width

        def needed() -> np.ndarray:
            """What a region's mass and noise must reach to be among the kept."""
            bar = top.min(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(bar == -np.inf, -np.inf, bar - np.log(-np.expm1(np.minimum(bar - bound, -1e-300))))

        need = needed()
        rows = np.flatnonzero((count > at) & (carry + MOST_NOISE >= need))
        while len(rows):
            i, inside, part, ahead, last, key = block(rows, at, BLOCK)
            u = _uniform(key)
            with np.errstate(over="ignore"):
                # the noise is at most -log(1 - u)
                r, c = np.nonzero(inside & ((1 - u) <= np.exp(ahead - need[rows, None]) * (1 + 1e-9)))
            if len(r):
                value = _cut_off(ahead[r, c] + np.log(-np.expm1(part[r, c])) - np.log(-np.log(u[r, c])), bound[rows[r]])
                new, nth = np.unique(r, return_inverse=True)
                each = np.bincount(nth)
                column = np.arange(len(r)) - np.repeat(np.cumsum(each) - each, each) + keep
                wide = np.full((len(new), keep + int(each.max())), -np.inf)
                wide_i, wide_m = np.zeros(wide.shape, np.int64), np.zeros(wide.shape)
                own = rows[new]
                wide[:, :keep], wide_i[:, :keep], wide_m[:, :keep] = top[own], which[own], mass[own]
                wide[nth, column], wide_i[nth, column], wide_m[nth, column] = value, i[r, c], ahead[r, c]
                best = np.argpartition(-wide, keep - 1, axis=1)[:, :keep]
                top[own], which[own], mass[own] = (np.take_along_axis(x, best, 1) for x in (wide, wide_i, wide_m))
                need = needed()
            carry[rows] = last
            at += BLOCK
            rows = rows[(count[rows] > at) & (carry[rows] + MOST_NOISE >= need[rows])]
        d, cols = docs[here][:, None], path * keep + np.arange(keep)
        self.value[d, cols], self.before[d, cols] = top, mass
        taken = fork[which]
        self.place[d, cols], self.run[d, cols], self.node[d, cols] = place[which], run[taken], lat.src[edges[taken]]
        self.used[d, cols, 0] = edges[taken]


class Sampled:
    """Paths of documents: ``edges[start[d, r] :][: size[d, r]]`` is sample r of document d where ``log_prob`` is a number; ``value`` is its perturbed value."""

    def __init__(self, lat: Lattices, runs: np.ndarray, size: np.ndarray, seeds: np.ndarray, k: int) -> None:
        with np.errstate(over="ignore"):
            self._draw(lat, runs, size, seeds, k)

    def _draw(self, lat: Lattices, runs: np.ndarray, size: np.ndarray, seeds: np.ndarray, k: int) -> None:
        n = len(size)
        run0 = np.cumsum(size) - size
        within = np.arange(len(runs)) - np.repeat(run0, size)
        self.start, self.size = np.zeros((2, n, k), np.int64)
        self.log_prob, self.value = np.full((n, k), np.nan), np.full((n, k), np.nan)
        self.edges, count = lat.draw(lat.first[runs], _keys(np.repeat(seeds, size), 0, within))
        path_run = np.repeat(within, count)
        total = np.append(0, np.cumsum(count))
        self.start[:, 0], self.size[:, 0] = total[run0], total[run0 + size] - total[run0]
        some = size > 0
        self.value[some, 0] = _gumbel(_mixed(seeds ^ np.uint64(0x5555)))[some]
        self.log_prob[some, 0] = _sums(lat.logp[self.edges], self.start[:, 0], self.size[:, 0])[some]
        regions = Regions(n, k, k)
        regions.add(lat, 0, np.arange(n), self.edges, self.size[:, 0], path_run, np.zeros(n, np.int64), np.zeros(n), self.value[:, 0], seeds)
        for r in range(1, k):
            best = regions.value.argmax(1)
            d = np.flatnonzero(regions.value[np.arange(n), best] > -np.inf)
            if not len(d):
                break
            c = best[d]
            value, node, at, before, run = (x[d, c] for x in (regions.value, regions.node, regions.place, regions.before, regions.run))
            pick, rest = self._other(lat, regions, d, c, node, _uniform(_keys(seeds[d], r, at) ^ np.uint64(1 << 61)))
            with np.errstate(divide="ignore"):
                left = _cut_off(before + np.log(rest) + _gumbel(_keys(seeds[d], r, at) ^ np.uint64(1 << 60)), value)
            regions.value[d, c] = np.where(rest > 1e-15, left, -np.inf)
            entries = size[d] - run
            own = spans(run0[d] + run, entries)
            nodes = lat.first[runs[own]]
            nodes[np.cumsum(entries) - entries] = node + lat.step[pick]
            tail, count = lat.draw(nodes, _keys(np.repeat(seeds[d], entries), r, within[own]))
            total = np.append(0, np.cumsum(count))
            ends = np.cumsum(entries)
            more = total[ends] - total[ends - entries]
            tail_run = np.repeat(within[own], count)
            # the path: what it shares with the one it parts from, the other edge, the rest
            length = at + 1 + more
            base = np.cumsum(length) - length
            path, which = np.empty((2, int(length.sum())), np.int64)
            shared = spans(self.start[d, c // k], at)
            head = spans(base, at)
            path[head], which[head] = self.edges[shared], path_run[shared]
            path[base + at], which[base + at] = pick, run
            behind = spans(base + at + 1, more)
            path[behind], which[behind] = tail, tail_run
            self.start[d, r], self.size[d, r] = len(self.edges) + base, length
            self.log_prob[d, r], self.value[d, r] = _sums(lat.logp[path], base, length), value
            self.edges, path_run = np.concatenate([self.edges, path]), np.concatenate([path_run, which])
            regions.add(lat, r, d, tail, more, tail_run, at + 1, before + lat.logp[pick], value, seeds)
        self.threshold = regions.value.max(1) if n else np.zeros(0)

    @staticmethod
    def _other(lat: Lattices, regions: Regions, d: np.ndarray, c: np.ndarray, node: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An edge of each node drawn from those still in the region, and the probability of the others that are; the edge leaves the region."""
        first, count = lat.edge0[node], lat.count[node]
        column = np.arange(int(count.max()))
        e = np.minimum(first[:, None] + column, len(lat.logp) - 1)
        p = np.where(column < count[:, None], np.exp(lat.logp[e]), 0.0)
        for k in range(int(regions.n_used[d, c].max())):
            p[e == regions.used[d, c, k, None]] = 0.0
        run = np.cumsum(p, 1)
        last = len(column) - 1 - (p[:, ::-1] > 0).argmax(1)
        pick = np.minimum((run <= (u * run[:, -1])[:, None]).sum(1), last)
        at = np.arange(len(d))
        p[at, pick] = 0.0
        regions.used[d, c, regions.n_used[d, c]] = first + pick
        regions.n_used[d, c] += 1
        return first + pick, p.sum(1)


def sample(lat: Lattices, docs: list[np.ndarray], seeds: np.ndarray, k: int) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
    """For each document (run numbers): up to ``k`` distinct (edges, log probability, perturbed value) by falling value, and the value that would come next."""
    got = Sampled(lat, np.concatenate([*docs, np.zeros(0, np.int64)]), np.fromiter(map(len, docs), np.int64, len(docs)), seeds, k)
    return [([(got.edges[a : a + n], float(lp), float(v)) for a, n, lp, v in zip(got.start[d], got.size[d], got.log_prob[d], got.value[d], strict=True) if lp == lp], float(got.threshold[d])) for d in range(len(docs))]


def log_inclusion(log_prob: float, threshold: float) -> float:
    """Log of the probability that a perturbed log probability passes the threshold."""
    x = log_prob - threshold
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0)))) if x < 5 else 0.0


def digest(ids) -> str:
    return hashlib.sha256(np.ascontiguousarray(ids, "<i4")).hexdigest()


def _digests(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    stop = np.cumsum(size)
    flat = np.ascontiguousarray(flat, "<i4")
    return pa.array([hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip((stop - size).tolist(), stop.tolist(), strict=True)], pa.string())


def _lists(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat, pa.int32()))


SAMPLE_TYPE = "array<struct<n_pieces:int,log_prob:double,perturbed:double,log_inclusion:double,ids_sha256:string,ids:array<int>>>"


def _encoded(part: pa.RecordBatch, lat: Lattices, samples: int, with_ids: bool, with_sample_ids: bool) -> pa.RecordBatch:
    """The result rows of a group."""
    runs, size, order = lat.of_texts(pc.fill_null(part.column(2), ""))
    part = part.take(pa.array(order))
    seeds = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    start = np.cumsum(size) - size
    own, n_own = lat.own_of(runs, start, size)
    good = np.append(0, np.cumsum(lat.faithful()[runs]))
    got = Sampled(lat, runs, size, seeds, samples)
    d, r = np.nonzero(got.log_prob == got.log_prob)  # by document, then by falling value
    n_edges = got.size[d, r]
    drawn, n_drawn = lat.flat_ids(got.edges[spans(got.start[d, r], n_edges)], n_edges)
    lp = got.log_prob[d, r]
    inclusion = [log_inclusion(a, b) for a, b in zip(lp.tolist(), got.threshold[d].tolist(), strict=True)]
    fields = {
        "n_pieces": pa.array(n_drawn, pa.int32()),
        "log_prob": pa.array(lp),
        "perturbed": pa.array(got.value[d, r]),
        "log_inclusion": pa.array(inclusion, pa.float64()),
        "ids_sha256": _digests(drawn, n_drawn),
        "ids": _lists(drawn, n_drawn) if with_sample_ids else pa.nulls(len(d), pa.list_(pa.int32())),
    }
    inner = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    each = np.append(0, np.cumsum(np.bincount(d, minlength=len(size)))).astype(np.int32)
    out = {
        "id": part.column(0),
        "n_pieces": pa.array(n_own, pa.int32()),
        "ids_sha256": _digests(own, n_own),
        "decoded": pa.array(good[start + size] - good[start] == size),
        "samples": pa.ListArray.from_arrays(pa.array(each), inner),
        "ids": _lists(own, n_own) if with_ids else pa.nulls(len(size), pa.list_(pa.int32())),
    }
    return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


@cache
def _lattices(model: str, alpha: float) -> Lattices:
    """A worker's own, for all its tasks."""
    return Lattices(Model(model, alpha))


def segmented(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, samples: int = SAMPLES, alpha: float = ALPHA, with_ids: bool = True, with_sample_ids: bool = False) -> DataFrame:
    """Ids and sampled segmentations of every row, whole.

    Returns ``id_col``, n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers),
    decoded (whether decoding gives the text back), samples, by falling perturbed value, and
    ids. Without ``with_ids``, and ``with_sample_ids`` for the samples, id arrays are null.

    Null is an empty text: no pieces, no samples, decoded true. A text with fewer than
    ``samples`` segmentations returns all of them, each with log_inclusion 0. Rows with equal
    ids and texts have equal results; null ids share one seed. A very long text is a group of
    its own, with memory in proportion to its length. An empty table gives no rows. Other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lat = _lattices(model, alpha)
            for part in slices(b, 2, GROUP, GROUP_BYTES):
                yield _encoded(part, lat, samples, with_ids, with_sample_ids)

    out = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("seed"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_pieces int, ids_sha256 string, decoded boolean, samples {SAMPLE_TYPE}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``rows`` with a column ``text_col`` of the decoded ids; null ids give null, no ids an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            own = own or Model(model)
            k = b.schema.get_field_index("__ids")
            texts = [None if x is None else own.decode(x) for x in b.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(b.columns) if i != k], pa.array(texts, pa.string())], names=[*[n for n in b.schema.names if n != "__ids"], text_col])

    kept = [F.col(c) for c in rows.columns if c != text_col]
    frame = rows.select(*kept, F.col(ids_col).alias("__ids"))
    schema = ", ".join([*(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in frame.columns if c != "__ids"), f"`{text_col}` string"])
    return frame.mapInArrow(run, schema)
