"""Token counts that follow edits.

A document is kept as its pre-tokens, ``LEAF`` to a leaf, under a binary tree whose nodes
hold the characters and tokens below them. An edit replaces a stretch of characters: the
tree finds its leaves by character sums; pre-tokens are cut anew from a little before the
edit (a pre-token looks at most ``AHEAD`` characters past its end, so those that end
earlier stand) until a new cut falls on an old one after the edit, from where all old cuts
stand; only new pre-tokens are encoded, and only the sums above touched leaves change.

What is kept between runs is a column beside the text (``tree``): the characters and tokens
of each pre-token. ``planted`` makes it, ``edited_counts`` takes it up and gives it back, and
no run after the first encodes anything but the regions that edits touch.

Pre-tokens are what the byte-pair vocabulary merges within, so a document's token count is
the sum of its pre-tokens' counts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import slices

#: The public pattern that splits text before the merges of the byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF, AHEAD = 64, 3
KEPT, KEPT_LENGTH = 400_000, 40  # counts remembered by a task, of pre-tokens of at most so many characters
ROWS, BYTES = 1024, 1 << 20  # texts counted at a time


class Counts(dict):
    """Tokens of a pre-token, remembered; forgets everything when full."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._cut = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        n = len(self._encode(piece))
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = n
        return n

    def cut(self, text: str) -> list[str]:
        return self._cut.findall(text)

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self._cut.findall(text)))


def packed(chars: np.ndarray, tokens: np.ndarray) -> bytes:
    """The ``tree`` column: two rows of numbers, of two bytes each where they fit, else of four."""
    wide = int(max(chars.max(initial=0), tokens.max(initial=0))) >> 16 > 0
    return bytes([wide]) + np.stack([chars, tokens]).astype("<u4" if wide else "<u2").tobytes()


def unpacked(tree: bytes) -> tuple[np.ndarray, np.ndarray]:
    chars, tokens = np.frombuffer(tree, "<u4" if tree[0] else "<u2", offset=1).astype(np.int64).reshape(2, -1)
    return chars, tokens


class Counted:
    """One document's pre-tokens under a tree of sums; ``tree`` as it was kept, or else the text is cut and encoded."""

    def __init__(self, text: str, counts: Counts, tree: bytes | None = None) -> None:
        self.counts, self.encoded = counts, 0
        chars, tokens = unpacked(tree) if tree else (np.zeros(0, np.int64),) * 2
        if tree is None or int(chars.sum()) != len(text):  # not kept, or not of this text
            pieces = counts.cut(text)
            self.encoded = len(pieces)
            chars, tokens = (np.fromiter(x, np.int64, len(pieces)) for x in (map(len, pieces), map(counts.__getitem__, pieces)))
        self._plant(text, chars, tokens)

    def _plant(self, text: str, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Leaves over the pre-tokens of ``text``; a leaf's strings are cut out when an edit comes to it."""
        self._text, self._chars, self._tokens = text, chars, tokens
        n = max(1, -(-len(chars) // LEAF))
        self.leaves: list[tuple[list[str], list[int]] | None] = [None] * n
        self.base = 1 << (n - 1).bit_length()
        at = np.arange(0, max(len(chars), 1), LEAF)
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for sums, x in ((self.chars, chars), (self.tokens, tokens)):
            sums[self.base : self.base + n] = (np.add.reduceat(x, at) if len(x) else np.zeros(1, np.int64)).tolist()
        self._sum_up()
        self._starts = np.append(0, np.cumsum(chars))

    def _sum_up(self) -> None:
        for i in range(self.base - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def leaf(self, i: int) -> tuple[list[str], list[int]]:
        """Pre-tokens and their tokens under leaf ``i``."""
        if self.leaves[i] is None:
            low, high = i * LEAF, min((i + 1) * LEAF, len(self._chars))
            cut = self._starts[low : high + 1].tolist()
            self.leaves[i] = ([self._text[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], self._tokens[low:high].tolist())
        return self.leaves[i]

    def text(self) -> str:
        return "".join("".join(self.leaf(i)[0]) for i in range(len(self.leaves)))

    def tree(self) -> bytes:
        parts = [self.leaf(i) for i in range(len(self.leaves))]
        chars = [len(p) for ps, _ in parts for p in ps]
        return packed(np.array(chars, np.int64), np.array([t for _, ts in parts for t in ts], np.int64))

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at`` (the last one, past the end), and the characters before it."""
        i, before = 1, 0
        while i < self.base:
            i *= 2
            if at - before >= self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.base, before

    def _set(self, leaf: int, pieces: list[str], tokens: list[int]) -> None:
        self.leaves[leaf] = (pieces, tokens)
        i = self.base + leaf
        self.chars[i], self.tokens[i] = sum(map(len, pieces)), sum(tokens)
        while i > 1:
            i //= 2
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from ``start`` up to ``end`` by ``new``; both are brought into the text's range.

        Takes time in proportion to what is cut anew (a little more than ``new``) and to the
        leaves that it empties, and the logarithm of the document's length.
        """
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        if start == end and not new:
            return
        first, before = self._leaf_at(max(0, start - AHEAD))
        while first and not self._stands_before(first, before, start):  # all of this leaf may change, so its first piece has an earlier start
            first -= 1
            before -= self.chars[self.base + first]
        pieces, tokens = self.leaf(first)
        i, at = 0, before
        while i < len(pieces) and at + len(pieces[i]) + AHEAD <= start:
            at += len(pieces[i])
            i += 1
        head, head_tokens = pieces[:i], tokens[:i]
        # the text before the edit that is cut anew
        k, pos, ahead = first, at, []
        rest = pieces[i:]
        while pos < start:
            for p in rest:
                ahead.append(p[: start - pos])
                pos += len(ahead[-1])
                if pos == start:
                    break
            else:
                k += 1
                rest = self.leaf(k)[0]
        # old pre-tokens behind the edit, first those of its leaf, then more until a new cut meets an old one
        here, reached = self._leaf_at(end)
        old: list[str] = []
        old_tokens: list[int] = []
        more, nxt = 1, here
        base = at + len("".join(ahead)) + len(new)  # where the text behind the edit starts, after it
        while True:
            for _ in range(more):
                if nxt < len(self.leaves):
                    p, t = self.leaf(nxt)
                    old += p
                    old_tokens += t
                    nxt += 1
            more *= 2
            last = nxt >= len(self.leaves)
            behind = "".join(old)[end - reached :]
            cuts, p = {}, reached
            for j, piece in enumerate(old):
                if p >= end:
                    cuts[base + p - end] = j
                p += len(piece)
            text = "".join(ahead) + new + behind
            taken, p, met = [], at, None
            for piece in self.counts.cut(text):
                if p in cuts:
                    met = cuts[p]
                    break
                if not last and p + len(piece) + AHEAD > at + len(text):
                    break  # this cut may depend on text that isn't here yet
                taken.append(piece)
                p += len(piece)
            else:
                met = len(old) if last else None
            if met is not None:
                break
        self.encoded += len(taken)
        pieces = head + taken + old[met:]
        tokens = head_tokens + list(map(self.counts.__getitem__, taken)) + old_tokens[met:]
        if len(pieces) > 8 * LEAF:  # a large insertion: leaves are dealt anew from known counts
            whole, known = [], []
            for j in range(len(self.leaves)):
                if j == first:
                    whole += pieces
                    known += tokens
                elif not first < j < nxt:
                    a, b = self.leaf(j)
                    whole += a
                    known += b
            self._plant("".join(whole), np.fromiter(map(len, whole), np.int64, len(whole)), np.array(known, np.int64))
            return
        if nxt - first > LEAF:
            for j in range(first + 1, nxt):
                self.leaves[j] = ([], [])
                self.chars[self.base + j] = self.tokens[self.base + j] = 0
            self._sum_up()
        else:
            for j in range(first + 1, nxt):
                self._set(j, [], [])
        self._set(first, pieces, tokens)

    def _stands_before(self, leaf: int, before: int, start: int) -> bool:
        pieces = self.leaf(leaf)[0]
        return bool(pieces) and before + len(pieces[0]) + AHEAD <= start


EDITS = "array<struct<start:bigint,end:bigint,new:string>>"


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every row's ``id_col``, ``text_col``, n_pieces, n_tokens and ``tree``, what is kept of it; with its edits if ``edits_col`` is given.

    A null text is an empty one. Repeated rows and null ids stay; an empty table gives no rows.
    Other columns aren't read.
    """
    edits = F.col(edits_col) if edits_col else F.lit(None)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"), edits.cast(EDITS).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for b in batches:
            counts = counts or Counts(vocabulary)
            for part in slices(b, 1, ROWS, BYTES):
                n, total, trees = [], [], []
                for text in part.column(1).to_pylist():
                    pieces = counts.cut(text)
                    chars, tokens = (np.fromiter(x, np.int64, len(pieces)) for x in (map(len, pieces), map(counts.__getitem__, pieces)))
                    n.append(len(pieces))
                    total.append(int(tokens.sum()))
                    trees.append(packed(chars, tokens))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64()), pa.array(total, pa.int64()), pa.array(trees, pa.binary())], names=["id", "t", "e", "n_pieces", "n_tokens", "tree"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, t string, e {EDITS}, n_pieces long, n_tokens long, tree binary")
    out = out.withColumnsRenamed({"id": id_col, "t": text_col})
    return out.withColumnRenamed("e", edits_col) if edits_col else out.drop("e")


def edited_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", tree_col: str | None = None, vocabulary: str = VOCABULARY, with_state: bool = False) -> DataFrame:
    """Tokens of every row before and after its edits.

    ``edits_col`` is an array of (start, end, new), applied in order, each to the text as
    the ones before left it; positions count characters from 0. ``tree_col`` is what
    ``planted`` or an earlier run kept; a row where it is null, or is not of this text, is cut
    and encoded whole. Returns ``id_col``, n_pieces, n_tokens, n_edits, n_chars_after,
    n_tokens_after and n_reencoded, the pre-tokens encoded for the edits. ``with_state`` adds
    n_planted, the pre-tokens encoded because no tree was kept, and ``text_col`` and ``tree``
    after the edits, for a later run.

    A null text is an empty one; a null array has no edits; a null edit, or one with null
    bounds, is skipped; null ``new`` deletes; bounds outside the text are brought into it.
    Repeated rows and null ids stay; an empty table gives no rows. Other columns aren't read.
    """
    tree = F.col(tree_col) if tree_col else F.lit(None).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(edits_col).cast(EDITS).alias("e"), tree.alias("tree"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["n_pieces", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "n_reencoded", *["n_planted"][:with_state]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for b in batches:
            counts = counts or Counts(vocabulary)
            for part in slices(b, 1, ROWS, BYTES):
                out, texts, trees = [], [], []
                for text, edits, kept in zip(part.column(1), part.column(2), part.column(3), strict=True):
                    doc = Counted(text.as_py() or "", counts, kept.as_py())
                    before, n, fresh, done = doc.n_tokens, len(doc._chars), doc.encoded, 0
                    for e in edits.as_py() or ():
                        if e and e["start"] is not None and e["end"] is not None:
                            doc.edit(e["start"], e["end"], e["new"] or "")
                            done += 1
                    out.append((n, before, done, doc.n_chars, doc.n_tokens, doc.encoded - fresh, fresh))
                    if with_state:
                        texts.append(doc.text())
                        trees.append(doc.tree())
                columns = [pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[: len(names)]]
                if with_state:
                    columns += [pa.array(texts, pa.string()), pa.array(trees, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", *names, *["t", "tree"][: 2 * with_state]])

    schema = ", ".join([f"id {kind}", *(f"{n} long" for n in names), *["t string", "tree binary"][: 2 * with_state]])
    out = rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
    return out.withColumnRenamed("t", text_col) if with_state else out


def hashed_edits(id_col: Column, text: Column, n: int = 4) -> Column:
    """``n`` edits of a document at places that a hash of its id fixes: a cut, an insertion of words of its own, a replacement, in turn."""
    size = F.greatest(F.length(text), F.lit(1))

    def one(i: Column) -> Column:
        at = F.pmod(F.xxhash64(id_col, i), size).cast("long")
        own = F.substring(text, (F.pmod(F.xxhash64(i, id_col), size) + 1).cast("int"), F.lit(24))
        kind = i % 3
        return F.struct(
            at.alias("start"),
            (at + F.when(kind == 0, 40).when(kind == 1, 0).otherwise(12)).alias("end"),
            F.when(kind == 0, "").when(kind == 1, own).otherwise(F.concat(F.lit(" "), F.lower(own))).alias("new"),
        )

    return F.when(text.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one))
