import math
from collections import Counter

import numpy as np
import pyarrow as pa

from corpusloom.llm import lm

POWERS = lm.Powers()


def key(word):
    return int(lm.words(pa.array([word.encode()]), POWERS)[0][0])


def signed(k):
    return k - (1 << 64) if k >> 63 else k


def coded(text, vocab):
    keys, size = lm.words(pa.array([(text or "").encode()]), POWERS)
    return lm.joined(vocab.ids(keys), size)


def test_words_are_those_of_split():
    texts = ["The cat\tsat", None, "", " a  b\nA ", "x", "é É\x0bz\x0c", "y" * 70000, "end"]
    keys, size = lm.words(pa.array([None if t is None else t.encode() for t in texts]), POWERS)
    want = [(t or "").encode().lower().split() for t in texts]
    assert size.tolist() == list(map(len, want))
    by = {}
    for k, w in zip(keys.tolist(), [w for ws in want for w in ws], strict=True):
        assert by.setdefault(w, k) == k and k & 255 == (min(len(w), 40) * 131 + w[0] * 31 + w[-1] * 7) % 255
    assert len(set(by.values())) == len(by)
    part = pa.array([t.encode() for t in ("aa bb", "cc", "dd ee")]).slice(1, 1)
    assert lm.words(part, POWERS)[0].tolist() == [key("cc")]


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    net = lm.Window(rng.random(lm.SIZE))
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    for k in ("c1", "c2", "c3"):
        setattr(net, k, rng.normal(0, 0.3, getattr(net, k).shape))
    around, target, weight = rng.integers(0, 4096, (6, 4)), rng.integers(0, 4096, 6), rng.integers(1, 4, 6).astype(float)
    _, grad = net.gradient(around, target, weight)
    some = lambda: int(target[rng.integers(6)])
    pick = {"e": lambda: (around[rng.integers(6), rng.integers(4)], rng.integers(lm.WIDTH)), "c2": lambda: (some() // 256, rng.integers(lm.HIDDEN), rng.integers(8)), "d2": lambda: (some() // 256, rng.integers(8)), "c3": lambda: (some() // 32, rng.integers(lm.HIDDEN), rng.integers(32)), "d3": lambda: (some() // 32, rng.integers(32))}
    for k in net.NAMES:
        w = getattr(net, k)
        for _ in range(5):
            i = tuple(int(v) for v in pick[k]()) if k in pick else tuple(int(rng.integers(s)) for s in w.shape)
            old = w[i]
            w[i] = old + 1e-5
            up = net.gradient(around, target, weight)[0]
            w[i] = old - 1e-5
            down = net.gradient(around, target, weight)[0]
            w[i] = old
            assert abs((up - down) / 2e-5 - grad[k][i]) < 1e-4 * (1 + abs(grad[k][i])), (k, i)


def slow_score(text, vocab, net):
    """Sum over the tokens, one at a time; words outside the vocabulary count as occurring once."""
    ids, places = coded(text, vocab)
    total = 0.0
    soft = lambda x, i: x[i] - np.log(np.exp(x.astype(float)).sum())
    for at in places:
        t = ids[at]
        h = np.tanh(np.concatenate([net.e[ids[at + o]] for o in (-2, -1, 1, 2)]) @ net.w + net.b)
        total += soft(h @ net.c1[0] + net.d1[0], t // 256) + soft(h @ net.c2[t // 256] + net.d2[t // 256], t // 32 % 8) + soft(h @ net.c3[t // 32] + net.d3[t // 32], t % 32) - vocab.share[t]
    return total


def test_counts_training_and_scores(spark):
    texts = ["The cat sat on the mat. " * 30, "a dog ran in the park " * 30, None, "", "  \n", "Zebra", "the cat ran " * 20]
    rows = [(i, t, 1.0) for i, t in enumerate(texts)] + [(None, "the mat", 2.0), (1, texts[1], 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens double")
    want = Counter(signed(key(w)) for _, t, _ in rows for w in (t or "").split())
    assert {r.word: r.n for r in lm.word_counts(df).collect()} == want
    vocab, net = lm.train(df)
    assert vocab.counts.sum() == sum(want.values())
    before = lm.Window(vocab.counts)
    out = {(r.doc_id, r.n_tokens): r for r in lm.scores(df, vocab, net).collect()}
    for i, t, _ in rows:
        n = len((t or "").split())
        r = out[i, n]
        assert abs(r.log_likelihood - slow_score(t, vocab, net)) < 1e-2 * (1 + n) / 10
        if n > 50:
            assert r.log_likelihood > slow_score(t, vocab, before)  # it has learned from both sides
    assert out[2, 0].perplexity == 1.0 and out[2, 0].log_likelihood == 0.0
    empty = df.limit(0)
    vocab, net = lm.train(empty)
    assert lm.scores(empty, vocab, net).count() == 0 and lm.scores(df, vocab, net).count() == len(rows)


def test_the_result_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORKER", 300)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 30, 60))) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:7], "doc_id long, text string")
    one, many = (lm.train(df.repartition(n))[1].flat() for n in (1, 7))
    assert np.array_equal(one, many)
    own = lm.train(df.repartition(3), rounds=1)[1].flat()
    vocab = lm.vocabulary(df)
    start = lm.Window(vocab.counts).flat()
    total, change = 0.0, np.zeros(len(start))
    by = {}
    for r in lm.coded(df, "text", vocab).collect():  # the round again, worker by worker
        old = by.setdefault(r.w, {}).get(r.h, (None, 0))
        by[r.w][r.h] = (r.ids, old[1] + r.copies)
    assert len(by) > 2 and sum(k for rs in by.values() for _, k in rs.values()) == 47
    for _, rs in sorted(by.items()):
        learner = lm.Learner(vocab, start)
        for _, (ids, copies) in sorted(rs.items()):
            ids = np.frombuffer(ids, "<u2").astype(np.int64)
            learner.take(ids, np.array([len(ids)]), np.array([copies]))
        change += ((learner.end() - start) * np.float32(learner.seen)).astype(np.float64)
        total += learner.seen
    assert np.allclose(own, start + change / total, atol=1e-6)


def test_every_position_is_a_target(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(20)) for i in range(3)]
    vocab, net = lm.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    for t in texts:
        ids, at = coded(t, vocab)
        assert (net.log_probs(ids, at) > lm.Window(vocab.counts).log_probs(ids, at)).all()


def test_other_words_keep_their_own_counts(spark):
    """Words beyond the ``TOP`` of one shape: the frequent one scores higher by the log of its count, in repeated rows too."""
    many = " ".join(f"t{i:05d} t{i:05d} t{i:05d} t{i:05d} t{i:05d}" for i in range(lm.TOP))
    rows = [(1, many), (2, "zaz zaz zaz"), (3, "zaz"), (3, "zaz"), (4, "zbz"), (None, "zaz zbz"), (5, None)]
    df = spark.createDataFrame(rows[:3] + rows[4:5] + rows[6:], "doc_id long, text string")
    vocab, net = lm.train(df)
    assert {(r.word, r.n) for r in vocab.rare.collect()} == {(signed(key("zaz")), 4)}
    ids, _ = coded("t00000 Xylophone t00000", vocab)
    assert ids[2] == ids[4] < lm.TOP <= ids[3] < lm.PAD and ids[0] == lm.PAD
    out = [(r.doc_id, r.n_tokens, r.log_likelihood) for r in lm.scores(spark.createDataFrame(rows, df.schema), vocab, net).collect()]
    assert len(out) == len(rows)
    of = {(i, n): s for i, n, s in out}
    assert abs(of[3, 1] - of[4, 1] - math.log(4)) < 1e-6 and len([o for o in out if o[0] == 3 and abs(o[2] - of[3, 1]) < 1e-9]) == 2
    ids, at = coded("zaz zbz", vocab)
    assert abs(of[None, 2] - (net.log_probs(ids, at) - math.log(5)).sum() - math.log(4)) < 1e-4


def test_the_vocabulary_is_the_most_frequent(spark, monkeypatch):
    """Also where many words have the count at which it ends."""
    monkeypatch.setattr(lm, "TOP", 60)
    monkeypatch.setattr(lm, "PAD", 60 + lm.SHAPES)
    text = " ".join(["a"] * 9 + ["b"] * 5000 + [f"w{i}" for i in range(3000)] + [f"v{i} v{i}" for i in range(20)])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    counts = Counter(signed(key(w)) for w in text.split())
    want = sorted(counts, key=lambda w: (-counts[w], w))[:60]
    assert set(lm.vocabulary(df).keys.view(np.int64).tolist()) == set(want)
