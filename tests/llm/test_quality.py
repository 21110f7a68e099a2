import itertools
import math
import random
import zlib

import numpy as np

from corpusloom.llm import quality


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    size = np.array([1, 4, 3])
    score, move = rng.normal(size=(3, 4)), rng.normal(size=(2, 2))
    z, good, pairs = quality.forward_backward(score, size, move)
    want_pairs = np.zeros((2, 2))
    for d, n in enumerate(size):
        total, marg, pr = 0.0, np.zeros(n), np.zeros((2, 2))
        for s in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(score[d, t] * s[t] for t in range(n)) + sum(move[s[t], s[t + 1]] for t in range(n - 1)))
            total += w
            marg += w * np.array(s)
            for t in range(n - 1):
                pr[s[t], s[t + 1]] += w
        assert abs(z[d] - math.log(total)) < 1e-9 and np.allclose(good[d, :n], marg / total)
        want_pairs += pr / total
    assert np.allclose(pairs, want_pairs)


def made(n, rng):
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        lines = []
        for _ in range(rng.randrange(1, 8)):
            ws = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(4, 20))]
            lines.append(" ".join(w.upper() + "!!" for w in ws) if bad else " ".join(ws).capitalize() + ".")
        docs.append((i, "\n".join(lines), "x"))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = made(240, random.Random(1))
    odd = [(None, None, "y"), (1000, "", "y"), (1001, " \n\t\n", "y"), (1002, "x" * 50000, "y"), (1002, "x" * 50000, "y")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(5, None), (None, 1), (7, labels[7][1])], "doc_id long, quality int")
    out = quality.scores(d, quality.train(d, lab)).collect()
    assert len(out) == len(docs) + len(odd)
    truth = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.predicted == 0 for r in out if r.doc_id in (None, 1000, 1001))
    assert quality.scores(d.limit(0), quality.train(d.limit(0), lab)).count() == 0
    assert quality.scores(d, quality.train(d, lab.limit(0))).count() == len(out)


def slow_score(text, field):
    """Score of one text: features, chain sums and weighting one line at a time."""
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
    if not lines:
        return 1 / (1 + math.exp(-field.curve[0]))
    own = [np.array(quality.line_features(x), np.float32) for x in lines]
    none = np.zeros(quality.N_OWN, np.float32)
    odds = []
    for i in range(len(lines)):
        x = np.concatenate([own[i], own[i - 1] if i else none, own[i + 1] if i + 1 < len(lines) else none, np.array([i == 0, i == len(lines) - 1, 1.0], np.float32)])
        odds.append(float(((x - field.mean) * field.scale) @ field.weights))
    total, good = 0.0, [0.0] * len(lines)
    for s in itertools.product((0, 1), repeat=len(lines)):
        w = math.exp(sum(o * y for o, y in zip(odds, s, strict=True)) + sum(field.move[a, b] for a, b in itertools.pairwise(s)))
        total += w
        for i, y in enumerate(s):
            good[i] += w * y
    share = sum(g / total * len(x) for g, x in zip(good, lines, strict=True)) / sum(map(len, lines))
    return 1 / (1 + math.exp(-(field.curve[0] + field.curve[1] * share)))


def test_scores_match_brute_force(spark):
    docs, labels = made(150, random.Random(2))
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    field = quality.train(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    texts = dict((i, t) for i, t, _ in docs[:40]) | {900: None, 901: " \n", 902: "A\n\nb\n" * 4}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in quality.scores(rows, field).collect():
        assert abs(r.score - slow_score(texts[r.doc_id], field)) < 1e-6


def test_many_lines_do_not_widen_others(spark):
    """A text of very many lines beside short ones, in fitting and in scoring."""
    docs, labels = made(60, random.Random(3))
    long = "\n".join(["A good line of words, with an end."] * 60_000)
    d = spark.createDataFrame([*((i, t) for i, t, _ in docs), (500, long), (500, long)], "doc_id long, text string")
    field = quality.train(d, spark.createDataFrame([*labels, (500, 1)], "doc_id long, quality int"))
    out = quality.scores(d, field).collect()
    assert len(out) == 62 and len({r.score for r in out if r.doc_id == 500}) == 1
    kept = quality.good(d, field).collect()
    want = {r.doc_id for r in out if r.predicted}
    assert {r.doc_id for r in kept} == want and {len(r.text) for r in kept if r.doc_id == 500} <= {len(long)}
    sizes = [1, 70_000, 3, 2, 0, 500]
    groups = list(quality._side_by_side(np.array(sizes)))
    assert sorted(i for g in groups for i in g) == [0, 1, 2, 3, 5] and all(len(g) == 1 or len(g) * max(sizes[i] for i in g) <= quality.CELLS for g in groups)
