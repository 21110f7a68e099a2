import collections
import itertools
import math

import numpy as np
import sentencepiece

from corpusloom.llm import pieces

MODEL = pieces.Model()
TEXTS = ["", " ", "  ", "hello world", " a  b\nc\td ", "ünïcödé straße 東京", "▁ literal ▁▁x", "a▁", "▁", "\x00\x01", "x" * 300, "one. two! three? " * 50, "😀 ok", " lead"]


def drawn(text, seed, k, model=MODEL):
    lat = pieces.Lattices(model)
    doc = lat.numbers([model.runs(text)])
    return lat, pieces.sample(lat, doc, np.array([seed], np.uint64), k)[0]


def test_ids_are_the_models_own_and_decode():
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for t in TEXTS:
        ids = MODEL.encode(t)
        assert MODEL.decode(ids) == t
        if "▁" not in t:
            assert ids == sp.encode(t), t


def test_samples_are_distinct_whole_and_sorted():
    for t in TEXTS:
        lat, (paths, threshold) = drawn(t, 7, 5)
        seen = {tuple(lat.ids(p[0]).tolist()) for p in paths}
        assert len(seen) == len(paths) and (len(paths) == 5 or not t or threshold == -math.inf)
        assert all(MODEL.decode(lat.ids(p[0]).tolist()) == t for p in paths)
        values = [p[2] for p in paths]
        assert values == sorted(values, reverse=True) and (not values or threshold <= values[-1])


def every(run):
    if not run:
        yield (), 1.0
        return
    for n in range(1, len(run) + 1):
        i = MODEL.known.get(run[:n])
        w = math.exp(MODEL.weight[i]) if i is not None else math.exp(MODEL.unknown) if n == 1 else None
        if w:
            for rest, v in every(run[n:]):
                yield (i, *rest), w * v


def test_probabilities_and_order_follow_the_lattice():
    text = "in the"
    runs = MODEL.runs(text)
    total = collections.Counter()
    for combo in itertools.product(*(list(every(r)) for r in runs)):
        total[tuple(i for ids, _ in combo for i in ids)] += math.prod(w for _, w in combo)
    z = sum(total.values())
    p = {k: v / z for k, v in total.items()}
    lat, (paths, threshold) = drawn(text, 3, len(p) + 5)
    assert {tuple(lat.ids(x[0]).tolist()) for x in paths} == set(p) and threshold == -math.inf
    for x in paths:
        assert abs(math.exp(x[1]) - p[tuple(lat.ids(x[0]).tolist())]) < 1e-9
    first, pair, n = collections.Counter(), collections.Counter(), 6000
    for seed in range(n):
        got = pieces.sample(lat, lat.numbers([runs]), np.array([seed * 7919 + 1], np.uint64), 2)[0][0]
        a, b = (tuple(lat.ids(x[0]).tolist()) for x in got)
        first[a] += 1
        pair[b] += 1
    top = sorted(p, key=p.get, reverse=True)[:6]
    for s in top:
        assert abs(first[s] / n - p[s]) < 4 * math.sqrt(p[s] / n) + 0.003
        second = sum(p[o] * p[s] / (1 - p[o]) for o in p if o != s)  # drawn second, without replacement
        assert abs(pair[s] / n - second) < 4 * math.sqrt(second / n) + 0.003


def test_log_inclusion():
    assert pieces.log_inclusion(-700.0, -1.0) == -699.0
    assert abs(pieces.log_inclusion(-1.0, -2.0) - math.log(1 - math.exp(-math.e))) < 1e-12
    assert pieces.log_inclusion(-1.0, -math.inf) == 0.0


def test_rows(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)] + [(None, None, 1), (3, "hello world", 0)], "doc_id long, text string, seed int")
    out = pieces.segmented(df).collect()
    assert len(out) == len(TEXTS) + 2 and all(r.decoded for r in out)
    by = [r for r in out if r.doc_id == 3]
    assert by[0] == by[1] and len(by[0].samples) == 3
    back = pieces.decoded(pieces.segmented(df).select("doc_id", "ids")).collect()
    assert {(r.doc_id, r.text) for r in back} == {(i, t) for i, t in enumerate(TEXTS)} | {(None, "")}
    assert pieces.segmented(df.limit(0)).count() == 0


def test_kept_lattices_change_no_result():
    """Words that recur are not built again, and rows are the same with and without what a worker keeps."""
    import pyarrow as pa

    words = [f"{a}{b}" for a in ("wat", "riv", "sün", "peop", "東") for b in ("er", "ers", "le", "les", "x")]
    texts = [" ".join(words[(7 * i + j * j) % len(words)] for j in range(12)) + f" own{i}" for i in range(40)] + TEXTS
    part = lambda at: pa.record_batch([pa.array([at]), pa.array([at * 7919 + 1]), pa.array([texts[at]])], names=["id", "seed", "t"])
    kept, built = pieces.Lattices(MODEL), []
    build = kept.build
    kept.build = lambda words, runs: (built.append(len(words)), build(words, runs))
    for at in range(len(texts)):
        own = pieces._encoded(part(at), kept, 3, True, True)
        assert own.to_pylist() == pieces._encoded(part(at), pieces.Lattices(MODEL), 3, True, True).to_pylist()
    assert max(built[-20 - len(TEXTS) : -len(TEXTS)]) <= 4  # of thirteen words, most are kept
