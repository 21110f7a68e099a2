import random

import corpus_pipeline
import numpy as np
from corpusloom.llm import cluster, near


def slow(a, b):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def texts(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    out = []
    for _ in range(12):
        base = [word() for _ in range(200)]
        for n in (0, 1, 2, 3, 4, 12):
            edited = list(base)
            for at in rng.sample(range(200), n):
                edited[at] = word()
            out.append(" ".join(edited))
    crowd = [word() for _ in range(200)]
    for _ in range(60):
        edited = list(crowd)
        edited[rng.randrange(200)] = word()
        out.append(" ".join(edited))
    return out


def test_stage_leaves_no_near_copy_and_drops_nothing_else(spark):
    rows = list(enumerate(texts()))
    got = corpus_pipeline.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    kept = {r.doc_id: r.text for r in got}
    assert len(kept) == len(got)
    ids = sorted(kept)
    assert not [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if slow(kept[a], kept[b]) >= 0.8]
    for i, t in rows:  # each that went has a similar one
        assert i in kept or any(slow(t, u) >= 0.8 for j, u in rows if j != i)


def test_nulls_repeats_and_short_texts(spark):
    rows = [(3, "a b c"), (2, "A  b c"), (2, "A  b c"), (None, "a b c"), (None, "x y z w v u"), (9, None), (8, " "), (7, "a b d")]
    got = near.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == [(-1, "x y z w v u"), (2, "A  b c"), (7, "a b d"), (8, " ")]


def test_sketches_tell_half_from_four_fifths():
    """Pairs at 0.8 and more are near, pairs that share half of their shingles are not."""
    rng, of = np.random.default_rng(2), near.Bands()
    draw = lambda n: rng.integers(0, 1 << 63, n, np.uint64)
    apart = lambda a, b: sum(int(x).bit_count() for x in (of.keys(a)[1] ^ of.keys(b)[1]).view(np.uint64))
    for size in (20, 200):
        close = [apart(np.concatenate([same := draw(8 * size), draw(size)]), np.concatenate([same, draw(size)])) for _ in range(150)]
        half = [apart(np.concatenate([same := draw(size), draw(size // 2)]), np.concatenate([same, draw(size // 2)])) for _ in range(150)]
        assert max(close) <= near.FAR and np.mean(np.array(half) > near.FAR) > 0.9


def test_a_common_passage_makes_no_links(spark):
    """Many short texts around one passage: similar at a half, each stays, and few pairs are tried."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    passage = [word() for _ in range(40)]
    rows = [(i, " ".join([word() for _ in range(15)] + passage + [word() for _ in range(10)])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near.representatives(df).count() == len(rows)


def test_chains_of_similar_texts_are_one_group(spark):
    """Each text is similar to the next alone; those of a crowd, to its first; the crowd's last has a chain too."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))

    def edited(words, places):
        return [word() if i in places else w for i, w in enumerate(words)]

    rows, first = [], []
    for _ in range(8):
        words = [word() for _ in range(200)]
        first.append(len(rows))
        for step in range(5):
            rows.append(words)
            words = edited(words, {20 * j + 4 * step + 8 for j in range(3)})
    crowd = [word() for _ in range(200)]
    first.append(len(rows))
    rows.append(crowd)
    rows += [edited(crowd, {5 * i % 200, (5 * i + 100) % 200}) for i in range(40)]
    rows.append(edited(rows[-1], {10, 50, 90}))
    rows.append(edited(rows[-1], {30, 70, 150}))
    texts = [" ".join(w) for w in rows]
    alike = [(a, b) for b in range(len(texts)) for a in range(b) if slow(texts[a], texts[b]) >= 0.8]
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    assert sorted(set(root)) == first and (0, 2) not in alike
    got = near.representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == first


def test_a_large_group_costs_no_row_for_each_pair(spark):
    """Forty sets linked to the first and ten others share one key and one sketch (the first has not left); only the last is similar to one that left."""
    rows = spark.createDataFrame([(k, 7, *[0] * len(near.SKETCH)) for k in range(50)], ", ".join(["k long", "key long", *(f"{c} long" for c in near.SKETCH)]))
    found = spark.createDataFrame([(k, 0) for k in range(1, 40)], "a long, b long")
    some = near._across(rows, found)
    assert some.count() == 49 and {r.k for r in some.where("out").collect()} == set(range(40, 50))
    own = {k: np.arange(1000 * k, 1000 * k + 100, dtype=np.uint64) for k in range(50)}
    own[49] = np.concatenate([own[5][:95], own[49][:5]])
    sets = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in own.items()], "k long, s binary")
    for side in (near.SIDE, 8):
        near.SIDE, kept = side, near.SIDE
        try:
            assert {frozenset(r) for r in near._joined(some, sets).collect()} == {frozenset((5, 49))}
        finally:
            near.SIDE = kept


def test_components_of_few_and_of_many_edges_are_alike(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 430)]
    df = spark.createDataFrame(edges, "a long, b long")
    few = {tuple(r) for r in cluster.components(df).collect()}
    monkeypatch.setattr(cluster, "FEW", -1)
    assert few == {tuple(r) for r in cluster.components(df).collect()} and (430, 400) in few


def test_rounds_over_few_edges_take_few_tasks(spark):
    """A task a step and not one for each partition of a shuffle, in the first round and in later ones."""
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "1k"}
    old = {k: spark.conf.get(k) for k in settings}
    tracker = spark.sparkContext.statusTracker()
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long").repartition(8)
        spark.sparkContext.setJobGroup("few edges", "")
        assert cluster.components(edges).where("root = 0").count() == 61
        stages = {s for j in tracker.getJobIdsForGroup("few edges") for s in tracker.getJobInfo(j).stageIds}
        assert sum(x.numCompletedTasks for s in stages if (x := tracker.getStageInfo(s))) < 400
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
