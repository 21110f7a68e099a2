import random

import numpy as np
import pytest
import xxhash

from corpusloom.llm import simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [cur] if cur else []
            cur = ""
        else:
            cur += c
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(rows):
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    group = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, f in fps:
            for j, g in fps:
                if (f ^ g).bit_count() <= 2 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    return {(i, f"{f:016x}", group[i]) for i, f in fps}


def test_fingerprint_of_odd_texts():
    for t in ["", " \t", "A", "a b", "A B C", "É é x", "one two\x0bthree\x1ffour five", "w " * 40000, "x" * 5000, "a b c d"]:
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t), t[:20]
    assert simhash.fingerprint(None) == 0


def test_code_is_perfect_and_keys_meet():
    g, rng = simhash.Golay(), np.random.default_rng(1)
    assert len(np.unique(g.error)) == 2048
    w = rng.integers(0, 1 << 23, 5000)
    own = g.index(w)
    for i in range(23):
        assert (g.near(w ^ (1 << i)) == own[:, None]).any(1).all()


@pytest.mark.parametrize("bucket", [0, 48])
def test_groups_match_brute_force(spark, bucket):
    rng = random.Random(5)
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) + str(rng.randrange(9)) for _ in range(rng.randrange(1, 300))) for _ in range(12)]
    texts = [None, "", "  ", "A b", "a B"]
    for t in base:
        for _ in range(5):
            w = t.split()
            w[rng.randrange(len(w))] = "new"
            texts.append(" ".join(w))
        texts.append(t.upper())
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {tuple(r) for r in simhash.near_duplicates(df, bucket=bucket).collect()}
    assert got == slow_groups([(i, t) for i, t, _ in rows])


def test_chains_join_through_crowded_keys(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(30):
            f ^= 1 << rng.randrange(64)
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")

    def classes(pairs):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        out = {}
        for f in fps:
            out.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, out.values()))

    want = classes((a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2)
    for bucket in (0, 3, 48):
        got = classes((r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, bucket=bucket).collect())
        assert got == want


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "zz yy xx ww vv")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 7), (7, 7), (7, 7)]


def test_representatives_have_a_rule_for_ties_and_any_column_names(spark):
    rows = [(3, "a b c d", 1, "x"), (2, "a b c d", 2, "x"), (2, "a b c d", 3, "y"), (None, "q r s t", 4, "z"), (7, None, 5, "n"), (8, " ", 6, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h int, `n` string").withColumn("__id", simhash.F.lit(1))
    got = [sorted(map(str, simhash.representatives(df.repartition(k, "h")).collect())) for k in (1, 3)]
    assert got[0] == got[1] and len(got[0]) == 3 and simhash.representatives(df).columns == df.columns
