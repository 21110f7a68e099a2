import hashlib
import random
import re

from corpusloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def slow(text, items):
    ws = WORD.findall(low(text))
    hit, names = set(), set()
    for name, t in items:
        it = WORD.findall(low(t))
        for i in range(max(len(it) - 9, 1) if it else 0):
            win = it[i : i + 10]
            for p in range(len(ws) - len(win) + 1):
                if ws[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    if name is not None:
                        names.add(str(name))
    names = sorted(names)
    return len(ws), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocab = ["ab", "cd", "Ef", "gh", "É", "é", "ΑΣ", "aΣ", "12", "x"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 10, 11, 30])))) for i in range(12)] + [(3, None), (None, "lost words here"), (7, "q-r_s"), (20, "ab ab ab ab ab ab ab ab ab ab ab")]
    docs = [(None, "lost words here ab"), (1, None), (2, ""), (2, ""), (3, "...---"), (4, "AB " * 40)]
    for i in range(30):
        parts = []
        for _ in range(6):
            t = rng.choice(items)[1] or ""
            parts.append(t if rng.random() < 0.5 else t.swapcase())
            parts += [rng.choice(vocab) for _ in range(rng.randrange(5))]
        docs.append((100 + i // 2, rng.choice([" ", ", ", "\n"]).join(parts)))
    d = spark.createDataFrame([(a, b, 1, "n") for a, b in docs], "doc_id long, text string, h int, item string")
    b = spark.createDataFrame([(a, t, "z") for a, t in items], "item_id long, text string, key string")
    got = sorted((tuple(r)[:6] for r in decontaminate.contamination(d, b).collect()), key=str)
    assert got == sorted(((i, *slow(t, items)) for i, t in docs), key=str)
    for empty in (d.limit(0), d):
        out = decontaminate.contamination(empty, b.limit(0))
        assert out.count() == empty.count() and out.where("contaminated").count() == 0
    assert decontaminate.contamination(d.limit(0), b).count() == 0


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, "two one three four five six seven eight nine ten"), (2, "one two"), (3, "zz " + item)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contamination(d, b).where("contaminated").collect()} == {3}
    assert {r.doc_id for r in decontaminate.contamination(d, b, slop=2).where("contaminated").collect()} == {1, 3}

def test_index_holds_the_benchmarks_terms_in_place(spark):
    d = spark.createDataFrame([(5, "One two, THREE one É"), (6, None)], "doc_id long, text string")
    t = spark.createDataFrame([("one",), ("three",), ("É",)], "w string").selectExpr("xxhash64(w) AS key")
    rows = decontaminate.index(d, t, 3).collect()
    doc = {r.doc: r.id for r in rows if r.last}
    assert {(doc[r.doc], r.pos) for r in rows if r.last} == {(5, 5), (6, 0)}
    assert sorted((doc[r.doc], r.pos) for r in rows if not r.last) == [(5, 0), (5, 2), (5, 3), (5, 4)]


def slow_near(text, items, near):
    """Words within ``near`` places of where they would stand, with the window's rarest exactly there; one document is the corpus."""
    ws = WORD.findall(low(text))
    out = set()
    for name, t in items:
        it = WORD.findall(low(t))
        for i in range(max(len(it) - 9, 1) if it else 0):
            win = it[i : i + 10]
            if not all(w in ws for w in win):
                continue
            rare = min(range(len(win)), key=lambda k: (ws.count(win[k]), i + k))
            for p in (k for k, w in enumerate(ws) if w == win[rare]):
                a = p - rare
                if all(any(ws[q] == w for q in range(max(0, a + k - near), min(len(ws), a + k + near + 1))) for k, w in enumerate(win)):
                    out |= {(a + k) for k in range(len(win))}
    return len(out)


def test_near_matches_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("abcdefghijklmn") + rng.choice("xy") for _ in range(rng.choice([4, 12, 20])))) for i in range(4)]
    b = spark.createDataFrame(items, "item_id long, text string")
    for _ in range(6):
        ws = rng.choice(items)[1].split() + rng.choice(items)[1].split()
        for _ in range(4):
            k = rng.randrange(len(ws) - 1)
            ws[k], ws[k + 1] = ws[k + 1], ws[k]
        text = " ".join(ws)
        r = decontaminate.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), b, near=2).first()
        assert (r.n_hit, r.n_near) == (slow(text, items)[1], slow_near(text, items, 2))


def test_joins_that_shuffle_agree(spark, monkeypatch):
    """Beyond the bound of what is broadcast the results are the same."""
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(14))) for i in range(5)]
    docs = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(9)) + " " + items[i % 5][1]) for i in range(20)] + [(99, "w1 " * 3000)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    got = sorted(tuple(r)[:6] for r in decontaminate.contamination(d, b).collect())
    assert got == sorted((i, *slow(t, items)) for i, t in docs)
    left = decontaminate.clean(d, b)
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, t in docs if not slow(t, items)[4])
