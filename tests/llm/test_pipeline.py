import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from corpusloom.llm import language, pieces, quality, simhash


def fixture(spark, root):
    rng = random.Random(4)
    vocab = {"en": "the and of with that from this which about where people water".split(), "de": "der und die mit nicht wenn auch oder haben werden wasser menschen".split()}

    def prose(lang, k):
        return " ".join(rng.choice(vocab[lang]) + rng.choice(["", "s", "en", "er"]) for _ in range(k)).capitalize() + "."

    docs, labels = [], []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        bad = i % 5 == 4
        text = "\n".join(prose(lang, 30) for _ in range(3))
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append((i, text, lang, f"s{i % 4}", len(text)))
        labels.append((i, int(not bad), 0))
    passage = docs[1][1].split("\n")[0]
    docs.append((500, docs[0][1], "de", "s", 1))  # an exact copy
    docs.append((501, prose("en", 40) + "\n" + passage, "en", "s", 1))  # holds a passage of document 1
    docs += [(502, None, None, "s", 0), (503, "123 456 !!", "en", "s", 1), (None, prose("en", 50), "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(9, passage), (10, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return docs, labels, passage


def test_stages_decide_as_they_should(spark, tmp_path):
    docs, labels, passage = fixture(spark, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    bad = {i for i, q, _ in labels if not q}
    assert not ids & bad and not ids & {500, 1, 501, 502, 503}
    clean = {i for i, q, _ in labels if q} - {1}
    fps = {}
    for d in docs:
        if d[0] in clean:
            fps.setdefault(simhash.fingerprint(d[1].encode()), []).append(d[0])
    assert len(ids & clean) >= 0.97 * len(fps) and None in ids
    assert all(r.decoded and r.n_pieces > 0 for r in out)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs.limit(0), str(tmp_path))
        assert got.count() == 0
        if name != "pieces":
            assert got.columns == docs.columns


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d", 1), (2, "a b c d", 2), (2, "a b c d", 3), (None, "a b c d", 4), (None, "x y z w v", 5), (9, "q r s t u", 6)]
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == [(-1, "x y z w v"), (2, "a b c d"), (9, "q r s t u")]


def slow_contaminated(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    ws = word.findall(low(text))
    for it in (word.findall(low(t)) for t in items):
        wins = [it[i : i + 10] for i in range(max(len(it) - 9, 1))] if it else []
        if any(ws[p : p + len(w)] == w for w in wins for p in range(len(ws))):
            return True
    return False


def slow_sets(text):
    ws = (text or "").lower().split()
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))) if ws else frozenset()


def test_each_stage_against_plain_code(spark, tmp_path):
    """Every stage's rows on its own input, worked out one document at a time; the models are the stages' own."""
    fixture(spark, tmp_path)
    root = str(tmp_path)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    odd = [(600, " \n ", "en", "s", 1), (601, "½ ²", "en", "s", 1), (602, "a good line of plain words here.\n" * 20_000, "en", "s", 1), (500, docs.where("doc_id = 500").first().text, "de", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("id", F.lit(1)).withColumn("c0", F.lit("x")).withColumn("__h", F.lit(0)).cache()
    rows = docs.collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.lang or "", r.source)

    def stage(name, given):
        got = dict(corpus_pipeline.STAGES)[name](spark, given, root)
        assert got.columns == given.columns
        return sorted(got.collect(), key=key)

    field = quality.train(docs, spark.read.parquet(f"{root}/labels.parquet"))
    assert stage("quality", docs) == sorted((r for r in rows if field.score([quality.chain((r.text or "").encode())])[0] >= 0.5), key=key)
    net = language.train(docs)
    sure = [r for r in rows if (p := net.predict([(r.text or "").encode()])) and p[0][0] != "und" and p[1][0] >= corpus_pipeline.SURE]
    assert stage("language", docs) == sorted(sure, key=key)
    items = [r.text for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    assert stage("decontamination", docs) == sorted((r for r in rows if not slow_contaminated(r.text, items)), key=key)
    kept = stage("near_duplicates", docs)
    sets = [slow_sets(r.text) for r in kept]
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert not any(jaccard(a, b) >= 0.8 for i, a in enumerate(sets) for b in sets[:i])
    for r in rows:
        if r not in kept:  # each that went has a similar one
            assert any(jaccard(slow_sets(r.text), slow_sets(o.text)) >= 0.8 for o in rows if o is not r)
    model = pieces.Model()
    for r in corpus_pipeline.pieces_stage(spark, docs, root).collect():
        texts = {d.text or "" for d in rows if d.doc_id == r.doc_id}
        assert r.decoded and model.decode(r.ids) in texts and all(model.decode(s.ids) in texts for s in r.samples)
        assert len({tuple(s.ids) for s in r.samples}) == len(r.samples)
