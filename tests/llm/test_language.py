import zlib

import numpy as np

from corpusloom.llm import language


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"], hidden=3)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    x, y = rng.integers(60, 70, (7, 5)), rng.integers(0, 3, 5)
    _, grad = net.loss_and_gradient(x, y)
    for k in net.NAMES:
        w = getattr(net, k)
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in w.shape)
            if k in ("wg", "wc"):
                i = (i[0], int(x[rng.integers(7), rng.integers(5)]), i[2])
            old = w[i]
            w[i] = old + 1e-4
            up = net.loss_and_gradient(x, y)[0]
            w[i] = old - 1e-4
            down = net.loss_and_gradient(x, y)[0]
            w[i] = old
            assert abs((up - down) / 2e-4 - grad[k][i]) < 2e-4, (k, i)


def plain(net, text):
    """Position distributions over the whole text at once, without stretches."""
    x = np.frombuffer(b" " * language.WARM + text + b" " * language.WARM, np.uint8).astype(np.int64)
    run = net.states(np.stack([x[:, None], x[::-1, None]]))
    new = np.stack([r[5] for r in run], 1)
    logits = new[0, :, 0] @ net.v[0] + new[1, ::-1, 0] @ net.v[1] + net.b
    p = np.exp(logits - logits.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    return p[language.WARM : language.WARM + len(text)]


def test_stretches_agree_with_a_whole_pass():
    net = language.Network(["a", "b"], seed=3)
    text = b"Some text. " * 21  # less than one stretch
    assert np.allclose(net.position_sums([text, b"x"])[0], plain(net, text).sum(0), atol=1e-3)
    long = b"Another text here, " * 300
    got = net.position_sums([long])[0] / len(long)
    assert np.allclose(got, plain(net, long).mean(0), atol=0.02)


def slow(net, text):
    """Label distribution of every byte, each from its own run of both units as the network is defined on stretches."""
    out = []
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    gate = lambda x: 1 / (1 + np.exp(-2 * x))

    def run(k, data):
        s, h = np.zeros(net.hidden), net.hidden
        for b in data:
            g = gate(net.wg[k, b] + s @ net.ug[k])
            s = s + g[:h] * (np.tanh(net.wc[k, b] + g[h:] * (s @ net.uc[k])) - s)
        return s

    pad = b" " * language.WARM + text + b" " * (language.CORE + language.WARM)
    for at in range(len(text)):
        low = at - at % language.CORE
        high = min(low + language.CORE, len(text))
        forward = run(0, pad[low : at + 1 + language.WARM])
        backward = run(1, pad[at + language.WARM : high + 2 * language.WARM][::-1])
        out.append(soft(forward @ net.v[0] + backward @ net.v[1] + net.b))
    return np.array(out)


def test_predictions_match_brute_force(spark):
    net = language.Network(["aa", "bb", "cc"], seed=4)
    texts = {1: "Some text, more text. " * 14, 2: "x", 3: "é " * 150, 4: "a" * language.CORE, 5: "b" * (language.CORE + 1)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in language.predictions(rows, net).collect():
        p = slow(net, texts[r.doc_id].encode()).mean(0)
        assert r.lang_pred == net.langs[p.argmax()] and abs(r.score - p.max()) < 1e-4


def test_letters():
    for text, want in (("½ ² Ⅷ ①", False), ("½a", True), ("12 3_", False), ("é", True), ("字", True), ("ª", True), (None, False), ("", False), ("² ³ x", True)):
        assert language.has_letter(None if text is None else text.encode()) == want, text


def test_learns_and_handles_odd_rows(spark, tmp_path):
    import random

    rng = random.Random(2)
    vocab = {"aa": "the and of with that".split(), "bb": "der und die mit nicht".split()}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(40)), k, 1) for i in range(160) for k in [rng.choice(["aa", "bb"])]]
    odd = [(None, "the and of", "aa", 1), (900, None, "aa", 2), (901, "", None, 2), (902, "12 34 !", "bb", 2), (903, "der " * 9000, None, 3), (903, "der " * 9000, None, 3)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score int")
    net = language.train(df, steps=150)
    out = language.predictions(df, net).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and all(r.lang_pred == truth[r.doc_id] for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[903].lang_pred == "bb" and by[None].lang_pred == "aa"
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    assert language.predictions(df.limit(0), net).count() == 0
    none = language.train(df.limit(0))
    assert {r.lang_pred for r in language.predictions(df, none).collect()} == {"und"}
