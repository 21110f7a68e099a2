import itertools
import math
import random

import pytest

from corpusloom.llm import html


@pytest.fixture(scope="module")
def field():
    return html.fit(html.labelled_pages())


def test_marginals_match_enumeration():
    f = html.Field()
    f.edge = [[[0.3, -0.2], [-0.5, 0.9]], [[0.1, -0.7], [0.2, 0.4]], [[0.6, 0.0], [-0.1, 0.2]]]
    nodes = html.parse("<div class=ad>x<p>y <b>z</b></p></div><article>q<p>r</p></article>")
    f.weight = {"kind 1": 0.4, "tag article": 0.8, "hint advert 2": -1.1, "kind 0": -0.2, "tag p": 0.3}
    at = {id(n): i for i, n in enumerate(nodes)}
    own = [sum(f.weight.get(x, 0.0) for x in html.looks(n)) for n in nodes]
    total, good = 0.0, [0.0] * len(nodes)
    for s in itertools.product((0, 1), repeat=len(nodes)):
        w = math.exp(sum(o * y for o, y in zip(own, s, strict=True)) + sum(f.edge[html.kind(n.tag)][s[at[id(n.parent)]]][s[i]] for i, n in enumerate(nodes) if i))
        total += w
        for i, y in enumerate(s):
            good[i] += w * y
    full, _, _ = f.odds(nodes)
    assert all(abs(1 / (1 + math.exp(-o)) - g / total) < 1e-9 for o, g in zip(full, good, strict=True))


def test_held_out_pages(field):
    pages = html.labelled_pages(80, seed=99)
    right = all_of = exact = 0
    for nodes in pages:
        full, _, _ = field.odds(nodes)
        right += sum((x >= 0) == (n.truth == 1) for x, n in zip(full, nodes, strict=True))
        all_of += len(nodes)
        exact += html.blocks(nodes, [x >= 0 for x in full]) == html.blocks(nodes, [n.truth == 1 for n in nodes])
    assert right / all_of > 0.96 and exact / len(pages) > 0.7


def test_given_shape(field):
    page = '<!DOCTYPE html><html lang="en"><head><title>T &amp;</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li><li><a href="/y">y</a></li></ul></nav><!-- ad --><div class="ad">Buy this. Now.</div><article><h1>Head &amp; line</h1><p><b>First line.<br><p>Second  \n line &eacute;&#33;</p><p>Z.</p></article><footer>&copy; a.b &middot; Foot text.</footer>'
    want = "Head & line\nFirst line.\nSecond line é!\nZ."
    assert html.main_text(page, field) == want
    assert html.main_text(page + "</body></html>", field) == want
    comments = '<section class="comments"><h3>Comments</h3><div class="comment"><p>Nice one, thanks a lot.</p></div></section>'
    assert html.main_text(page.replace("</article>", comments + "</article>"), field) == want
    assert html.main_text(page.replace("<article>", '<header><p>Site name</p></header><aside class="sidebar"><p>Other things to read.</p></aside><article>'), field) == want


def test_odd_rows(spark, field):
    rows = [(1, "u", None, 1), (2, None, "", 1), (None, "u", "<p>", 1), (3, "v", "<article><p>" + "word. " * 30000, 1), (3, "v", "<div" * 2000, 1), (4, "w", "</p></div>" * 50, 1), (5, "x", "<div>" * 3000 + "deep", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = html.extracted(df, field=field).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id in (1, 2, None)] == ["", "", ""]
    assert html.extracted(df.limit(0), field=field).count() == 0


BODY = "<article><h1>Head line</h1><p>One sentence. Another one.</p>{}<p>Last words here, all of them.</p></article>"


@pytest.mark.parametrize("inner", ["<svg/>", "<iframe src=x />", "<object data=y>", "<![foo bar]>", "<![CDATA[ x ]]>", "<!doctype nonsense", "<?php echo 1 ?>", "</nothing>", "<video>", "<select>", "<template>", "<!-- a -- b -->", '<p truth="yes"></p>', "<svg><path/></svg>", "<object>x</object>"])
def test_nothing_is_lost_after_odd_markup(field, inner):
    got = html.main_text(BODY.format(inner), field).split("\n")
    assert got[0] == "Head line" and "One sentence. Another one." in got and got[-1].endswith("Last words here, all of them.")


def test_heads_that_are_not_closed(field):
    want = html.main_text(BODY.format(""), field)
    for page in ("<html><head><title>T</title><meta charset=x>", "<head><title>T</title><body>", "<head><script>var a;</script>", "<head><style>p{}</style></head>"):
        assert html.main_text(page + BODY.format(""), field) == want
    assert html.main_text(BODY.format("") + "<p clas", field) == want and html.main_text(BODY.format("") + "<!-- not closed <p>x</p>", field) == want


def test_broken_pages_are_rows(field):
    rng = random.Random(7)
    parts = ["<p>", "</p>", "<div class='a'", ">", "<!", "<![x[", "]]>", "<!--", "-->", "<?", "<a href=\"", "\"", "&#x;", "&#99999999999;", "&amp", "text ", "<script>", "</script", "<title>", "</", "<>", "<table><tr><td>", "<li>", "\x00", "é", "<svg>", "<object>", "</head>", "<head>", "=", "'", "truth='x'", "<br/>"]
    for _ in range(1000):
        text = html.main_text("".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))), field)
        assert isinstance(text, str) and "\n\n" not in text
    assert html.main_text("<div>" * 40_000 + "<p>deep words here.", field) == "deep words here."


def slow_blocks(node, keep):
    """Blocks of a tree by recursion: a list of lines."""
    out, line = [], []

    def end():
        if " ".join("".join(line).split()):
            out.append(" ".join("".join(line).split()))
        line.clear()

    def walk(n):
        for x in n.flow:
            if isinstance(x, str):
                if keep[id(n)]:
                    line.append(x)
            elif x.tag == "br":
                line.append(" ")
            else:
                if x.tag not in html.INLINE and x.tag not in html.VOID or x.tag == "hr":
                    end()
                walk(x)
                if x.tag not in html.INLINE and x.tag not in html.VOID:
                    end()

    walk(node)
    end()
    return out


def slow_odds(nodes, f):
    """Log odds of every element from sums over all labellings of its tree, by recursion on subtrees."""
    def below(n, y):  # sum over the labellings under n
        w = math.exp(y * sum(f.weight.get(x, 0.0) for x in html.looks(n)))
        for c in n.children:
            w *= sum(math.exp(f.edge[html.kind(c.tag)][y][z]) * below(c, z) for z in (0, 1))
        return w

    def fixed(n, target, y, label):
        w = math.exp(y * sum(f.weight.get(x, 0.0) for x in html.looks(n))) if n is not target or y == label else 0.0
        for c in n.children:
            w *= sum(math.exp(f.edge[html.kind(c.tag)][y][z]) * fixed(c, target, z, label) for z in (0, 1))
        return w

    root = nodes[0]
    return [math.log(sum(fixed(root, n, y, 1) for y in (0, 1)) / sum(fixed(root, n, y, 0) for y in (0, 1))) for n in nodes]


def test_query_against_brute_force(field):
    """Whole pages: exact marginals by enumeration of subtrees, then blocks by recursion."""
    pages = ["<div class=ad>x y<p>z <b>w</b></p></div><article>q r.<br>s<p>t <a href=u>v</a></p><hr></article>", "<nav><ul><li>a</li><li>b</li></ul></nav><p>c d. e</p>", "<section><h2>h</h2><p>One. Two.</p></section><footer>f</footer>"]
    for page in pages:
        nodes = html.parse(page)
        odds = slow_odds(nodes, field)
        keep = {id(n): o >= 0 for n, o in zip(nodes, odds, strict=True)}
        assert html.main_text(page, field) == "\n".join(slow_blocks(nodes[0], keep))
