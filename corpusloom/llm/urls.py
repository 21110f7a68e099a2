"""URL filters: listed rules first, then gradient-boosted trees on lexical features.

All of it is DataFrame operations. Rules label the URLs that they fit; the trees learn from
those labels and judge the rest; a labelled URL's suffix statistics come from the other folds
of the labelled URLs, so they don't give its own label away. Features are binned, and the labelled URLs are grouped by
their bins, so training works on a table of counts: each level of each tree is one grouped
sum of gradients by (node, feature, bin), combined before its shuffle, and the driver reads
a row for each of them (nodes x features x bins, however many URLs there are). A trained
tree is a CASE expression, so judging is one pass of generated code.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict and rule; a rule is a host and the start of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
BINS, TREES, DEPTH, RATE, RIDGE, PRIOR, FOLDS = 16, 10, 2, 0.5, 1.0, 20.0, 5


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host (or any parent domain) and the start of a path, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        domain, _, rest = r.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, F.lit(r)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _count(s: Column, part: str) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(part)))) / len(part)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers read off a URL; ``url`` is not null."""
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(url, ""))
    share = F.transform(chars, lambda c: F.when(c != "", (F.length(url) - F.length(F.replace(url, c))) / n).otherwise(F.lit(0.0)))
    entropy = F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return {
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "labels": _count(host, "."),
        "depth": F.size(F.array_remove(F.split(path, "/"), "")).cast("double"),
        "digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / n,
        "host_digits": F.length(F.regexp_replace(host, "[^0-9]", "")).cast("double"),
        "hyphens": _count(url, "-") + _count(url, "_"),
        "entropy": entropy,
        "parameters": F.size(F.array_remove(F.split(query, "&"), "")).cast("double"),
        "fragment": F.when(F.contains(url, F.lit("#")), 1.0).otherwise(0.0),
        "secure": F.when(F.startswith(url, F.lit("https:")), 1.0).otherwise(0.0),
        "extension": F.length(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)).cast("double"),
    }


#: What the statistics are kept by: the last host label, the last two, and the first path segment.
SUFFIXES = {"top": r"([^.]*)$", "domain": r"([^.]*\.?[^.]*)$"}


def _suffixes(host: Column, path: Column) -> dict[str, Column]:
    return {k: F.regexp_extract(host, p, 1) for k, p in SUFFIXES.items()} | {"section": F.regexp_extract(path, r"^/([^/]*)", 1)}


def _rates(labelled: DataFrame, by: str, base: float) -> DataFrame:
    """Smoothed share of blocked URLs and size of each suffix among the labelled of all other folds; fold -1 has none of its own.

    So no labelled URL's statistics hold its own label. One row a suffix and fold.
    """
    own = labelled.groupBy(by, "fold").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = labelled.groupBy(by).agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
    folds = whole.select("*", F.explode(F.sequence(F.lit(-1), F.lit(FOLDS - 1))).alias("fold")).join(own, [by, "fold"], "left").fillna({"n": 0, "bad": 0})
    n, bad = F.col("all_n") - F.col("n"), F.col("all_bad") - F.col("bad")
    return folds.select(by, "fold", ((bad + base * PRIOR) / (n + PRIOR)).alias(f"{by}_rate"), F.log1p(n).alias(f"{by}_size"))


def _binned(df: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Each feature replaced by how many cuts it exceeds."""
    bins = {f: reduce(lambda a, c: a + (F.col(f) > c).cast("int"), values, F.lit(0)) for f, values in cuts.items()}
    return df.withColumns(bins)


class Trees:
    """A sum of trees over bins, as nested (feature, bin, left, right) tuples or leaf values."""

    def __init__(self, start: float) -> None:
        self.start, self.trees = start, []

    def margin(self) -> Column:
        def case(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            return F.when(F.col(t[0]) <= t[1], case(t[2])).otherwise(case(t[3]))

        return reduce(lambda a, t: a + case(t), self.trees, F.lit(float(self.start)))


def _grow(counts: DataFrame, features: list[str], model: Trees, depth: int) -> None:
    """Adds one tree: Newton steps on logistic loss, the best split of each node by grouped sums."""
    p = 1 / (1 + F.exp(-model.margin()))
    data = counts.select(*features, (F.col("bad") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
    nodes: dict[int, tuple] = {1: ()}  # open nodes: conditions that lead there
    splits: dict[int, tuple[str, int]] = {}
    leaves: dict[int, float] = {}
    for level in range(depth):
        where = F.lit(None).cast("int")
        for k, conditions in nodes.items():
            fits = reduce(lambda a, c: a & ((F.col(c[0]) <= c[1]) if c[2] else (F.col(c[0]) > c[1])), conditions, F.lit(True))
            where = F.when(fits, F.lit(k)).otherwise(where)
        pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in features])
        sums = data.select(where.alias("k"), "g", "h", F.explode(pairs).alias("x")).where("k IS NOT NULL").groupBy("k", "x").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        found: dict[int, dict[str, dict[int, tuple[float, float]]]] = {}
        for r in sums.collect():
            found.setdefault(r.k, {}).setdefault(r.x.f, {})[r.x.b] = (r.g, r.h)
        following = {}
        for k, conditions in nodes.items():
            by = found.get(k, {})
            if not by:
                leaves[k] = 0.0
                continue
            first = sorted(by[features[0]].values())
            G, H = math.fsum(x[0] for x in first), math.fsum(x[1] for x in first)
            best = (1e-6, None)
            for f in features:
                g = h = 0.0
                for b in sorted(by[f])[:-1]:
                    g, h = g + by[f][b][0], h + by[f][b][1]
                    gain = round(g * g / (h + RIDGE) + (G - g) ** 2 / (H - h + RIDGE) - G * G / (H + RIDGE), 9)
                    if gain > best[0]:
                        best = (gain, (f, b, g, h))
            if best[1] is None:
                leaves[k] = G / (H + RIDGE)
                continue
            f, b, g, h = best[1]
            splits[k] = (f, b)
            following |= {2 * k: (*conditions, (f, b, True)), 2 * k + 1: (*conditions, (f, b, False))}
            leaves |= {2 * k: g / (h + RIDGE), 2 * k + 1: (G - g) / (H - h + RIDGE)}
        nodes = following
        if not nodes:
            break

    def build(k: int):
        return (*splits[k], build(2 * k), build(2 * k + 1)) if k in splits else round(RATE * leaves.get(k, 0.0), 12)

    model.trees.append(build(1))


def verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Verdict on every URL.

    Returns ``id_col``, host, path, rule (null if none fits), verdict (allow or block) and
    score, the trees' probability that the URL is to be blocked.

    A null URL, or one without ``://``, has an empty host and path, and the trees judge it.
    Trees learn from all URLs that a rule fits. Without any, or with labels of one kind only,
    every score is that kind's share (0 without any). A URL is blocked from 0.5 on. Repeated
    rows and null ids stay. An empty table gives no rows. Other columns are not read.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), url.alias("u")).select("id", "u", host(F.col("u")).alias("host"), path(F.col("u")).alias("path"))
    name, said = rule(F.col("host"), F.col("path"), rules)
    fold = F.when(said.isNull(), -1).otherwise(F.pmod(F.xxhash64("u"), F.lit(FOLDS))).cast("int")
    base = base.withColumns({"rule": name, "said": said, "fold": fold} | _suffixes(F.col("host"), F.col("path")))
    labelled = base.where("said IS NOT NULL").groupBy("top", "domain", "section", "fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("said") == "block").alias("bad"))
    labelled = checkpointed(labelled)
    n, bad = (x or 0 for x in labelled.agg(F.sum("n"), F.sum("bad")).first())
    share = bad / n if n else 0.0
    out = ["id", "host", "path", "rule", "said"]
    if 0 < bad < n:
        full = base.select(*out, "top", "domain", "section", "fold", *[c.alias(k) for k, c in lexical(F.col("u"), F.col("host"), F.col("path")).items()])
        features = list(lexical(F.lit(""), F.lit(""), F.lit("")))
        for by in ("top", "domain", "section"):
            full = full.join(_rates(labelled, by, share), [by, "fold"], "left").fillna({f"{by}_rate": share, f"{by}_size": 0.0})
            features += [f"{by}_rate", f"{by}_size"]
        full = checkpointed(full.select(*out, *features))
        steps = [i / BINS for i in range(1, BINS)]
        known = full.where("said IS NOT NULL")
        cuts = dict(zip(features, known.agg(*[F.percentile_approx(f, steps, 10_000).alias(f) for f in features]).first(), strict=True))
        binned = _binned(full, {f: sorted(set(v)) for f, v in cuts.items()})
        counts = checkpointed(binned.where("said IS NOT NULL").groupBy(*features).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("said") == "block").alias("bad")))
        model = Trees(math.log(share / (1 - share)))
        for _ in range(trees):
            _grow(counts, features, model, depth)
        judged = binned.select(*out, (1 / (1 + F.exp(-model.margin()))).alias("score"))
    else:
        judged = base.select(*out, F.lit(float(share)).alias("score"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
