"""Text, query and date functions, as columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as v

HAN = f"[{v.UNSPACED}]"


def _accents() -> tuple[str, str]:
    """Small Latin letters with accents, and each without."""
    pairs = [(c, "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))) for c in map(chr, range(0xC0, 0x250))]
    pairs = [(c, b) for c, b in pairs if c.islower() and len(b) == 1 and b.isascii() and b.isalpha()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


ACCENTS = _accents()


def let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it; keeps expressions small."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def _empty() -> Column:
    return F.array().cast("array<string>")


def unspaced(s: Column) -> Column:
    return F.rlike(s, F.lit(HAN))


def plain_tokens(s: Column) -> Column:
    """Lower-case words of texts written with spaces."""
    return F.regexp_extract_all(F.lower(s), F.lit(v.WORD), F.lit(0))


def grams_of_run(token: Column) -> Column:
    """A token's runs: Latin runs whole, each Han or kana run as its characters, then its pairs."""
    runs = F.regexp_extract_all(token, F.lit(f"{HAN}+|[^{v.UNSPACED}]+"), F.lit(0))

    def of(run: Column) -> Column:
        n = F.length(run)
        one = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
        two = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(_empty())
        return F.when(unspaced(run), F.concat(one, two)).otherwise(F.array(run))

    return F.flatten(F.transform(runs, of))


def tokens(s: Column) -> Column:
    """Words in order; words of scripts without spaces as characters and pairs."""
    return F.flatten(F.transform(plain_tokens(s), lambda t: F.when(unspaced(t), grams_of_run(t)).otherwise(F.array(t))))


def segmented(s: Column) -> Column:
    return F.array_join(tokens(s), " ")


def pieces(token: Column) -> Column:
    """A token with unspaced script as the words in it: Latin runs whole, other runs split at their function words.

    Single weak characters are left out, and one that follows a number is grammar.
    """
    by_length = lambda ws: "|".join(sorted(ws, key=lambda w: (-len(w), w)))
    runs = F.transform(F.regexp_extract_all(token, F.lit(f"{HAN}+|[^{v.UNSPACED}]+"), F.lit(0)), lambda r: F.when(unspaced(r), r).otherwise(F.regexp_replace(r, r"^[._'\-+#]+|[._'\-+#]+$", "")))

    def of(runs: Column, run: Column, i: Column) -> Column:
        numbered = (i > 0) & F.rlike(F.get(runs, i - 1), F.lit(r"\d$"))
        own = F.when(numbered & F.substring(run, 1, 1).isin(*v.WEAK_SINGLE), F.regexp_replace(run, "^.", "")).otherwise(run)
        cut = F.when(F.rlike(own, F.lit(f"[{v.KANA}]")), F.split(own, by_length(v.KANA_STOPS))).otherwise(F.split(own, by_length(v.HAN_STOPS)))
        return F.when(unspaced(run), F.filter(cut, lambda c: (c != "") & ~c.isin(*v.WEAK_SINGLE))).otherwise(F.filter(F.array(run), lambda r: r != ""))

    return let(runs, lambda rs: F.flatten(F.transform(rs, lambda r, i: of(rs, r, i))))


def stop_words(lang: Column) -> Column:
    """Function words of a language: English ones and the language's own markers."""
    table = F.create_map(*[x for k, ws in v.MARKERS.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(set(v.STOP) | set(ws)))))])
    return F.coalesce(F.try_element_at(table, lang), F.array(*map(F.lit, sorted(v.STOP))))


def content_terms(s: Column, lang: str | Column = "en") -> Column:
    """Content words in order, quoted phrases whole with their quotes; case kept; unspaced runs as their pieces.

    ``lang`` is one language, or a column of languages.
    """
    if isinstance(lang, str):
        stops = sorted(set(v.STOP) | set(v.MARKERS.get(lang, ())))
        stopped = lambda t: F.lower(t).isin(*stops)
    else:
        stopped = lambda t: F.array_contains(stop_words(lang), F.lower(t))
    found = F.regexp_extract_all(s, F.lit(v.CONTENT_TOKEN), F.lit(0))
    quoted = lambda t: F.startswith(t, F.lit('"'))
    words = F.flatten(F.transform(found, lambda t: F.when(~quoted(t) & unspaced(t), pieces(t)).otherwise(F.array(t))))
    return F.filter(F.when(unspaced(s), words).otherwise(found), lambda t: quoted(t) | unspaced(t) | (~stopped(t) & (F.length(t) > 1)))


def content_bag(s: Column, lang: str | Column = "en") -> Column:
    return F.array_sort(F.array_distinct(F.transform(content_terms(s, lang), F.lower)))


def informativeness(t: Column) -> Column:
    """How specific a word is, by its look."""
    return (
        F.least(F.length(t), F.lit(14)) / F.lit(14.0)
        + F.when(F.rlike(t, F.lit(r"^\p{Lu}")), 0.35).otherwise(0.0)
        + F.when((F.length(t) >= 2) & F.rlike(t, F.lit(r"\p{Lu}")) & ~F.rlike(t, F.lit(r"\p{Ll}")), 0.6).otherwise(0.0)
        + F.when(F.rlike(t, F.lit(r"\d")), 0.25).otherwise(0.0)
        + F.when(F.rlike(t, F.lit(r"[._\-+#]")), 0.4).otherwise(0.0)
        + F.when(F.startswith(t, F.lit('"')), 1.0).otherwise(0.0)
    )


def keyword_query(s: Column, max_terms: int = 0, lang: str | Column = "en") -> Column:
    """The first and the most informative other content words, in their order; without how-to words if two remain."""
    terms = content_terms(s, lang)
    subject = F.filter(terms, lambda t: ~F.lower(t).isin(*v.NOISE))
    terms = F.when((F.size(terms) > 2) & (F.size(subject) >= 2), subject).otherwise(terms)
    if max_terms:
        numbered = F.transform(terms, lambda t, i: F.struct(F.round(-informativeness(t), 9).alias("k"), i.alias("i"), t.alias("t")))
        best = F.slice(F.array_sort(F.slice(numbered, 2, 10_000)), 1, max_terms - 1) if max_terms > 1 else F.slice(numbered, 1, 0)
        order = F.array_sort(F.transform(F.concat(F.slice(numbered, 1, 1), best), lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"))))
        cut = F.transform(order, lambda x: x["t"])
        terms = F.when(F.size(terms) > max_terms, cut).otherwise(terms)
    return F.when(F.size(terms) == 0, F.trim(s)).otherwise(F.array_join(terms, " "))


def query_terms(s: Column, lang: str | Column = "en", limit: int = 10) -> Column:
    """Ranking vocabulary: content words unquoted, lower-case, distinct in order, long enough for their script."""
    found = F.array_distinct(F.transform(content_terms(s, lang), lambda t: F.lower(F.regexp_replace(t, '^"+|"+$', ""))))
    return F.slice(F.filter(found, lambda t: F.length(t) >= F.when(unspaced(t), 2).otherwise(3)), 1, limit)


def guess_intent(q: Column) -> Column:
    """The first intent whose pattern fits."""
    t = F.trim(q)
    words = F.size(F.split(t, r"\s+"))
    chain = F.when(F.rlike(t, F.lit("(?i)" + v.NAVIGATIONAL)) & (words <= 3), "navigational")
    for name, pattern in (("academic", v.ACADEMIC), ("code", v.CODE), ("product", v.PRODUCT), ("news", v.NEWS), ("reference", v.REFERENCE)):
        chain = chain.when(F.rlike(t, F.lit("(?i)" + pattern)), name)
    return chain.when(F.rlike(t, F.lit(v.LOCAL)), "local").otherwise("informational")


def guess_lang(q: Column) -> Column:
    """By script (any kana: ja; else the most frequent), else by at least two marker words, else en."""
    first = lambda names, counts: F.element_at(F.array(*map(F.lit, names)), F.array_position(counts, F.array_max(counts)).cast("int"))
    scripts = F.array(*[F.regexp_count(q, F.lit(f"[{body}]")) for body in v.SCRIPTS.values()])
    kana = list(v.SCRIPTS).index("ja")
    by_script = let(scripts, lambda c: F.when(F.get(c, F.lit(kana)) > 0, "ja").when(F.array_max(c) > 0, first(v.SCRIPTS, c)))
    words = F.array_distinct(F.regexp_extract_all(F.lower(q), F.lit(v.MARKER_WORD), F.lit(0)))
    hits = let(words, lambda w: F.array(*[F.size(F.array_intersect(w, F.array(*map(F.lit, sorted(set(ws)))))) for ws in v.MARKERS.values()]))
    by_word = let(hits, lambda h: F.when(F.array_max(h) < 2, "en").otherwise(first(v.MARKERS, h)))
    return F.coalesce(by_script, by_word)


def query_years(q: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(q, F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0))))


def wants_recent(q: Column) -> Column:
    words = F.regexp_extract_all(F.lower(q), F.lit("[a-zà-öø-ÿ]+"), F.lit(0))
    return F.arrays_overlap(words, F.array(*map(F.lit, v.RECENCY)))


def question_key(q: Column) -> Column:
    """Key under which equal questions meet: accents off, content words lower, sorted, unique; null if too long or empty."""
    folded = F.translate(F.lower(q), *ACCENTS)
    key = F.array_join(content_bag(folded), " ")
    return F.when((key != "") & (F.length(key) <= 400), key)


def question_keys(q: Column) -> Column:
    """Keys under which equal questions meet, best first: the question, then without words that name the kind of thing wanted."""
    key = lambda ws: F.array_join(ws, " ")

    def of(ws: Column) -> Column:
        subject = F.filter(ws, lambda w: ~w.isin(*v.GENERIC))
        some = F.when((F.size(subject) > 0) & (F.size(subject) < F.size(ws)), F.array(key(subject))).otherwise(_empty())
        return F.when((F.size(ws) > 0) & (F.length(key(ws)) <= 400), F.concat(F.array(key(ws)), some)).otherwise(_empty())

    return let(content_bag(F.translate(F.lower(q), *ACCENTS)), of)


def title_bag(s: Column) -> Column:
    """Words of a title: of unspaced titles the pieces, else the tokens; distinct."""
    return F.array_distinct(F.when(unspaced(s), F.flatten(F.transform(plain_tokens(s), lambda t: F.when(unspaced(t), pieces(t)).otherwise(F.array(t))))).otherwise(tokens(s)))


def freshness_floor(window: Column, today: Column) -> Column:
    """The first day of a window named day, week, month or year; null for any other name."""
    days = F.lit(None).cast("int")
    for name, n in v.FRESH_DAYS.items():
        days = F.when(window == name, n).otherwise(days)
    return F.date_sub(today, days)


def fold(t: Column) -> Column:
    """A word as web addresses spell it: ä ae, ö oe, ü ue, ß ss, other accents off."""
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("æ", "ae"), ("ø", "oe"), ("å", "aa"), ("œ", "oe")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.translate(t, *ACCENTS)


def _folded_grams(t: Column) -> Column:
    a = F.concat(F.lit("^"), t, F.lit("$"))
    five = F.transform(F.sequence(F.lit(1), F.greatest(F.length(a) - 4, F.lit(1))), lambda i: F.substring(a, i, F.lit(5)))
    two = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    return F.when(unspaced(t), two).when(F.length(t) >= 5, five).otherwise(_empty())


def grams(t: Column) -> Column:
    """Character grams of a folded word: five with anchored ends from five letters on; pairs for Han."""
    return F.array_distinct(F.flatten(F.transform(F.array(fold(t)), lambda x: _folded_grams(x))))


def gram_set(bag: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.transform(bag, lambda t: fold(t)), lambda x: _folded_grams(x)))))


def overlap(hits: Column, left: Column, right: Column) -> Column:
    """recall^.75 precision^.25 of so many hits."""
    return F.when((hits > 0) & (left > 0) & (right > 0), F.pow(hits / left, F.lit(0.75)) * F.pow(hits / right, F.lit(0.25))).otherwise(0.0)


def dice(a: Column, b: Column) -> Column:
    return let(F.size(F.array_intersect(a, b)), lambda n: overlap(n, F.size(a), F.size(b)))


def _worth(t: Column, u: Column) -> Column:
    """How far a folded query word and a folded field word are one: equal, or one long enough inside the other."""
    inside = (F.length(t) >= F.when(unspaced(t), 2).otherwise(5)) & (F.length(u) > F.length(t)) & F.contains(u, t)
    around = (F.length(u) >= F.when(unspaced(u), 2).otherwise(4)) & (F.length(t) > F.length(u)) & F.contains(t, u)
    return F.when(t == u, 1.0).when(inside | around, v.COMPOUND).otherwise(0.0)


def compound_fit(q: Column, field: Column) -> Column:
    """Overlap where a word inside a longer word counts a little less than an equal one."""
    def hits(xs: Column, ys: Column, flip: bool) -> Column:
        best = F.transform(xs, lambda x: F.coalesce(F.array_max(F.transform(ys, lambda y: _worth(y, x) if flip else _worth(x, y))), F.lit(0.0)))
        return F.aggregate(best, F.lit(0.0), lambda a, b: a + b)

    def value(fq: Column, ff: Column) -> Column:
        return F.pow(hits(fq, ff, False) / F.size(fq), F.lit(0.75)) * F.pow(F.least(F.lit(1.0), hits(ff, fq, True) / F.size(ff)), F.lit(0.25))

    whole = let(F.transform(q, lambda t: fold(t)), lambda fq: let(F.transform(field, lambda t: fold(t)), lambda ff: value(fq, ff)))
    return F.when((F.size(q) > 0) & (F.size(field) > 0), whole).otherwise(0.0)


def field_fit(q: Column, field: Column) -> Column:
    """Best of exact overlap, compound overlap and gram overlap (worth less); bags must be distinct."""
    soft = lambda: let(gram_set(q), lambda a: let(gram_set(field), lambda b: v.SOFT * dice(a, b)))
    return let(dice(q, field), lambda exact: F.when(exact >= v.SOFT, exact).otherwise(F.greatest(exact, compound_fit(q, field), soft())))


def best_fit(vocabularies: Column, field: Column) -> Column:
    """Best fit of any one vocabulary, never of their union."""
    return let(field, lambda f: F.coalesce(F.array_max(F.transform(vocabularies, lambda q: field_fit(q, f))), F.lit(0.0)))


def host_fit(domain: Column, q: Column) -> Column:
    """How much of a registered domain's own name the query's words cover."""
    def value(label: Column, terms: Column) -> Column:
        hits = F.filter(terms, lambda t: F.contains(label, t))
        covered = F.aggregate(hits, F.lit(0), lambda a, t: a + F.length(t))
        got = F.pow(F.size(hits) / F.size(terms), F.lit(0.6)) * F.pow(F.least(F.lit(1.0), covered / F.length(label)), F.lit(0.9))
        return F.when((F.length(label) >= 3) & (covered > 0), got).otherwise(0.0)

    own = F.regexp_replace(F.regexp_replace(domain, r"\.[^.]*$", ""), r"[-._]", "")
    return let(own, lambda label: let(F.filter(q, lambda t: F.length(t) >= 3), lambda terms: value(label, terms)))


def parse_date(s: Column) -> Column:
    """Date from the first ten characters by one of five formats, else 1 January of the first year in sight."""
    head = F.substring(F.trim(s), F.lit(1), F.lit(10))
    found = [F.when(F.rlike(head, F.lit(p)), F.try_to_date(head, f)) for p, f in ((r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"), (r"^\d{8}$", "yyyyMMdd"))]
    year = F.nullif(F.regexp_extract(s, r"((?:19|20)\d{2})", 1), F.lit(""))
    return F.coalesce(*found, F.make_date(year.cast("int"), F.lit(1), F.lit(1)))


def freshness(published: Column, today: Column) -> Column:
    """exp(-age in days / 730); 0 without a date, 1 for the future."""
    return F.coalesce(F.exp(-F.greatest(F.datediff(today, published), F.lit(0)) / 730.0), F.lit(0.0))


def date_fit(published: Column, path: Column, title: Column, years: Column) -> Column:
    """-1 to 1: does a page belong to the years that a query names?"""
    year = F.year(published)
    blob = F.lower(F.concat_ws(" ", path, title))
    newest = F.array_max(F.transform(years, lambda y: y.cast("int")))
    return (
        F.when(F.size(years) == 0, 0.0)
        .when(F.array_contains(years, year.cast("string")), 1.0)
        .when(F.exists(years, lambda y: F.contains(blob, y)), 0.8)
        .when(year < newest, -F.least(F.lit(1.0), (newest - year) / 3.0))
        .otherwise(0.0)
    )


def fingerprint(text: Column) -> Column:
    """First forty words and a coarse length; empty under twelve words."""
    words = plain_tokens(text)
    return F.when(F.size(words) < 12, "").otherwise(F.concat(F.array_join(F.slice(words, 1, 40), " "), F.lit("#"), F.floor(F.length(text) / 512).cast("string")))


def prose_factor(w: Column) -> Column:
    """1 for running text, less for what looks like a list."""
    listy = F.regexp_count(w, F.lit(v.LISTY))
    sentences = F.regexp_count(w, F.lit(r"[.!?]\s+[A-ZÄÖÜ0-9]"))
    letters = F.regexp_count(w, F.lit(r"\p{L}"))
    return F.when(F.length(w) == 0, 1.0).when((listy >= 3) & (sentences <= 1), 0.4).when(listy >= 3, 0.7).when(letters * 100 < F.length(w) * 55, 0.7).otherwise(1.0)


def count_tokens(s: Column) -> Column:
    """Tokens at four characters each, at least one unless empty."""
    n = F.coalesce(F.length(s), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.floor(n / 4), F.lit(1))).cast("long")


def truncate(s: Column, max_tokens: Column) -> Column:
    """Cut to so many tokens, at a word if one ends in the last two fifths, with an ellipsis."""
    cut = F.substring(s, F.lit(1), (max_tokens * 4).cast("int"))
    space = F.length(F.regexp_extract(cut, r"(?s)^(.*) [^ ]*$", 1))
    has = F.contains(cut, F.lit(" "))
    cut = F.when(has & (space > F.length(cut) * 0.6), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when((max_tokens <= 0) | (F.length(s) == 0), "").when(count_tokens(s) <= max_tokens, s).otherwise(F.concat(F.rtrim(cut), F.lit(" ...")))
