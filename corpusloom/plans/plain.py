"""Some functions over words and links once more as plain Python, one value at a time: what the SQL of literal cases is worked out with."""

from __future__ import annotations

import math
import re
import unicodedata

from ..functions import values as v

DIGRAPHS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "ø": "oe", "å": "aa", "œ": "oe"}


def han(s: str) -> bool:
    return any("぀" <= c <= "ヿ" or "㐀" <= c <= "䶿" or "一" <= c <= "鿿" or "豈" <= c <= "﫿" for c in s)


def fold(w: str) -> str:
    w = "".join(DIGRAPHS.get(c, c) for c in w)
    return "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))


def grams(w: str) -> set[str]:
    w = fold(w)
    if han(w):
        return {w[i : i + 2] for i in range(max(len(w) - 1, 1))}
    a = f"^{w}$"
    return {a[i : i + 5] for i in range(len(a) - 4)} if len(w) >= 5 else set()


def dice(a, b) -> float:
    a, b = set(a), set(b)
    n = len(a & b)
    return (n / len(a)) ** 0.75 * (n / len(b)) ** 0.25 if n else 0.0


def _worth(q: str, f: str) -> float:
    if q == f:
        return 1.0
    inside = len(q) >= (2 if han(q) else 5) and len(f) > len(q) and q in f
    around = len(f) >= (2 if han(f) else 4) and len(q) > len(f) and f in q
    return v.COMPOUND if inside or around else 0.0


def compound(q, f) -> float:
    q, f = [fold(w) for w in q], [fold(w) for w in f]
    if not q or not f:
        return 0.0
    recall = sum(max(_worth(a, b) for b in f) for a in q) / len(q)
    precision = min(1.0, sum(max(_worth(a, b) for a in q) for b in f) / len(f))
    return recall**0.75 * precision**0.25


def field_fit(q, f) -> float:
    exact = dice(q, f)
    if exact >= v.SOFT:
        return exact
    soft = lambda ws: set().union(*map(grams, ws)) if ws else set()
    return max(exact, compound(q, f), v.SOFT * dice(soft(q), soft(f)))


def best_fit(vocabularies, f) -> float:
    return max((field_fit(q, f) for q in vocabularies), default=0.0)


def host_fit(domain: str, terms) -> float:
    label = re.sub(r"[-._]", "", re.sub(r"\.[^.]*$", "", domain))
    terms = [t for t in terms if len(t) >= 3]
    hits = [t for t in terms if t in label]
    if len(label) < 3 or not hits:
        return 0.0
    return (len(hits) / len(terms)) ** 0.6 * min(1.0, sum(map(len, hits)) / len(label)) ** 0.9


def date_fit(year: int | None, path: str, title: str, years) -> float:
    if not years:
        return 0.0
    if year is not None and str(year) in years:
        return 1.0
    if any(y in f"{path} {title}".lower() for y in years):
        return 0.8
    newest = max(map(int, years))
    return -min(1.0, (newest - year) / 3) if year is not None and year < newest else 0.0


def path_words(path: str) -> tuple[set[str], set[str]]:
    """Whole slugs and the words in them, of a path in ASCII."""
    whole = {t for t in re.findall(r"[a-z0-9][a-z0-9_'+#.\-]*", path.lower()) if t not in v.PATH_STOP}
    whole |= {t.rpartition(".")[0] for t in whole if "." in t[1:] and t.rpartition(".")[2] in v.PATH_STOP}
    parts = {p for t in whole for p in re.split(r"[-_+./:%~]+", t) if len(p) >= 2 and p not in v.PATH_STOP}
    return whole, parts


def link_fit(vocabularies, path: str, anchor, context, said: str, years) -> float:
    """``anchor`` and ``context`` are bags of content words; ``said`` is the anchor's text."""
    by_path = max(best_fit(vocabularies, ws) for ws in path_words(path))
    fit = max(best_fit(vocabularies, anchor), 0.85 * by_path, 0.6 * best_fit(vocabularies, context))
    d = date_fit(None, path, said, years)
    return fit * (1 + 0.6 * d) if d > 0 else fit + 0.30 * d


def weights(intent: str, lang: str, recent: bool, own: dict | None = None) -> dict[str, float]:
    w = dict(v.WEIGHTS) | v.INTENT_WEIGHTS.get(intent, {}) | (v.SCRIPT_WEIGHTS if lang in v.NON_LATIN else {}) | (own or {})
    return w | {"fresh": max(w["fresh"], v.RECENT_FRESH) if recent else w["fresh"]}


def prose(w: str) -> float:
    listy = len(re.findall(v.LISTY, w))
    if listy >= 3:
        return 0.4 if len(re.findall(r"[.!?]\s+[A-ZÄÖÜ0-9]", w)) <= 1 else 0.7
    return 0.7 if sum(c.isalpha() for c in w) < 0.55 * len(w) else 1.0


def log1(x: float) -> float:
    return math.log(1 + x)
