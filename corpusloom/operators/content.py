"""From raw bodies to pages: character sets, JSON and PDF beside HTML, and Markdown."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import extract

JSON_CHARS, PDF_PAGES, MARKDOWN_HTML = 60_000, 12, 2_000_000
HEADER_CHARSET = re.compile(r"charset=[\"']?([\w.:-]+)", re.I)
META_CHARSET = re.compile(rb"<meta[^>]+charset=[\"']?([\w.:-]+)", re.I)


def decoded(body: bytes, ctype: str | None) -> str:
    """Text of a body: by the header's character set, else the one a page names in its first 2 KB, else UTF-8; what can't be decoded is replaced."""
    named = HEADER_CHARSET.search(ctype or "")
    meta = META_CHARSET.search(body[:2048])
    for name in (named and named[1], meta and meta[1].decode("ascii", "replace")):
        if name:
            try:
                return body.decode(name, "replace")
            except LookupError:
                continue
    return body.decode("utf-8", "replace")


# ---------------------------------------------------------------- PDF

STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n", re.S)
SHOWN = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|T\*|T[dDJj]|'|ET|BT", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _string(raw: bytes) -> str:
    """A PDF string, literal or hexadecimal."""
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return raw.decode("utf-16", "replace") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("latin-1")


def _said(content: bytes) -> str:
    """What a page's content shows, a line for each move to a new one."""
    lines, line, held = [], [], []
    for m in SHOWN.finditer(content):
        t = m[0]
        if t[:1] in (b"(", b"<"):
            held.append(_string(t))
        elif t in (b"Tj", b"TJ", b"'"):
            if t == b"'":
                lines.append("".join(line))
                line = []
            line += held
            held = []
        else:
            held = []
            if line:
                lines.append("".join(line))
                line = []
    return "\n".join(x.strip() for x in [*lines, "".join(line)] if x.strip())


def pdf(body: bytes, url: str) -> dict:
    """Title, date and text of the first pages of a PDF whose text is in plain or deflated streams; encrypted or scanned files have none."""
    texts = []
    for m in STREAM.finditer(body):
        end = body.find(b"endstream", m.end())
        raw = body[m.end() : end if end >= 0 else len(body)]
        if b"FlateDecode" in m[1]:
            try:
                raw = zlib.decompressobj().decompress(raw, 8_000_000)
            except zlib.error:
                continue
        if b"BT" in raw and (b"Tj" in raw or b"TJ" in raw or b"'" in raw):
            texts.append(_said(raw))
        if len(texts) == PDF_PAGES:
            break
    text = "\n\n".join(filter(None, texts))
    info = lambda key: (m := re.search(rb"/" + key + rb"\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)", body, re.S)) and _string(m[1]).strip() or ""
    name = re.sub(r"\.pdf$", "", url.split("?")[0].rstrip("/").rpartition("/")[2], flags=re.I)
    headline = next((x for x in text.split("\n") if 8 <= len(x) <= 200 and any(map(str.isalpha, x))), "")
    title = next((t for t in (info(b"Title"), headline, re.sub(r"[-_]+", " ", name)) if t and not re.fullmatch(r"(?i)untitled.*|microsoft word.*", t)), "")
    day = re.match(r"D:(\d{4})(\d\d)?(\d\d)?", info(b"CreationDate"))
    return {"title": title[:300], "published": f"{day[1]}-{day[2] or '01'}-{day[3] or '01'}" if day else "", "text": extract.clean(text)}


# ---------------------------------------------------------------- Markdown

MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


def markdown(html: str | None, url: str | None) -> str:
    """The page's content as Markdown: headings, paragraphs, lists, quotes, code, emphasis and links; empty for very large pages."""
    if not html or len(html) > MARKDOWN_HTML:
        return ""
    try:
        dom = extract.Dom(html)
    except (AssertionError, ValueError, IndexError):
        return ""
    extract.strip_boilerplate(dom)
    main = next((e for e in dom.all if extract.is_main(e) and not e.gone), dom.first("body") or dom.root)
    base = url or ""

    def inline(e) -> str:
        out = []
        for x in e.flow:
            if isinstance(x, str):
                out.append(re.sub(r"\s+", " ", x))
            elif not x.gone and x.tag not in extract.LINES | {"ul", "ol", "table"}:
                inner = inline(x)
                if x.tag in MARKS and inner.strip():
                    inner = f"{MARKS[x.tag]}{inner.strip()}{MARKS[x.tag]}"
                elif x.tag == "a" and (to := extract.absolute(base, x.attrs.get("href", ""))) and inner.strip():
                    inner = f"[{inner.strip()}]({to})"
                out.append(inner)
            elif not isinstance(x, str) and x.tag == "br":
                out.append("\n")
        return "".join(out)

    blocks: list[str] = []
    todo: list[tuple] = [(main, "")]
    while todo:
        e, lead = todo.pop()
        if e.gone:
            continue
        said = e.text() if e.tag == "pre" else inline(e)
        said = f"```\n{said.strip()}\n```" if e.tag == "pre" and said.strip() else said.strip()
        if said:
            mark = "#" * int(e.tag[1]) + " " if re.fullmatch("h[1-6]", e.tag) else "- " if e.tag == "li" else lead
            blocks.append(mark + said)
        if e.tag != "pre":
            todo.extend((c, "> " if e.tag == "blockquote" else lead) for c in reversed(e.flow) if not isinstance(c, str) and (c.tag in extract.LINES or c.tag in ("ul", "ol", "table")))
    out: list[str] = []
    for b in blocks:
        out.append(("\n" if out and b.startswith("- ") and out[-1].lstrip("\n").startswith("- ") else "\n\n") + b)
    return "".join(out).strip()


# ---------------------------------------------------------------- all kinds


def page(body: bytes | None, ctype: str | None, url: str | None, body_date=None) -> dict:
    """All that is read off one body, by its type or its first bytes.

    ``body_date`` finds a date in html that states none, if given: (html) to ISO text.
    """
    ctype, url = (ctype or "").lower(), url or ""
    if not body:
        return extract.page(None, url)
    if "application/pdf" in ctype or body[:5] == b"%PDF-":
        return extract.page(None, url) | pdf(body, url)
    if "json" in ctype:
        raw = decoded(body, ctype)
        try:
            said = json.dumps(json.loads(raw), ensure_ascii=False, indent=1)
        except ValueError:
            said = raw
        return extract.page(None, url) | {"text": said[:JSON_CHARS]}
    html = decoded(body, ctype)
    got = extract.page(html, url)
    if body_date is not None and not got["published"] and len(html) <= 300_000:
        got["published"] = (body_date(html) or "")[:32]
    return got


def pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "body", type_col: str = "content_type", body_date=None) -> DataFrame:
    """As ``extract.pages``, from bodies in bytes with their content types; null bodies give empty pages."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["title", "description", "published", "lang", "canonical", "text", "links", "favicon", "images", "search_url"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [page(b, t, u, body_date) for u, b, t in zip(frame["url"], frame["body"], frame["type"], strict=True)]
            out = {"id": frame["id"], "url": frame["url"]} | {n: [g[n] for g in got] for n in names}
            out["links"] = [[{"url": a, "anchor": b, "context": c} for a, b, c in g] for g in out["links"]]
            yield pd.DataFrame(out)

    x = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(body_col).cast("binary").alias("body"), F.col(type_col).alias("type"))
    schema = f"id {kind}, url string, title string, description string, published string, lang string, canonical string, text string, links {extract.LINK_TYPE}, favicon string, images array<string>, search_url string"
    return x.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def as_markdown(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``df`` with a column ``markdown``; meant for ranked rows, not for a corpus."""
    run = F.pandas_udf(lambda h, u: pd.Series([markdown(a, b) for a, b in zip(h, u, strict=True)]), "string")
    return df.withColumn("markdown", run(F.col(html_col), F.col(url_col)))
