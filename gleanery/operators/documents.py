"""Documents: HTML extraction with the standard library's parser, greedy chunking, evidence documents."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import scalars as S

#: Greedy packing: size of a chunk, what is too small to stand alone (fixed values).
CHUNK, TINY = 3600, 240
#: Bounds of what one page's extraction keeps (fixed values).
MOST = {"links": 500, "images": 200, "headings": 200, "tables": 40, "rows": 200, "jsonld": 20}


def _width_cuts(paragraph: str, size: int, room: int) -> list[str]:
    """An oversized paragraph in pieces of ``size`` characters, the first split once more where ``room`` ends."""
    bounds = sorted({0, *range(size, len(paragraph), size), len(paragraph), *([room] if 0 < room < size else [])})
    return [paragraph[i:j].strip() for i, j in zip(bounds, bounds[1:])]


def _packed(paragraphs: list[str], size: int) -> Iterator[str]:
    """Paragraphs joined while a blank line more fits; oversized ones fill up what is begun and are cut by width."""
    begun: list[str] = []
    used = 0
    for p in paragraphs:
        need = len(p) + 2
        if need > size:
            prefix = "\n\n".join(begun)
            room = size - len(prefix) - 2 if prefix else 0
            pieces = _width_cuts(p, size, room)
            if prefix:
                yield f"{prefix}\n\n{pieces.pop(0)}".strip() if room > 0 else prefix
            yield from (x for x in pieces if x)
            begun, used = [], 0
            continue
        if begun and used + need > size:
            yield "\n\n".join(begun)
            begun, used = [], 0
        begun.append(p)
        used += need
    if begun:
        yield "\n\n".join(begun)


def _tiny_joined(chunks: list[str], size: int, tiny: int) -> list[str]:
    """Tiny chunks go before their successor where both fit, a last one behind its predecessor."""
    out: list[str] = []
    held = ""
    for chunk in chunks:
        if held:
            if len(held) + 2 + len(chunk) <= size:
                chunk = f"{held}\n\n{chunk}"
            else:
                out.append(held)
            held = ""
        if len(chunk) < tiny:
            held = chunk
        else:
            out.append(chunk)
    if held and out and len(out[-1]) + 2 + len(held) <= size:
        out[-1] += f"\n\n{held}"
    elif held:
        out.append(held)
    return out


def chunk_text(text: str | None, size: int = CHUNK, tiny: int = TINY) -> list[str]:
    """A text in chunks of at most ``size`` characters, its paragraphs packed greedily.

    A paragraph beyond the size is cut by width, its beginning filling up the chunk begun before it; a chunk below
    ``tiny`` is carried over to the next one where both fit. Null and blank texts give none; nothing but white space at
    cuts is lost.
    """
    whole = (text or "").strip()
    if len(text or "") <= size:
        return [whole] if whole else []
    paragraphs = [p for p in (x.strip() for x in re.split(r"\n\s*\n", whole)) if p]
    chunks = list(_packed(paragraphs, size))
    return chunks if len(chunks) < 2 else _tiny_joined(chunks, size, tiny)


def chunk_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, chunk_no, chunk, n_chars``: a map over the documents."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, c, len(c)) for k, t in zip(b[key], b[text], strict=True) for i, c in enumerate(chunk_text(t))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "chunk", "n_chars"])

    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, chunk_no int, chunk string, n_chars int")


def normal_url(url: str, base: str = "") -> str:
    """Resolved, scheme and host in lower case, a path at least ``/``, no fragment; empty for what is no web address."""
    try:
        u = urlsplit(urljoin(base, (url or "").strip()))
    except ValueError:
        return ""
    if u.scheme.lower() not in ("http", "https") or not u.netloc:
        return ""
    return urlunsplit((u.scheme.lower(), u.netloc.lower(), u.path or "/", u.query, ""))


class _Page(HTMLParser):
    BLOCK = frozenset("p div section article header footer li ul ol table tr h1 h2 h3 h4 h5 h6 br pre blockquote main aside nav".split())
    DROP = frozenset("script style noscript template svg".split())

    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.title, self.meta, self.links, self.images = base, "", {}, [], []
        self.headings, self.tables, self.jsonld, self.canonical = [], [], [], ""
        self.text, self.main, self.stack, self.grab, self.dropped = [], [], [], None, 0
        self.inside = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in self.DROP:
            self.dropped += 1
            self.grab = [] if tag == "script" and a.get("type", "").lower() == "application/ld+json" else None
        elif tag == "meta":
            name = (a.get("name") or a.get("property") or a.get("itemprop") or "").lower()
            if name and a.get("content", "").strip():
                self.meta.setdefault(name, a["content"].strip())
        elif tag == "link" and a.get("rel", "").lower() == "canonical":
            self.canonical = self.canonical or normal_url(a.get("href", ""), self.base)
        elif tag == "a" and (u := normal_url(a.get("href", ""), self.base)):
            self.links.append(u)
        elif tag == "img" and (u := normal_url(a.get("src", ""), self.base)):
            self.images.append((u, a.get("alt", "").strip()))
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("article", "main"):
            self.inside += 1
        if tag in ("title", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th"):
            self.stack.append((tag, []))
        if tag in self.BLOCK:
            self._put("\n")

    def handle_endtag(self, tag):
        if tag in self.DROP and self.dropped:
            self.dropped -= 1
            if self.grab is not None:
                self.jsonld.append("".join(self.grab))
                self.grab = None
        elif tag in ("article", "main") and self.inside:
            self.inside -= 1
        if self.stack and self.stack[-1][0] == tag:
            _, parts = self.stack.pop()
            got = " ".join("".join(parts).split())
            if tag == "title":
                self.title = self.title or got
            elif tag in ("td", "th"):
                if self.tables and self.tables[-1]:
                    self.tables[-1][-1].append(got)
            elif got:
                self.headings.append((int(tag[1]), got))
        if tag in self.BLOCK:
            self._put("\n")

    def handle_data(self, data):
        if self.dropped:
            if self.grab is not None:
                self.grab.append(data)
            return
        for _, parts in self.stack:
            parts.append(data)
        if not self.stack or self.stack[-1][0] != "title":
            self._put(data)

    def _put(self, s: str) -> None:
        self.text.append(s)
        if self.inside:
            self.main.append(s)


def clean_space(s: str) -> str:
    s = html.unescape(s).replace("\r\n", "\n").replace("\r", "\n")
    s = re.sub(r"[ \t\f\v ]+", " ", s)
    s = re.sub(r" ?\n ?", "\n", s)
    return re.sub(r"\n{3,}", "\n\n", s).strip()


def _dates(value, found: list[str]) -> None:
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            for k in ("datePublished", "dateCreated", "uploadDate", "dateModified"):
                if isinstance(v.get(k), str) and v[k].strip():
                    found.append(v[k].strip())
            stack.extend(v.values())
        elif isinstance(v, list):
            stack.extend(v)


def extract_page(source: str | None, url: str = "") -> dict:
    """What a page holds: title, canonical address, publication date, text, links, images, headings, tables.

    The text is that of article or main elements if it has 200 characters, else the body's. Damaged markup is read as
    far as the parser gets; a null source gives an empty page.
    """
    p = _Page(url)
    try:
        p.feed(source or "")
        p.close()
    except (AssertionError, ValueError):
        pass
    published = next((p.meta[k] for k in ("article:published_time", "datepublished", "date", "pubdate", "dc.date", "og:published_time") if k in p.meta), "")
    if not published:
        found: list[str] = []
        for block in p.jsonld[: MOST["jsonld"]]:
            try:
                _dates(json.loads(block), found)
            except ValueError:
                continue
        published = found[0] if found else ""
    body, main = clean_space("".join(p.text)), clean_space("".join(p.main))
    return {
        "title": p.meta.get("og:title") or p.title,
        "canonical_url": p.canonical or normal_url(p.meta.get("og:url", ""), url) or normal_url(url),
        "published_at": published,
        "text": main if len(main) >= 200 else body,
        "links": list(dict.fromkeys(p.links))[: MOST["links"]],
        "images": [{"url": u, "alt": a} for u, a in dict(p.images).items()][: MOST["images"]],
        "headings": [{"level": n, "text": t} for n, t in p.headings[: MOST["headings"]]],
        "tables": [[r for r in t if r][: MOST["rows"]] for t in p.tables[: MOST["tables"]]],
    }


PAGE = "title string, canonical_url string, published_at string, text string, links array<string>, images array<struct<url: string, alt: string>>, headings array<struct<level: int, text: string>>, tables array<array<array<string>>>"


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """The extraction of every page, then native: key, fields of the page, text hash and document id."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{key: k, **extract_page(s, u or "")} for k, u, s in zip(b[key], b[url], b[source], strict=True)], columns=[key, "title", "canonical_url", "published_at", "text", "links", "images", "headings", "tables"])

    out = pages.select(key, url, source).mapInPandas(run, f"`{key}` {kind}, {PAGE}")
    return out.withColumns({"text_hash": F.sha2("text", 256), "document_id": F.substring(F.sha2(F.concat_ws("\x00", "canonical_url", "title", "text"), 256), 1, 24)})


#: Longest block, and the pieces that longer ones are cut into; fewest paragraphs that are not taken by lines instead.
BLOCK, BLOCK_PIECE, FEW_PARAGRAPHS = 1800, 1400, 3
_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def text_blocks(body: Column) -> Column:
    """All blocks of a text: its paragraphs, its lines where there are three paragraphs or fewer, long ones in pieces."""

    def cleaned(parts: Column) -> Column:
        return F.filter(F.transform(parts, S.clean_space), lambda x: x != "")

    def pieces(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.char_length(x) - 1) / BLOCK_PIECE).cast("int"))
        cut = F.transform(starts, lambda i: S.clean_space(F.substring(x, i * BLOCK_PIECE + 1, F.lit(BLOCK_PIECE))))
        return F.when(F.char_length(x) <= BLOCK, F.array(x)).otherwise(F.filter(cut, lambda y: y != ""))

    text = F.coalesce(body, F.lit(""))
    paragraphs = cleaned(F.split(text, r"\n\s*\n"))
    parts = F.when(F.size(paragraphs) > FEW_PARAGRAPHS, paragraphs).otherwise(cleaned(F.split(text, _LINE_ENDS)))
    return F.flatten(F.transform(parts, pieces))


def evidence_blocks(docs: DataFrame, key: str, title: str, body: str, most: int = 800) -> DataFrame:
    """Ordered blocks of a document: its title, then those of its text; those beyond ``most`` are told as omitted."""
    titled = F.filter(F.array(F.struct(F.lit("title").alias("kind"), S.text(F.col(title)).alias("block"))), lambda b: b["block"] != "")
    made = docs.select(key, F.concat(titled, F.transform(text_blocks(F.col(body)), lambda x: F.struct(F.lit("paragraph").alias("kind"), x.alias("block")))).alias("all"))
    return made.select(key, F.slice("all", 1, most).alias("blocks"), F.greatest(F.size("all") - most, F.lit(0)).alias("omitted"))


def evidence_documents(extracted: DataFrame, key: str = "page_id", most: int = 800) -> DataFrame:
    """Evidence documents of extracted pages: ordered blocks, assets, what was left out, quality and a revision id.

    Blocks are the title, the headings, the text's blocks and the tables' rows as text, numbered in order; ``quality``
    tells what the page had; the revision id is a hash of address and blocks, so an unchanged page keeps it.
    """
    block = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    rows = F.flatten(F.transform("tables", lambda t: F.transform(t, lambda r: block("table_row", F.array_join(r, " | ")))))
    every = F.concat(
        F.array(block("title", F.coalesce("title", F.lit("")))),
        F.transform("headings", lambda h: block("heading", h["text"])),
        F.transform(text_blocks(F.col("text")), lambda x: block("paragraph", x)),
        rows,
    )
    made = extracted.withColumn("all", F.filter(every, lambda b: b["text"] != ""))
    quality = F.struct(
        (F.char_length("text") >= 200).alias("has_main_text"),
        (F.coalesce("published_at", F.lit("")) != "").alias("has_date"),
        (F.coalesce("title", F.lit("")) != "").alias("has_title"),
        F.char_length("text").alias("text_chars"),
    )
    blocks = F.transform(F.slice("all", 1, most), lambda b, i: F.struct(i.alias("ordinal"), b["kind"].alias("kind"), b["text"].alias("text")))
    return made.select(
        key, "document_id", "canonical_url", "title", "published_at", blocks.alias("blocks"), F.transform("images", lambda x: F.struct(F.lit("image").alias("kind"), x["url"].alias("url"), x["alt"].alias("alt"))).alias("assets"),
        F.greatest(F.size("all") - most, F.lit(0)).alias("omitted_blocks"), quality.alias("quality"),
        F.concat(F.lit("rev_"), F.substring(F.sha2(F.concat_ws("\x00", "canonical_url", F.to_json("all")), 256), 1, 24)).alias("revision_id"),
    )
