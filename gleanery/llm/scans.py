"""Repair of text recognised from scanned pages: furniture, broken words, misread characters, paragraphs.

The words of all pages are counted once. Skip-gram vectors are learned over them, and each rare word is linked to
frequent words that plausible glyph edits turn it into (equi-joins on the edited spelling, no pairs within a group);
among several the one whose vector fits the occurrence's neighbours corrects it in context. Running headers, footers
and page numbers are told from a page's edge lines and the scan's own title and first heading; what remains is joined
over line and page ends and reflowed.

Pages find their scan's title and their neighbours by equi-joins on (scan) and (scan, page number); a scan that holds
a third of all pages is split by adaptive skew joins and never collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import cut

#: What a recogniser makes of glyphs: read -> meant (fixed list of look-alikes).
GLYPHS = (
    ("c", "e"), ("f", "t"), ("0", "o"), ("@", "a"), ("j", "i"), ("1", "l"), ("b", "h"), ("q", "g"), ("5", "s"), ("8", "b"), ("cl", "d"), ("ii", "u"), ("rn", "m"), ("vv", "w"), ("ii", "ü"), ("h", "li"), ("rm", "nn"), ("b", "ß"), ("b", "ss"), ("6", "g"), ("6", "b"), ("l", "i"), ("n", "ri"), ("m", "rn"), ("d", "cl"), ("h", "b"), ("e", "c"), ("t", "f"), ("i", "l"), ("g", "q"),
)
#: Edits that no spelling explains otherwise: digits and signs inside words.
STRONG = frozenset("01@58")
#: A word is frequent from this count on; a link needs this ratio of counts, a lower one with a fitting context.
FREQUENT, RATIO, RATIO_IN_CONTEXT, FIT = 4, 24.0, 8.0, 0.2
#: Above this ratio a link holds whatever its context.
SURE = 200.0
VECTOR_SIZE, WINDOW = 24, 3
#: Rows up to which the sides that hold words (frequent words, links, vectors) are broadcast; beyond, joins shuffle.
BROADCAST_WORDS = 1_000_000
#: A longer line is no header.
LONGEST_HEADER = 90

_NUMBER = r"(?:(?=[\w]*\d)[0-9OolIiSsBZGq|]{1,6}|[ivxlcIVXLC]{1,7}|[lOISBZ]{1,4})"
_PAGE_NO = re.compile(rf"[\W_]*(?:(?:[Pp][a@]g[ec]|[Ss]eite|[Pp][áa@]gina|[Pp]\.|S\.)\s*)?{_NUMBER}(?:\s*(?:[o0][ft]|von|d[ec]|sur|/)\s*{_NUMBER})?[\W_]*")
_EDGE_NUMBER = re.compile(rf"^\s*{_NUMBER}\s{{3,}}(?=\S)|(?<=\S)\s{{3,}}{_NUMBER}\s*$")
_BREAK = re.compile(r"[^\W\d_][-¬­‐]\s*$|\w[-¬­‐]\s*$")
_HANGING = frozenset("and or und oder et ou y e o bis to nor sowie".split())
_TOKEN = re.compile(r"[\w@]+(?:[’'][\w@]+)*")
#: A number with letters among its digits.
_ODD_NUMBER = re.compile(r"(?<![\w@])(?=[OolIsSBZ.,:/]*\d)(?=[\d.,:/]*[OolIsSBZ])[\dOolIsSBZ](?:[\dOolIsSBZ]|[.,:/](?=[\dOolIsSBZ]))*k?(?![\w@])")


def skeleton(line: str | None) -> str:
    """A line's letters and digits with look-alikes made equal: equal for a clean line and its misreadings."""
    s = "".join(c for c in (line or "").casefold() if c.isalnum() or c == "@")
    for read, meant in (("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w")):
        s = s.replace(read, meant)
    return s.translate(_SKELETON)


_SKELETON = str.maketrans("cf0@j1bq5l8", "etoaiihgsih")


def edge_key(line: str) -> str:
    """The skeleton of a header or footer without the page number at its side."""
    return skeleton(_EDGE_NUMBER.sub("", line))


@lru_cache(maxsize=1)
def _journal() -> frozenset[str]:
    return frozenset(skeleton(x) for x in ("internal copy", "working paper", "reports", "vol", "interner abdruck", "arbeitspapier", "copia interna", "copie interne", "documento de trabajo", "document de travail", "proceedings", "bulletin", "annals", "quarterly", "journal", "review"))


def split_page(text: str | None, page_no: int | None, title: str | None, heading: str | None) -> tuple[list[int], list[tuple[int, str]]]:
    """Numbers of the running lines and the text lines ``(number, line)`` of a page.

    Running are, from the page's edges: lines of a page number alone; a first line (not on the scan's first page)
    that repeats the scan's title or first heading; a last line with a page number at its side; and the short
    journal line above a last line of a page number alone.
    """
    lines = [(n, raw) for n, raw in enumerate((text or "").split("\n"), 1) if raw.strip()]
    running: list[int] = []
    named = {skeleton(x) for x in (title, heading) if x and len(x) <= LONGEST_HEADER and len(skeleton(x)) >= 4}
    lo, hi = 0, len(lines)
    while lo < hi and _PAGE_NO.fullmatch(lines[lo][1].strip()):
        running.append(lines[lo][0])
        lo += 1
    if lo < hi and (page_no or 1) > 1 and edge_key(lines[lo][1]) in named:
        running.append(lines[lo][0])
        lo += 1
        while lo < hi and _PAGE_NO.fullmatch(lines[lo][1].strip()):
            running.append(lines[lo][0])
            lo += 1
    numbered = False
    while hi > lo and _PAGE_NO.fullmatch(lines[hi - 1][1].strip()):
        hi -= 1
        running.append(lines[hi][0])
        numbered = True
    if hi > lo:
        last = lines[hi - 1][1].strip()
        bare = _EDGE_NUMBER.sub("", last)
        key = skeleton(bare)
        journal = len(bare) <= 60 and not re.search(r"[.;:!?]$", bare) and (any(key.endswith(j) or (j == skeleton("vol") and re.search(j + r"[\dosiq]{1,4}$", key)) for j in _journal()))
        if (bare != last and (journal or len(bare) <= 60 and re.match(r"[^\W\d_]{3,}", bare) and not re.search(r"[\d%]$", bare))) or journal:
            hi -= 1
            running.append(lines[hi][0])
    elif numbered and hi == lo:
        pass
    return sorted(running), lines[lo:hi]


def broken_word(line: str, following: str | None) -> tuple[str, str] | None:
    """Head and tail of a word that the line breaks off and the following text line continues."""
    if following is None or not _BREAK.search(line):
        return None
    head = re.search(r"[\w@’']+(?:-[\w@’']+)*[-¬­‐]\s*$", line)
    tail = re.match(r"\s*[\w@]+", following)
    if not head or not tail or tail[0].strip().casefold() in _HANGING:
        return None
    return re.sub(r"[-¬­‐]\s*$", "", head[0]), tail[0].strip()


def glyph_candidates(word: str) -> list[str]:
    """Spellings that one or two glyph edits turn a misread word into."""
    spots = [(i, read, meant) for read, meant in GLYPHS for i in range(len(word)) if word.startswith(read, i)]
    out = set()
    for n in (1, 2):
        for chosen in combinations(spots, n):
            w, ok, end = word, True, len(word) + 1
            for i, read, meant in sorted(chosen, reverse=True):
                if i + len(read) > end:
                    ok = False
                    break
                w, end = w[:i] + meant + w[i + len(read) :], i
            if ok:
                out.add(w)
    out.discard(word)
    return sorted(out)


# ---------------------------------------------------------------- pages


def scan_pages(media: DataFrame, results: DataFrame, kind: str = "scan_page") -> DataFrame:
    """media_id, scan, page_no, text, confidence: each page once, in its scan.

    A page observed twice is taken once (the greatest text). Scan and page number come from the recognition results
    of any status; a page without results is a scan of its own. Confidences on a scale to 100 are brought to 1.
    """
    pages = media.where(F.col("media_kind") == kind).groupBy("media_id").agg(F.max("ocr_text").alias("text"), F.max("caption").alias("caption"))
    c = F.col("mean_confidence").cast("double")
    of = results.groupBy(F.col("evidence_id").alias("media_id")).agg(
        F.max("source_artifact_id").alias("scan"),
        F.max("page_no").alias("page_no"),
        F.max(F.when((F.col("status") == "ok") & (c > 1), c / 100).when(F.col("status") == "ok", c)).alias("confidence"),
    )
    out = pages.join(of, "media_id", "left")
    return out.select("media_id", F.coalesce("scan", "media_id").alias("scan"), F.coalesce("page_no", F.lit(1)).cast("long").alias("page_no"), "text", "caption", "confidence")


_PARTS = "media_id string, scan string, page_no long, confidence double, running array<int>, numbers array<int>, lines array<string>, blank_before array<boolean>"


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            running, text = split_page(r.text, r.page_no, r.title, r.heading)
            raw = (r.text or "").split("\n")
            blank = [n < 2 or not raw[n - 2].strip() or raw[n - 1][:2].isspace() for n, _ in text]
            rows.append((r.media_id, r.scan, r.page_no, r.confidence, running, [n for n, _ in text], [x for _, x in text], blank))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _PARTS.split(", ")])


def split_pages(pages: DataFrame) -> DataFrame:
    """Every page with its running lines and text lines, and the first and last text lines of its neighbours."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    first = F.struct(F.try_element_at(lines, F.lit(1)).alias("title"), F.try_element_at(lines, F.lit(2)).alias("heading"))
    heads = pages.groupBy("scan").agg(F.min_by(first, F.struct("page_no", "media_id")).alias("h"), F.max("caption").alias("caption"))
    heads = heads.select("scan", F.coalesce("caption", "h.title").alias("title"), F.col("h.heading").alias("heading"))
    parts = cut(pages.join(heads, "scan").select("media_id", "scan", "page_no", "confidence", "text", "title", "heading").mapInPandas(_split, _PARTS))
    edge = parts.groupBy("scan", "page_no").agg(F.min_by("lines", "media_id").alias("l"), F.min_by("numbers", "media_id").alias("n"), F.min("media_id").alias("m"))
    edge = edge.select("scan", "page_no", F.try_element_at("l", F.lit(1)).alias("next_first"), F.try_element_at("n", F.lit(1)).alias("next_no"), F.try_element_at("l", F.lit(-1)).alias("prev_last"), F.col("m").alias("other"))
    nxt = edge.select("scan", (F.col("page_no") - 1).alias("page_no"), "next_first", "next_no", F.col("other").alias("next_media"))
    prv = edge.select("scan", (F.col("page_no") + 1).alias("page_no"), "prev_last")
    return parts.join(nxt, ["scan", "page_no"], "left").join(prv, ["scan", "page_no"], "left")


# ---------------------------------------------------------------- words

_WORDS = "media_id string, line_no int, at int, word string, broken boolean, head string, tail string, tail_media string, tail_no int, confidence double, hyphen boolean, odd boolean, half string"


def _page_tokens(r) -> tuple[list[list], list[tuple]]:
    """Words of a page's text lines in order (broken ones joined, with their halves) and ``(line_no, broken, odd)`` of its lines."""
    lines = list(zip(r.numbers, r.lines, strict=True))
    page: list[list] = []
    marks: list[tuple] = []
    skip = 0
    if len(lines) and r.prev_last is not None and (w := broken_word(r.prev_last, lines[0][1])):
        skip = lines[0][1].find(w[1]) + len(w[1])  # the page before has this word
    for k, (no, line) in enumerate(lines):
        last = k + 1 == len(lines)
        nxt = (r.next_media, r.next_no, r.next_first) if last else (r.media_id, lines[k + 1][0], lines[k + 1][1])
        w = broken_word(line, nxt[2]) if nxt[2] is not None else None
        body = line[: line.rstrip().rfind(w[0])] if w else line
        for m in _TOKEN.finditer(body, skip):
            page.append([no, m[0], False, None, None, None, None])
        skip = 0
        if w:
            page.append([no, w[0] + w[1], True, w[0], w[1], nxt[0], None if nxt[1] is None else int(nxt[1])])
            skip = (lines[k + 1][1].find(w[1]) + len(w[1])) if not last else 0
        marks.append((no, bool(w), bool(_ODD_NUMBER.search(line))))
    return page, marks


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _WORDS.split(", ")]
    for b in batches:
        rows: list[tuple] = []
        for r in b.itertuples(index=False):
            page, marks = _page_tokens(r)
            rows += [(r.media_id, no, -1, None, False, None, None, None, None, r.confidence, broken, odd, None) for no, broken, odd in marks]
            for i, p in enumerate(page):
                rows.append((r.media_id, p[0], i, p[1].casefold(), p[2], p[3], p[4], p[5], p[6], r.confidence, False, False, None))
                if p[2]:  # its halves as words of their own, should the whole be a compound
                    rows.append((r.media_id, p[0], i, p[3].rpartition("-")[2].casefold(), True, p[3], p[4], p[5], p[6], r.confidence, False, False, "head"))
                    if p[5] is not None:
                        rows.append((p[5], p[6], -2 - i, p[4].casefold(), True, p[3], p[4], p[5], p[6], r.confidence, False, False, "tail"))
            if len(rows) > 50_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)


def _sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"media_id": b["media_id"], "words": [[p[1].casefold() for p in _page_tokens(r)[0]] for r in b.itertuples(index=False)]})


def page_words(parts: DataFrame) -> DataFrame:
    """Every word of the text lines (broken words joined) with its place, and a row (at = -1) for each line."""
    return parts.mapInPandas(_tokens, _WORDS)


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(w, c, any(g in STRONG for g in w) and not w.isdigit()) for w in b["word"] for c in glyph_candidates(w)]
        yield pd.DataFrame(rows, columns=["word", "meant", "strong"])


def _side(words: DataFrame) -> DataFrame:
    """A side of a join by word: broadcast if its rows, counted, are few."""
    return F.broadcast(words) if words.count() <= BROADCAST_WORDS else words


def link_words(counts: DataFrame) -> DataFrame:
    """``word, meant, strong, ratio, n``: words and the far more frequent ones that glyph edits turn them into.

    ``counts`` has word and n. Words of two characters on are candidates. Equi-joins by the edited
    spelling; words without letters are left out.
    """
    lettered = counts.where(F.col("word").rlike(r"\p{L}"))
    odd = lettered.select("word").where(F.length("word") >= 2)
    frequent = lettered.where((F.col("n") >= FREQUENT) & ~F.col("word").rlike("[0-9@]")).select(F.col("word").alias("meant"), F.col("n").alias("m"))
    # two edits lengthen or shorten a word by two at most: no longer word can become a frequent one
    longest = F.broadcast(frequent.agg(F.max(F.length("meant")).alias("longest")))
    odd = odd.crossJoin(longest).where(F.length("word") <= F.col("longest") + 2).select("word")
    made = odd.mapInPandas(_candidates, "word string, meant string, strong boolean")
    linked = made.join(_side(frequent), "meant").join(counts, "word")
    ratio = F.col("m") / F.col("n")
    return linked.where((ratio >= RATIO_IN_CONTEXT) | F.col("strong")).select("word", "meant", "strong", ratio.alias("ratio"), "n")


def sentences(parts: DataFrame) -> DataFrame:
    """``media_id, words``: every page as one sentence; a word's place is its index. A map, no word is shuffled."""
    return parts.mapInPandas(_sentences, "media_id string, words array<string>")


def learn_vectors(pages: DataFrame, partitions: int) -> DataFrame:
    """Skip-gram vectors of the frequent words of ``sentences``: ``word, vector array<double>``.

    The model's size is bounded by the vocabulary of words of at least FREQUENT + 1.
    """
    model = Word2Vec(vectorSize=VECTOR_SIZE, windowSize=WINDOW, minCount=FREQUENT + 1, maxIter=1, numPartitions=partitions, stepSize=0.05, seed=7, inputCol="words", outputCol="v", maxSentenceLength=1000).fit(pages.select("words"))
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def _cosine(a, b):
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def corrections(parts: DataFrame, words: DataFrame, counts: DataFrame) -> DataFrame:
    """The misread occurrences with their corrections: columns of ``words`` and ``meant``.

    An occurrence is corrected to the linked word of greatest fit, the cosine between that word's vector and the
    mean of its neighbours' plus a bonus for frequency. A link holds by a high ratio of counts, by a strong sign
    (digit or @ in the word), or by a lower ratio where the context fits; low confidence of the page lowers the
    ratio asked for.
    """
    links = cut(link_words(counts))
    hits = cut(words.where(F.col("word").isNotNull()).join(_side(links), "word"))
    pages = cut(sentences(parts))
    if counts.where(F.col("n") > FREQUENT).isEmpty():  # no word is frequent enough to have a vector
        vectors = words.sparkSession.createDataFrame([], "word string, vector array<double>")
    else:
        vectors = cut(learn_vectors(pages, max(2, words.sparkSession.sparkContext.defaultParallelism)))
    at = F.col("at")
    before, after = F.slice("words", F.greatest(at - WINDOW, F.lit(0)) + 1, F.least(at, F.lit(WINDOW))), F.slice("words", at + 2, F.lit(WINDOW))
    near = hits.where(at >= 0).select("media_id", "at").distinct().join(pages, "media_id").select("media_id", "at", F.explode(F.array_distinct(F.concat(before, after))).alias("word")).join(_side(vectors), "word")
    mean = near.groupBy("media_id", "at").agg(*[F.avg(F.element_at("vector", i + 1)).alias(f"v{i}") for i in range(VECTOR_SIZE)])
    mean = mean.select("media_id", "at", F.array(*[f"v{i}" for i in range(VECTOR_SIZE)]).alias("context"))
    target = _side(vectors.select(F.col("word").alias("meant"), "vector"))
    scored = hits.join(mean, ["media_id", "at"], "left").join(target, "meant", "left")
    fit = F.when(F.col("context").isNull() | F.col("vector").isNull(), F.lit(0.0)).otherwise(_cosine(F.col("context"), F.col("vector")))
    scored = scored.withColumn("fit", fit)
    # ratio, fit and confidence alone: none of them changes when the input grows
    asked = F.lit(RATIO) * F.coalesce(F.greatest(F.lit(0.8), F.least(F.lit(1.0), F.col("confidence"))), F.lit(1.0))
    held = (F.col("ratio") >= asked) & ((F.col("fit") >= 0) | (F.col("ratio") >= SURE))
    good = scored.where(F.col("strong") | held | ((F.col("ratio") >= RATIO_IN_CONTEXT) & (F.col("fit") >= FIT)))
    best = good.groupBy("media_id", "at", "half").agg(F.max_by(F.struct("line_no", "word", "meant", "broken", "head", "tail", "tail_media", "tail_no", "fit", "ratio"), F.struct(F.col("fit") + F.log10("ratio"), F.col("meant"))).alias("b"))
    return best.select("media_id", "at", "half", "b.*")


# ---------------------------------------------------------------- results


def analyse(media: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages in parts, their words, and the corrections."""
    parts = cut(split_pages(scan_pages(media, results)))
    words = cut(page_words(parts))
    spoken = words.where(F.col("word").isNotNull())
    counts = cut(spoken.where(~F.col("broken")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    # broken words count as one where they are known no other way; halves matter only in compounds unknown as one word
    joined = spoken.where(F.col("broken") & F.col("half").isNull())
    unknown = joined.join(counts, "word", "left_anti")
    halves = spoken.where(F.col("half").isNotNull())
    extra = unknown.select("word").union(halves.select("word")).distinct().join(counts, "word", "left_anti")
    fixes = cut(corrections(parts, words, counts.union(extra.select("word", F.lit(1).cast("long").alias("n")))))
    whole = fixes.where(F.col("half").isNull())
    compounds = unknown.select(F.lower("head").alias("h"), F.lower("tail").alias("t")).distinct()
    mended = whole.where("broken").select(F.lower("head").alias("h"), F.lower("tail").alias("t")).distinct()
    open_ = compounds.join(mended, ["h", "t"], "left_anti")
    half = fixes.where(F.col("half").isNotNull()).withColumns({"h": F.lower("head"), "t": F.lower("tail")}).join(open_, ["h", "t"], "left_semi").drop("h", "t")
    return parts, words, whole.unionByName(half)


def noise_lines(media: DataFrame, results: DataFrame) -> DataFrame:
    """``media_id, line_no, noise`` (running, hyphen, misread), each case once. Null and blank texts give none."""
    parts, words, fixes = analyse(media, results)
    running = parts.select("media_id", F.explode("running").alias("line_no"), F.lit("running").alias("noise"))
    lines = words.where(F.col("at") == -1)
    hyphen = lines.where("hyphen").select("media_id", "line_no", F.lit("hyphen").alias("noise"))
    odd = lines.where("odd").select("media_id", "line_no", F.lit("misread").alias("noise"))
    whole = fixes.where(~F.col("broken") | F.col("half").isNotNull()).select("media_id", "line_no", F.lit("misread").alias("noise"))
    cutoff = fixes.where(F.col("broken") & F.col("half").isNull()).withColumn("h", F.lower("head")).withColumn("t", F.lower("tail"))
    in_head = cutoff.where(~F.expr("startswith(meant, h)")).select("media_id", "line_no", F.lit("misread").alias("noise"))
    in_tail = cutoff.where(~F.expr("endswith(meant, t)") | F.expr("startswith(meant, h) and endswith(meant, t)")).select(F.col("tail_media").alias("media_id"), F.col("tail_no").alias("line_no"), F.lit("misread").alias("noise"))
    return running.union(hyphen).union(odd).union(whole).union(in_head).union(in_tail).distinct()


# ---------------------------------------------------------------- reflow

_FRAGMENTS = "scan string, page_no long, media_id string, fragment int, starts boolean, text string, confidence double"
_HEADLIKE = re.compile(r"[.!?:;,…][\"'”»)]*$")


def _cased(read: str, meant: str) -> str:
    """The correction with the capitals of what was read."""
    if len(read) == len(meant):
        return "".join(m.upper() if r.isupper() else m for r, m in zip(read, meant, strict=True))
    return meant.upper() if read.isupper() else meant.capitalize() if read[:1].isupper() else meant


def _reflow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _FRAGMENTS.split(", ")]
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            fixes = {f["word"]: f["meant"] for f in r.fixes} if r.fixes is not None else {}
            open_end = r.prev_last is not None and not re.search(r"[.!?][\"'”»)]*$", r.prev_last.strip())
            parts: list[tuple[bool, str]] = []
            for k, line in enumerate(r.lines):
                text = line.strip()
                if k == 0 and r.prev_last is not None and (w := broken_word(r.prev_last, line)):
                    text = text[text.find(w[1]) + len(w[1]) :]
                nxt = r.lines[k + 1] if k + 1 < len(r.lines) else r.next_first
                w = broken_word(line, nxt) if nxt is not None else None
                glue = " "
                if w:
                    text = re.sub(r"[-¬­‐]\s*$", "", text)
                    kept = "-" if "-" in w[0] or w[1][:1].isdigit() or w[0][-1:].isdigit() else ""
                    text, glue = text + kept, ""
                    if k + 1 == len(r.lines):
                        text += w[1]
                starts = bool(r.blank_before[k]) if k else not open_end
                if k and not r.blank_before[k] and len(r.lines[k - 1].strip()) < 40 and not _HEADLIKE.search(r.lines[k - 1].strip()) and text[:1].isupper() and r.blank_before[k - 1]:
                    starts = True  # after a heading
                if starts or not parts:
                    parts.append((starts, text + glue))
                else:
                    parts[-1] = (parts[-1][0], parts[-1][1] + text + glue)
            if fixes:
                parts = [(s, _TOKEN.sub(lambda m: _cased(m[0], fixes[m[0].casefold()]) if m[0].casefold() in fixes else m[0], t)) for s, t in parts]
            rows += [(r.scan, r.page_no, r.media_id, i, s, t.rstrip(" ") if i + 1 < len(parts) else t, r.confidence) for i, (s, t) in enumerate(parts)]
        yield pd.DataFrame(rows, columns=names)


def paragraphs(media: DataFrame, results: DataFrame) -> DataFrame:
    """The repaired text: ``scan, paragraph_no, first_page, text, confidence``, in reading order.

    Furniture is left out, broken words are joined (a hyphen stays beside a digit or in a word that has another),
    misread words are corrected, lines are joined to paragraphs over page ends. A paragraph's number is a running
    count of beginnings over the scan's pages: only counts per page pass the window, the texts are grouped by paragraph.
    """
    from pyspark.sql import Window

    parts, words, fixes = analyse(media, results)
    known = words.where(F.col("word").isNotNull() & ~F.col("broken")).select("word").distinct()
    compounds = words.where(F.col("broken") & F.col("half").isNull()).join(known, "word", "left_anti").join(fixes.select("media_id", "word").distinct(), ["media_id", "word"], "left_anti")
    compounds = compounds.select("media_id", "word", F.lower(F.concat_ws("-", "head", "tail")).alias("meant"))
    whole = fixes.select("media_id", "word", "meant").union(compounds).groupBy("media_id").agg(F.collect_set(F.struct("word", "meant")).alias("fixes"))
    fragments = cut(parts.join(whole, "media_id", "left").select("scan", "page_no", "media_id", "confidence", "numbers", "lines", "blank_before", "prev_last", "next_first", "fixes").mapInPandas(_reflow, _FRAGMENTS))
    pages = fragments.groupBy("scan", "page_no").agg(F.count_if("starts").alias("n"))
    before = pages.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("scan").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy("scan", "page_no").orderBy("media_id", "fragment").rowsBetween(Window.unboundedPreceding, 0)
    numbered = fragments.withColumn("k", F.sum(F.col("starts").cast("long")).over(inner)).join(before.drop("n"), ["scan", "page_no"])
    numbered = numbered.withColumn("paragraph_no", F.col("before") + F.col("k"))
    grouped = numbered.groupBy("scan", "paragraph_no").agg(F.sort_array(F.collect_list(F.struct("page_no", "media_id", "fragment", "text"))).alias("f"), F.min("page_no").alias("first_page"), F.min("confidence").alias("confidence"))
    return grouped.select("scan", "paragraph_no", "first_page", F.trim(F.array_join(F.transform("f", lambda x: x["text"]), "")).alias("text"), "confidence")
