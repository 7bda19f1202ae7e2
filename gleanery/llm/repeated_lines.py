"""Lines that one site repeats over its documents: PrefixSpan over line-identifier sequences per source.

Every text is normalised once; from then on a page is the list of its lines' 64-bit identifiers. Level one counts
single lines per source in distinct documents. A document's sequence is then its frequent lines in order, and frequent
prefixes are grown over the projected suffixes, other lines allowed in between, until nothing grows. What is removed
are the lines that frequent sequences cover.

Identifiers are spread by (source, line, document), growth by (source, first line): a source that holds a third of all
rows is no hot key. Texts of frequent lines are looked up in one document each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.session import cut

#: Frequent lines (16 bytes each and a source name) up to which their sets are broadcast; beyond, joins shuffle.
BROADCAST_LINES = 500_000
#: Parts into which a source's rows are spread in such a join.
SALTS = 32

#: White space of all scripts for Java's regex, the no-break ones included (fixed values).
SPACE = r"[\s\x0B\x1C-\x1F\x85   -     　]"


def normal_line(line: Column) -> Column:
    """Lower case, runs of white space to one space, trimmed, runs of digits to a single 0."""
    spaced = F.trim(F.regexp_replace(F.lower(line), SPACE + "+", " "))
    return F.regexp_replace(spaced, "[0-9]+", "0")


def normal_text(text: Column) -> Column:
    """All lines of a text normalised at once, still separated by ``\\n``: two regex passes a text, not a line."""
    kept = F.regexp_replace(F.lower(text), r"[\s\x0B\x1C-\x1F\x85   -     　&&[^\n]]+", " ")
    return F.regexp_replace(F.regexp_replace(kept, r" ?\n ?", "\n"), "[0-9]+", "0")


def _lines(text: Column) -> Column:
    return F.transform(F.split(normal_text(text), "\n"), lambda x: F.trim(x))


def page_lines(pages: DataFrame, text: str = "text", source: str = "domain", document: str = "evidence_id") -> DataFrame:
    """``source, document, lines array<long>`` of every row with a source: identifiers of its non-empty lines in order.

    Written once to the shared folder (8 bytes a line): counting, growing and totals read it from there. A null text
    has no lines, a null document is a document like any other.
    """
    lines = F.transform(F.filter(_lines(F.col(text)), lambda x: x != ""), lambda x: F.xxhash64(x))
    rows = pages.where(F.col(source).isNotNull()).select(F.col(source).alias("source"), F.xxhash64(document).alias("document"), F.coalesce(lines, F.array().cast("array<bigint>")).alias("lines"))
    return cut(rows)


def _enough(n: Column, total: Column, least: int, percent: int) -> Column:
    return (n >= least) & (n * 100 >= total * percent)


def _totals(hashed: DataFrame) -> DataFrame:
    return hashed.groupBy("source").agg(F.countDistinct("document").alias("documents"))


GROWN = "source string, documents long, pattern array<long>, support long"
_GROWN = pa.schema([("source", pa.string()), ("documents", pa.int64()), ("pattern", pa.list_(pa.int64())), ("support", pa.int64())])
_FLUSH = 20_000


def prefixspan(
    pages: DataFrame, text: str = "text", source: str = "domain", document: str = "evidence_id", least: int = 5, percent: int = 20, closed: bool = False
) -> DataFrame:
    """``length, source, sequence array<string>, support, documents``: all frequent sequences of lines per source.

    A sequence is frequent if its lines stand in this order, anything allowed in between, in one text of at least
    ``least`` distinct documents and ``percent`` % of all distinct documents of its source. No bound on the length.
    Rows with a null source are left out; null texts count as documents without lines, documents seen repeatedly
    count once. Documents of equal sequences travel as one with a weight, and each (source, first line) is grown
    apart from the others, so a source is spread over its lines. ``closed`` leaves out sequences that a longer one
    of the same texts contains (see ``grow``): single lines are always told, and what they cover is the same.
    """
    hashed = page_lines(pages, text, source, document)
    items = _items(hashed, least, percent)
    spelled = _spell(pages, items, text, source, document)
    single = spelled.select(F.lit(1).alias("length"), "source", F.array("spelling").alias("sequence"), "support", "documents")
    names = spelled.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("line", "spelling"))).alias("names"))
    named = _join_source(_grown(hashed, items, least, percent, closed), names, items.count())
    spelling = F.transform("pattern", lambda x: F.col("names")[x]).alias("sequence")
    return single.unionByName(named.select(F.size("pattern").alias("length"), "source", spelling, "support", "documents"))


def covered_lines(
    pages: DataFrame, text: str = "text", source: str = "domain", document: str = "evidence_id", least: int = 5, percent: int = 20
) -> DataFrame:
    """``source, line_text``: every line that a frequent sequence covers, single lines included; each once.

    Read off the closed sequences that ``prefixspan`` grows. Conditions as there.
    """
    hashed = page_lines(pages, text, source, document)
    items = _items(hashed, least, percent)
    grown = _grown(hashed, items, least, percent, closed=True).select("source", F.explode("pattern").alias("line"))
    covered = items.select("source", "line").unionByName(grown).distinct()
    return _spell(pages, items, text, source, document).join(covered, ["source", "line"], "left_semi").select("source", F.col("spelling").alias("line_text"))


def _grown(hashed: DataFrame, items: DataFrame, least: int, percent: int, closed: bool) -> DataFrame:
    """``source, documents, pattern, support`` of all frequent sequences of two lines and more."""
    known = items.groupBy("source").agg(F.collect_set("line").alias("known"))
    texts = _join_source(hashed, known, items.count()).select("source", "document", F.filter("lines", lambda x: F.array_contains("known", x)).alias("lines")).where(F.size("lines") > 1)
    of = texts.groupBy("source", "document").agg(F.array_sort(F.collect_set("lines")).alias("texts"))
    of = of.groupBy("source", "texts").agg(F.count(F.lit(1)).alias("weight")).join(_totals(hashed), "source")
    begun = of.select("source", "documents", "weight", "texts", F.explode(F.array_distinct(F.flatten("texts"))).alias("first"))
    after = F.transform("texts", lambda x: F.when(F.array_contains(x, F.col("first")), F.slice(x, F.array_position(x, F.col("first")) + 1, F.size(x))))
    begun = begun.select("source", "documents", "first", "weight", F.filter(after, lambda x: F.size(x) > 0).alias("texts")).where(F.size("texts") > 0)
    return begun.groupBy("source", "documents", "first").applyInArrow(_grower(least, percent, closed), GROWN)


def grow(entries: list[tuple[list[list[int]], int]], enough: int, closed: bool = False) -> Iterator[tuple[tuple[int, ...], int]]:
    """All sequences in at least ``enough`` documents, with their support; a document is (its texts, weight).

    Each line is a bitmap of its positions, a block of bits a text with one bit above it. The k-th texts of all
    documents are layer k, at equal offsets, so that a document of several texts counts once. Taking the lowest bit
    of each block leaves, by the borrow, the positions behind the first occurrence of a pattern and, in the bits
    above, the texts that hold it; bit planes of the weights turn these into the support.

    ``closed`` does not grow a pattern whose last line is preceded, behind the rest of the pattern, by one and the same
    other line in every text that holds it: the pattern with that line is in the same texts with the same suffixes,
    so each sequence left out is contained in one that is told, of equal support.
    """
    entries = sorted(entries, key=lambda x: -len(x[0]))
    n = max((len(x[0]) for x in entries), default=0)
    bits: list[dict[int, list[int]]] = [{} for _ in range(n)]
    low: list[list[int]] = [[] for _ in range(n)]
    high: list[list[int]] = [[] for _ in range(n)]
    planes: dict[int, list[int]] = {}
    at = 0
    for texts, weight in entries:
        top = at + max(map(len, texts))
        for k, lines in enumerate(texts):
            low[k].append(at)
            high[k].append(top)
            for i, x in enumerate(lines):
                bits[k].setdefault(x, []).append(at + i)
        for b in range(weight.bit_length()):
            if weight >> b & 1:
                planes.setdefault(b, []).append(top)
        at = top + 1

    def mask(ones: list[int]) -> int:
        out = bytearray(at // 8 + 1)
        for i in ones:
            out[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(out, "little")

    lows, highs = [mask(x) for x in low], [mask(x) for x in high]
    inner = [(h - o) for h, o in zip(highs, lows)]  # all bits of the blocks but those above them
    weights = [(b, mask(x)) for b, x in planes.items()]
    lines = {x: [mask(of.get(x, ())) for of in bits] for x in {x for of in bits for x in of}}
    # a pattern: lines, positions behind it (None: all) by layer, lines that may follow
    stack: list[tuple[tuple[int, ...], list[int] | None, list[int]]] = [((), None, sorted(lines))]
    while stack:
        pattern, behind, candidates = stack.pop()
        children = []
        for x in candidates:
            found, rest, held = 0, [], []
            for k, positions in enumerate(lines[x]):
                b = (positions if behind is None else positions & behind[k]) | highs[k]
                t = b - lows[k]
                held.append(t & highs[k])
                found |= held[k]
                rest.append(inner[k] & ~(t ^ b))
            support = sum((found & m).bit_count() << b for b, m in weights)
            if support >= enough:
                children.append((x, support, rest, held))
        follow = [c[0] for c in children]  # what does not follow the prefix often does not follow a longer one
        for x, support, rest, held in children:
            if closed:
                passed = [(inner[k] if behind is None else behind[k]) & ~rest[k] for k in range(n)]
                if any(y != x and all(not held[k] or not held[k] & ~(((lines[y][k] & passed[k]) | highs[k]) - lows[k]) for k in range(n)) for y in follow):
                    continue
            yield (*pattern, x), support
            stack.append(((*pattern, x), rest, follow))


def _grower(least: int, percent: int, closed: bool):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, documents, first = (x.as_py() for x in key)
        enough = max(least, -(-documents * percent // 100))
        entries = [x for b in batches for x in zip(b.column("texts").to_pylist(), b.column("weight").to_pylist())]
        patterns, supports = [], []

        def batch() -> pa.RecordBatch:
            n = len(patterns)
            return pa.RecordBatch.from_arrays([pa.array([source] * n, pa.string()), pa.array([documents] * n, pa.int64()), pa.array(patterns, pa.list_(pa.int64())), pa.array(supports, pa.int64())], schema=_GROWN)

        if sum(w for _, w in entries) >= enough:
            for pattern, support in grow(entries, enough, closed):
                patterns.append((first, *pattern))
                supports.append(support)
                if len(patterns) >= _FLUSH:
                    yield batch()
                    patterns, supports = [], []
        yield batch()

    return run


def _items(hashed: DataFrame, least: int, percent: int) -> DataFrame:
    """The frequent lines: source, line, support, documents, and the hash of a document that has it; counted once."""
    rows = hashed.select("source", "document", F.explode(F.array_distinct("lines")).alias("line"))
    counted = rows.groupBy("source", "line").agg(F.countDistinct("document").alias("support"), F.min("document").alias("sample"))
    # the absolute bound needs no totals: it discards the mass of unique lines before the join
    items = counted.where(F.col("support") >= least).join(_totals(hashed), "source").where(_enough(F.col("support"), F.col("documents"), least, percent))
    return cut(items)  # small: at most (100 / percent) times the mean lines of a document per source


def _join_source(rows: DataFrame, side: DataFrame, size: int) -> DataFrame:
    """Rows with what their source has: broadcast if the counted lines are few, else joined by source and a salt."""
    if size <= BROADCAST_LINES:
        return rows.join(F.broadcast(side), "source")
    salted = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, ["source", "__salt"]).drop("__salt")


def _spell(pages: DataFrame, items: DataFrame, text: str, source: str, document: str) -> DataFrame:
    """The frequent lines with ``spelling``: only the pages of their sample documents are normalised again."""
    wanted = items.groupBy("source", "sample").agg(F.collect_set("line").alias("wanted"))
    rows = pages.where(F.col(source).isNotNull() & F.col(text).isNotNull()).select(F.col(source).alias("source"), F.xxhash64(document).alias("sample"), F.col(text).alias("text"))
    found = rows.join(F.broadcast(wanted) if items.count() <= BROADCAST_LINES else wanted, ["source", "sample"])
    lines = found.select("source", "wanted", F.explode(F.array_distinct(_lines(F.col("text")))).alias("spelling"))
    spelling = lines.where(F.array_contains("wanted", F.xxhash64("spelling"))).groupBy("source", F.xxhash64("spelling").alias("line")).agg(F.min("spelling").alias("spelling"))
    return items.join(spelling, ["source", "line"])


def remove_repeated(pages: DataFrame, covered: DataFrame, text: str = "text", source: str = "domain", result: str = "clean_text") -> DataFrame:
    """All rows of ``pages`` with ``result``: the text without the lines of its source's frequent sequences.

    ``covered`` has source and line_text, as ``covered_lines`` gives them. The lines of a source are at most
    (100 / percent) times the mean lines of its documents, a bounded array. Rows of a null source or without frequent
    lines keep their text, null stays null.
    """
    known = covered.groupBy("source").agg(F.collect_set(F.xxhash64("line_text")).alias("__known"))
    count = covered.count()
    if count <= BROADCAST_LINES:
        joined = pages.join(F.broadcast(known.withColumnRenamed("source", "__source")), F.col(f"`{source}`") == F.col("__source"), "left")
    else:
        salted = known.select(F.col("source").alias("__source"), "__known", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__side"))
        salt = F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(SALTS)).cast("int")
        joined = pages.withColumn("__salt", salt).join(salted, (F.col(f"`{source}`") == F.col("__source")) & (F.col("__salt") == F.col("__side")), "left")
    raw, plain = F.split(F.col(text), "\n"), _lines(F.col(text))
    kept = F.filter(F.arrays_zip(raw.alias("raw"), plain.alias("plain")), lambda x: (x["plain"] == "") | ~F.array_contains("__known", F.xxhash64(x["plain"])))
    cleaned = F.array_join(F.transform(kept, lambda x: x["raw"]), "\n")
    return joined.select(*[F.col(f"`{c}`") for c in pages.columns], F.when(F.col("__known").isNull(), F.col(text)).otherwise(cleaned).alias(result))
