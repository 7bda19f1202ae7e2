"""Cutting oversized texts into overlapping pieces at natural boundaries, inside the JVM.

The cores of the pieces tile the text: one ``regexp_extract_all`` with bounded quantifiers, whose alternatives are
ordered by boundary strength (rest of the text, paragraph, line, sentence, clause, word, bare characters). Array
functions turn core lengths into offsets, and looking back from each offset supplies the overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the room that a piece must fill before a boundary may end it.
LEAST_FILL = 0.5

_BOUNDARIES = (
    r"(?<=\n[ \t]{0,8}\r?\n)",  # paragraph
    r"(?<=\n|\r)",  # line
    r"(?<=[.!?…][\"'”»)\]]{0,2}\s)",  # sentence
    r"(?<=[,;:]\s)",  # clause
    r"(?<=\s)",  # word
)


def _pattern(room: Column) -> Column:
    """The regex for cores of at most ``room`` characters."""
    least = F.greatest(F.lit(1), (room * LEAST_FILL).cast("int"))
    r, m = room.cast("string"), least.cast("string")
    # a low surrogate never stands alone: '.' takes whole code points
    parts = [F.concat(F.lit(r".{1,"), r, F.lit(r"}\z"))]
    parts += [F.concat(F.lit(".{"), m, F.lit(","), r, F.lit("}" + b)) for b in _BOUNDARIES]
    parts.append(F.concat(F.lit(".{1,"), r, F.lit("}")))
    return F.concat(F.lit("(?s)(?:"), F.array_join(F.array(*parts), "|"), F.lit(")"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: Catalyst would repeat it at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_STRIDE = 128


def _running_sums(sizes: Column) -> Column:
    """Running sums of an array: sums of whole strides first, then within a stride, so no step copies what is done."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda s, n: s + n)

    def within(strides: Column) -> Column:
        def at(_, i: Column) -> Column:
            k = F.floor(i / _STRIDE).cast("int")
            return F.get(strides, k) + total(F.slice(sizes, k * _STRIDE + 1, i - k * _STRIDE + 1))

        return F.transform(sizes, at)

    starts = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _STRIDE).cast("int"))
    totals = F.transform(starts, lambda k: total(F.slice(sizes, k * _STRIDE + 1, F.lit(_STRIDE))))
    summed = F.aggregate(totals, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, F.lit(-1)) + n)))
    return _let(summed, within)


def split_pieces(text: Column, max_size: Column, overlap: Column) -> Column:
    """``array<struct<start int, core_start int, piece string>>`` of a text, by code points.

    Each piece has at most ``max_size`` characters; all but the first begin with the last ``overlap`` characters
    before their core, so dropping the overlaps gives the text back. A text that fits is one piece, an empty text
    is one empty piece, a null text or null limit gives null. An overlap that leaves no room (>= max_size) is cut
    to max_size - 1. ``start`` is where the piece begins in the text, zero-based. The work grows in proportion to the
    text: cores come out of one pass, and a piece is its core behind the last characters of the cores before it.
    """
    lap = F.greatest(F.lit(0), F.least(F.coalesce(overlap, F.lit(0)), max_size - 1))

    room = max_size - lap
    # every core but the last has at least this many characters, so so many cores before one hold its overlap
    before = F.ceil(lap / F.greatest(F.lit(1), (room * LEAST_FILL).cast("int"))).cast("int")

    def tiled(head: Column) -> Column:
        # the first core has no overlap before it, so it may use that room too
        rest = F.substring(text, F.char_length(head) + 1, F.char_length(text))
        return F.concat(F.array(head), F.regexp_extract_all(rest, _pattern(room), F.lit(0)))

    def cut(cores: Column) -> Column:
        def piece(pair: Column, i: Column) -> Column:
            first = F.greatest(i - before, F.lit(0))
            back = F.array_join(F.slice(cores, first + 1, i - first), "")
            core = pair["end"] - F.char_length(pair["core"])
            start = F.greatest(F.lit(0), core - F.when(i == 0, 0).otherwise(lap)).cast("int")
            return F.struct(start.alias("start"), core.cast("int").alias("core_start"), F.concat(F.right(back, core - start), pair["core"]).alias("piece"))

        sizes = F.transform(cores, lambda c: F.char_length(c))
        return F.transform(F.arrays_zip(cores.alias("core"), _running_sums(sizes).alias("end")), piece)

    many = _let(F.regexp_substr(text, _pattern(max_size)), lambda head: _let(tiled(head), cut))
    one = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("core_start"), text.alias("piece")))
    return F.when(text.isNull() | max_size.isNull(), None).when(F.char_length(text) <= max_size, one).otherwise(many)


def least_pieces(n_chars: Column, max_size: Column, overlap: Column) -> Column:
    """The least number of pieces any cutting needs: 1, or 1 + ceil((n - max) / (max - overlap)); 0 for null."""
    lap = F.greatest(F.lit(0), F.least(F.coalesce(overlap, F.lit(0)), max_size - 1))
    more = F.ceil((n_chars - max_size) / (max_size - lap)).cast("long") + 1
    return F.when(n_chars.isNull(), F.lit(0).cast("long")).when(max_size.isNull() | (n_chars <= max_size), F.lit(1).cast("long")).otherwise(more)


def with_limits(items: DataFrame, limits: DataFrame, unit: str = "chars") -> DataFrame:
    """Items with the ``max_size`` and ``overlap_size`` of their source_kind (null where none is set).

    The limits are at most one row per source kind; Spark broadcasts them by their size, or joins otherwise.
    """
    lim = limits.where((F.col("unit") == unit) & F.col("source_kind").isNotNull()).groupBy("source_kind")
    lim = lim.agg(F.min("max_size").alias("max_size"), F.max("overlap_size").alias("overlap_size"))
    return items.join(lim, "source_kind", "left")


def split_items(items: DataFrame, limits: DataFrame, text: str = "text", keys: tuple[str, ...] = ("event_id", "evidence_id")) -> DataFrame:
    """One row per distinct item with its pieces: keys, source_kind, n_chars, n_pieces, least, pieces.

    Rows that repeat an item (same keys, kind and text) count once. Pieces of null texts are null and n_pieces 0.
    """
    cols = [F.col(f"`{k}`") for k in keys]
    base = items.select(*cols, "source_kind", F.col(f"`{text}`").alias("__text"))
    lim = with_limits(base, limits)
    pieces = split_pieces(F.col("__text"), F.col("max_size"), F.col("overlap_size"))
    return lim.select(
        *cols,
        "source_kind",
        F.char_length("__text").alias("n_chars"),
        "max_size",
        "overlap_size",
        F.when(F.col("max_size").isNull() & F.col("__text").isNotNull(), F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("core_start"), F.col("__text").alias("piece")))).otherwise(pieces).alias("pieces"),
    ).withColumns({"n_pieces": F.coalesce(F.size("pieces"), F.lit(0)), "least": least_pieces(F.col("n_chars"), F.col("max_size"), F.col("overlap_size"))})


def judge_runs(runs: DataFrame, items: DataFrame, limits: DataFrame) -> DataFrame:
    """expected_chunks of canary runs against the least number of pieces of the captures of their evidence.

    An evidence id is captured anew by later events, so it has a set of possible counts; a run agrees if its
    value lies between the sums of the least and of the greatest count. ``verdict``: missing (null value),
    unknown (an evidence id without rows), agrees or differs. One row per run row.
    """
    lim = with_limits(items.select("evidence_id", "source_kind", F.char_length("text").alias("n_chars")), limits)
    per = lim.groupBy("evidence_id").agg(
        F.min(least_pieces(F.col("n_chars"), F.col("max_size"), F.col("overlap_size"))).alias("lo"),
        F.max(least_pieces(F.col("n_chars"), F.col("max_size"), F.col("overlap_size"))).alias("hi"),
    )
    ids = runs.select("run_id", F.explode_outer("evidence_ids").alias("evidence_id")).distinct()
    sums = ids.join(per, "evidence_id", "left").groupBy("run_id").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), F.count_if(F.col("lo").isNull()).alias("unknown"))
    e = F.col("expected_chunks")
    verdict = F.when(e.isNull(), "missing").when(F.col("unknown") > 0, "unknown").when(e.between(F.col("lo"), F.col("hi")), "agrees").otherwise("differs")
    return runs.select("run_id", "status", "expected_chunks").join(sums, "run_id", "left").select("run_id", "status", "expected_chunks", F.col("lo").alias("least_pieces"), F.col("hi").alias("most_pieces"), verdict.alias("verdict"))
