"""Scalar building blocks as native column expressions; every one takes and gives columns.

Empty text is the engine's missing value: ``first_text`` and friends never give null where the model asks for text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trims and slugs treat alike (ASCII and the no-break space).
WS = " \t\n\r\x0b\x0c "


def ws_trim(c: Column) -> Column:
    """Trim of all white space, where Spark's own ``trim`` takes spaces only."""
    return F.btrim(c, F.lit(WS))


def text(c: Column) -> Column:
    """Trimmed text, empty for null."""
    return F.coalesce(ws_trim(c), F.lit(""))


def first_text(*cs: Column) -> Column:
    """The first that is not blank, else empty."""
    return F.coalesce(*[F.nullif(ws_trim(c), F.lit("")) for c in cs], F.lit(""))


# ------------------------------------------------------------------ identities


def stable_hash(*parts: Column) -> Column:
    """SHA-256 over the parts, each closed by a NUL; null counts as empty."""
    nul = F.lit("\x00")
    return F.sha2(F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("")), nul) for p in parts]), 256)


def short_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(stable_hash(*parts), 1, 24))


def uuid_from(*parts: Column) -> Column:
    h = stable_hash(*parts)
    at, out = 1, []
    for n in (8, 4, 4, 4, 12):
        out.append(F.substring(h, at, n))
        at += n
    return F.concat_ws("-", *out)


def short_sha1(n: int, *parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, n)


def base64url(c: Column) -> Column:
    """Unpadded base64 of the URL alphabet."""
    return F.rtrim(F.translate(F.base64(c.cast("binary")), "+/", "-_"), F.lit("="))


def artifact_path(kind: str, sha: Column, ext: str) -> Column:
    return F.concat_ws("/", F.lit(kind), F.substring(sha, 1, 2), F.substring(sha, 3, 2), F.concat(sha, F.lit(f".{ext}")))


# ------------------------------------------------------------------ text


def slug(c: Column, sep: str = "_") -> Column:
    """Lower case, runs of anything but a-z and 0-9 to one separator, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(ws_trim(c)), "[^a-z0-9]+", sep), F.lit(sep))


def slug_letters(c: Column, sep: str = "-", default: str = "document") -> Column:
    """The slug that keeps letters and digits of all scripts."""
    s = F.btrim(F.regexp_replace(F.lower(ws_trim(c)), r"[^\p{L}\p{N}]+", sep), F.lit(sep))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def handle(c: Column) -> Column:
    """Trimmed, one leading @ off, lower case."""
    return F.lower(F.regexp_replace(text(c), "^@", ""))


def contains_any(haystack: Column, *needles: str) -> Column:
    return reduce(lambda a, b: a | b, [haystack.contains(n) for n in needles])


def truncate(c: Column, n: int) -> Column:
    return F.rtrim(F.substring(c, 1, n))


def snippet(c: Column, n: int = 900) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def markdown_title(c: Column) -> Column:
    """The first heading's text, empty where there is none."""
    return ws_trim(F.coalesce(F.regexp_extract(c, r"(?m)^\s*#+\s*(\S.*)$", 1), F.lit("")))


def urls_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"""https?://[^\s<>"')\]]+"""), F.lit(0)))


def paragraphs(c: Column) -> Column:
    """Blank-line separated parts, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(ws_trim(c), r"\n[ \t\r]*\n"), ws_trim), lambda x: x != "")


def letters_upper(c: Column) -> Column:
    """Upper case with everything but letters and digits left out (for comparing recognised text)."""
    return F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", "")


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def clean_space(c: Column) -> Column:
    """Line ends made equal, blanks collapsed, at most one empty line, trimmed."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t\x0b\x0c ]+", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    return ws_trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


# ------------------------------------------------------------------ web addresses


def host(url: Column) -> Column:
    """Lower-case host without port and leading ``www.``; empty for what is no URL."""
    return F.regexp_replace(host_raw(url), r"^www\.", "")


def host_raw(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def hosts(urls: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(urls, host), lambda x: x != ""))


STATUS_URL = r"(?i)(?:x|twitter)\.com/([^/\s?#]+)/status/(\d+)"


def status_handle(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, STATUS_URL, 1), F.lit("")))


def status_id(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, STATUS_URL, 2), F.lit(""))


def capture_kind(page_url: Column) -> Column:
    """The kind of a capture without records, by its page's host (substrings count)."""
    h = host(page_url)
    return (
        F.when(text(page_url) == "", "capture")
        .when(contains_any(h, "x.com", "twitter.com"), "x_page")
        .when(h.contains("google."), "google_search_page")
        .otherwise("web_page")
    )


# ------------------------------------------------------------------ time


_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def instant(c: Column) -> Column:
    """The instant that a text names in one of the accepted layouts; null otherwise."""
    return F.coalesce(*[F.try_to_timestamp(ws_trim(c), F.lit(f)) for f in _FORMATS])


def time_text(c: Column, as_of: Column) -> Column:
    """Accepted layouts as RFC 3339 in UTC, other text unchanged, empty as ``as_of``."""
    t = instant(c)
    shown = F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.regexp_replace(F.date_format(t, ".SSSSSS"), "0+$", ""), r"^\.$", ""), F.lit("Z"))
    return F.when(text(c) == "", as_of).otherwise(F.coalesce(shown, c))


def day_text(c: Column) -> Column:
    """UTC day of a time text, else its first ten characters."""
    return F.coalesce(F.date_format(instant(c), "yyyy-MM-dd"), F.substring(c, 1, 10))


def date_precision(c: Column) -> Column:
    n = F.char_length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, "unknown").when(c.contains("T"), "datetime").when(n >= 10, "day").when(n >= 7, "month").when(n >= 4, "year").otherwise("unknown")


#: Frames of the activity view: name -> (window in minutes, bucket in minutes), fixed values.
FRAMES = {"15m": (15, 1), "1h": (60, 2), "6h": (360, 10), "24h": (1440, 30), "7d": (10080, 240), "30d": (43200, 1440)}


def bucket(ts: Column, minutes: int) -> Column:
    """Start of the epoch-aligned bucket that a time without zone falls into."""
    s = F.unix_timestamp(ts.cast("timestamp"))
    return F.timestamp_seconds(s - F.pmod(s, F.lit(minutes * 60))).cast("timestamp_ntz")


# ------------------------------------------------------------------ lists


def clean_list(c: Column) -> Column:
    """Trimmed items, empties dropped, first occurrence kept; null as empty list."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: text(x)), lambda x: x != ""))


def http_only(c: Column) -> Column:
    return F.filter(c, lambda x: F.lower(x).startswith("http"))


# ------------------------------------------------------------------ numbers and flags


def percent(part: Column, total: Column) -> Column:
    """Clamped 0..100, half to even; 0 for no total."""
    return F.when(total <= 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.bround(part * 100.0 / total, 0).cast("int"))))


def boolish(c: Column) -> Column:
    return F.lower(text(c)).isin("true", "1", "yes")


def boolish_or_number(c: Column) -> Column:
    """Set flags: true, 1 and yes, and numbers other than zero; never null."""
    number = ws_trim(c).try_cast("double")
    return F.coalesce(boolish(c) | F.coalesce(number != 0, F.lit(False)), F.lit(False))


def tristate(value: str | None) -> bool | None:
    """A request's flag: true, false, or not given."""
    v = (value or "").strip().lower()
    return True if v in ("1", "true", "yes", "on") else False if v in ("0", "false", "no", "off") else None


def clamp(value: int | None, default: int, most: int) -> int:
    return max(1, min(most, default if value is None else value))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in doubles; 0 where one has no length."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, zero, lambda s, x: s + x.cast("double") * x.cast("double")))

    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), zero)


#: File endings and their media types (fixed list).
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "pdf": "application/pdf", "mp4": "video/mp4", "mov": "video/quicktime", "webm": "video/webm"}


def mime_of(path: Column, default: str = "image/png") -> Column:
    ending = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ending), F.lit(default))


# ------------------------------------------------------------------ claims


def claim_parts(c: Column) -> Column:
    """``struct<subject, property, value, scoped>`` of a claim: split at the first colon, else at `` is ``.

    The property is the last word of a subject of several words; a text without either sign is its own value.
    """
    t = text(c)
    colon = t.contains(":")
    is_at = F.lower(t).contains(" is ") & t.contains(" is ")
    subject = F.when(colon, ws_trim(F.substring_index(t, ":", 1))).when(is_at, ws_trim(F.substring_index(t, " is ", 1))).otherwise(F.lit(""))
    value = F.when(colon, ws_trim(F.regexp_extract(t, r"(?s)^[^:]*:(.*)$", 1))).when(is_at, ws_trim(F.regexp_extract(t, r"(?s)^.*? is (.*)$", 1))).otherwise(t)
    return F.struct(subject.alias("subject"), value.alias("value"), (subject != "").alias("scoped"))


# ------------------------------------------------------------------ JSON


def json_text(c: Column, *paths: str) -> Column:
    """The first non-empty scalar among JSON paths of a text column, else empty."""
    return first_text(*[F.get_json_object(c, p) for p in paths])


def canonical_json(c: Column) -> Column:
    """Compact JSON with sorted keys; null for what is no JSON."""
    return F.to_json(F.try_parse_json(c))


def text_fields(shown: Column) -> Column:
    """From an object's JSON text, its scalar fields as one cleaned map of texts: trimmed, integral numbers without decimals, no empties.

    Objects and lists are left out. One pass over the object, however many aliases are read from it afterwards.
    """
    return scalar_fields(F.from_json(shown, "map<string,string>"))


def scalar_fields(raw: Column) -> Column:
    """The scalar fields of a map of an object's fields as texts; see ``text_fields``. A text that only begins like a
    list or object is a text."""

    def clean(_, x: Column) -> Column:
        return F.when(x.rlike(r"^\s*[\[{]") & F.try_parse_json(x).isNotNull(), F.lit("")).otherwise(F.regexp_replace(ws_trim(x), r"^(-?\d+)\.0+$", "$1"))

    return F.map_filter(F.transform_values(raw, clean), lambda k, x: x != "")


def first_field(fields: Column, *names: str) -> Column:
    """The first of an object's fields that is there, else empty."""
    return F.coalesce(*[fields[n] for n in names], F.lit(""))


def list_field(shown: Column) -> Column:
    """A list field from its JSON text: scalars as they are, of objects the first naming field; a scalar as a list of one.

    The text is mentioned several times: give a column that an earlier projection has made.
    """
    naming = [f"$.{n}" for n in ("name", "text", "label", "url", "expanded_url", "id")]

    def item(x: Column) -> Column:
        return F.when(x.startswith("{"), first_text(*[F.get_json_object(x, p) for p in naming])).otherwise(text(x))

    many = F.transform(F.from_json(shown, "array<string>"), item)
    one = F.when(~shown.rlike(r"^[\[{]") & (text(shown) != ""), F.array(text(shown)))
    return clean_list(F.when(shown.startswith("["), many).otherwise(one))


def first_int(*cs: Column) -> Column:
    """The first whole number among values of any kind, decimals cut off; 0 where there is none."""
    return F.coalesce(*[F.coalesce(c.try_cast("bigint"), c.try_cast("double").cast("bigint")) for c in cs], F.lit(0).cast("bigint"))


def float_list(shown: Column) -> Column:
    """The numbers of a JSON list, what is none left out; null for what is no list."""
    return F.filter(F.transform(F.from_json(shown, "array<string>"), lambda x: x.try_cast("float")), lambda x: x.isNotNull())


def has_any(fields: Column, *names: str) -> Column:
    """Whether an object's fields (a map of texts) hold any of the names with something in it."""
    return reduce(lambda a, b: a | b, [F.coalesce(~fields[n].isin("", "[]"), F.lit(False)) for n in names])


def sizes_of(lists: Column) -> Column:
    """The sizes of a map's lists."""
    return F.transform_values(lists, lambda k, v: F.size(v))


def target_count(n: Column) -> Column:
    """How many are aimed at: one more than there are, at least two, at most eight."""
    return F.greatest(F.lit(2), F.least(F.lit(8), n + 1))


def confidence(mean: Column) -> Column:
    return F.coalesce(mean.cast("double"), F.lit(0.0))


def taxonomy_id(vocabulary: str, c: Column) -> Column:
    """A term's id in a vocabulary: letters and digits in lower case, everything else one underscore."""
    return F.concat(F.lit(f"{vocabulary}."), F.btrim(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}]+", "_"), F.lit("_")))


def size_label(chars: Column, blocks: Column) -> Column:
    return F.format_string("%d chars / %d blocks", F.coalesce(chars, F.lit(0)).cast("long"), F.coalesce(blocks, F.lit(0)).cast("long"))


def spaced_json(*columns: str) -> Column:
    """Sorted-key JSON with a space behind colons and commas, of plain text columns (the input of SHA-1 keys)."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(F.coalesce(F.col(c).cast("string"), F.lit("")))), r"^\[|\]$", "")
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{c}": '), quoted(c)) for c in sorted(columns)]), F.lit("}"))


def time_or_null(c: Column) -> Column:
    """The time text in one layout, null for empty."""
    return F.when(text(c) != "", time_text(c, F.lit("")))
