"""The best representative of each group of duplicate records, built from consistent bundles of fields.

Fields that depend on each other form bundles and are taken from one record as a whole: ``body`` (text_best),
``address`` (canonical_url, domain), ``label`` (title), ``times`` (first_seen_at, last_seen_at). Each record's bundles
get a trust and a signature from a look at the record alone: what is wrong with a body and its site, an address's site,
the site that a title names, whether times are in order. Within a group only the first bundle of each signature
can be part of a best choice, so a map-side aggregation leaves as many candidates as there are signatures. A
branch-and-bound search then picks the combination of greatest trust under the functional dependencies
canonical_url -> domain, text_best -> domain, title -> site -> domain, and first_seen_at <= last_seen_at.

Groups of any size and skew: no record list is ever collected, only those reduced candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import boilerplate as rules

#: UTF-8 read as a single-byte code page, and characters replaced by ?, _ or U+FFFD.
_MISREAD = re.compile(r"Ã[\x80-\xbf¡-¿ƒ‚„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ\xa0­ ]|â[€„†‚ˆ‡˜šœžŒ]|ðŸ|Â[\xa0-¿]|�")
_REPLACED = re.compile(r"\?\w|[,;:]\?|\w\? [a-zà-ÿ]|[.!?%] \?+$|[^\W\d]_|_[^\W\d]|(?:^|\s)_|_(?:\s|$)", re.M)
_CODE = re.compile(r"`[^`\n]*`")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|&(?:[a-zA-Z]{2,8}|#\d+|#x[0-9a-fA-F]+);")
_CUT = re.compile(r"(?:\b(?:read more|weiterlesen|leer más|lire la suite)|\((?:cont\.|continued|forts\.|sigue|suite)\)|…|\.\.\.|\[(?:\.\.\.|…)\])\s*$", re.I)
_AFTER_SENTENCE = re.compile(r"[.!?][\"'”»)]*(?: \S+){1,3}$")
_JUNK = re.compile(r"(?:[45]\d\d)\b.{0,60}|\[no text\]|n/a|null|none|undefined|\W*", re.I)
_ENDED = re.compile(r"[.!?…:][\"'”»)\]]*(?:\W*|\W+\w{1,3}\W+|(?: \S+){1,3}[….]?)$")

_EPOCH = datetime(1970, 1, 1)

PENALTY = {"junk": 90, "foreign": 40, "misread": 40, "replaced": 40, "markup": 40, "repeated": 40, "cut": 40, "open end": 10}


def body_lines(text: str) -> list[str]:
    return [x for x in (" ".join(line.split()) for line in text.split("\n")) if x]


def body_faults(text: str | None, brand: str = "") -> set[str]:
    """What speaks against a text as the whole undamaged body of a page; ``empty`` for null and blank ones."""
    lines = body_lines(text or "")
    if not lines:
        return {"empty"}
    faults = set()
    plain = "\n".join(lines)
    if all(_JUNK.fullmatch(x) for x in lines):
        faults.add("junk")
    if _MISREAD.search(plain):
        faults.add("misread")
    if _REPLACED.search(_CODE.sub("", plain)):
        faults.add("replaced")
    if _MARKUP.search(plain):
        faults.add("markup")
    long = [x for x in lines if len(x) >= 60]
    if len(set(long)) < len(long):
        faults.add("repeated")
    labels = [rules.first_pass(x, brand) for x in lines]
    if any(k in (rules.BAD, rules.HEAD) or _JUNK.fullmatch(x) for k, x in zip(labels, lines, strict=True)):
        faults.add("foreign")
    last = lines[-1]
    row = bool(rules._LISTED.match(last)) or last.count(" | ") >= 2
    if (m := _CUT.search(last)) and not (m[0].strip() == "…" and (_AFTER_SENTENCE.search(last[: m.start()]) or (row and re.search(r"[\d%](?: \S+){1,3}$", last[: m.start()])))):
        faults.add("cut")
    elif not row and not _ENDED.search(last):
        faults.add("open end")
    return faults


def trust_of(faults: set[str]) -> int:
    """0 to 100; only faultless texts have 100, empty ones 0."""
    return 0 if "empty" in faults else max(1, 100 - sum(PENALTY[x] for x in faults))


def body_trust(text: str | None, brand: str = "") -> int:
    return trust_of(body_faults(text, brand))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def address_trust(url: str | None, domain: str | None) -> int:
    """Of an address as a whole: a plain absolute URL whose host is the domain is best."""
    host = host_of(url)
    if not host:
        return 20 if domain else 0
    trust = 60 + 20 * bool(domain and domain.removeprefix("www.") == host)
    trust += 10 * ("?" not in url and "#" not in url) + 10 * (not url.endswith("/") or url.count("/") == 3)
    return trust


def label_trust(title: str | None, brand: str) -> tuple[int, str]:
    """Trust of a title and the site that it names, if any (its signature)."""
    t = " ".join((title or "").split())
    if not t or t.casefold() in ("untitled", "null", "n/a", "none", "no title", "ohne titel", "sin título", "sans titre"):
        return 0, ""
    trust = 100 - 40 * bool(_MISREAD.search(t) or _REPLACED.search(_CODE.sub("", t))) - 40 * bool(_MARKUP.search(t)) - 30 * bool(_CUT.search(t))
    m = re.match(r".{4,} (?:[–\-|—·]|::?) ([^–|—]{1,40})$", t)
    site = m[1].casefold().replace(" ", "") if m else ""
    if site and brand and site.startswith(brand):
        return max(1, trust - 10), brand
    return max(1, trust), ""


_FEATURES = "record_id long, evidence_id string, body_trust int, faults string, body_size int, address_trust int, site string, broken boolean, label_trust int, label_site string, times_trust int, seen long, first long"
_KINDS = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        out: list[list] = [[] for _ in _KINDS]
        for url, domain, title, text, first, last in zip(c["canonical_url"], c["domain"], c["title"], c["text_best"], c["first_seen_at"], c["last_seen_at"], strict=True):
            host = host_of(url)
            brand = rules.brand_of(domain or host)
            trust, named = label_trust(title, brand)
            times = 0 if first is None and last is None else 50 if first is None or last is None else 100 if first <= last else -1
            faults = body_faults(text, brand)
            broken = bool(host and domain and domain.removeprefix("www.").lower() != host)
            row = (trust_of(faults), ",".join(sorted(faults)), sum(map(len, body_lines(text or ""))), address_trust(url, domain), brand, broken, trust, named, times, _micros(last), _micros(first))
            for k, v in enumerate(row):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [b.column(b.schema.get_field_index("record_id")), b.column(b.schema.get_field_index("evidence_id")), *(pa.array(v, k) for v, k in zip(out, _KINDS, strict=True))],
            names=[x.split()[0] for x in _FEATURES.split(", ")],
        )


def _micros(t) -> int | None:
    return None if t is None else round((t.replace(tzinfo=None) - _EPOCH).total_seconds() * 1e6)


def record_features(records: DataFrame) -> DataFrame:
    """Trusts and signatures of every record's bundles: a map, without the texts."""
    return records.select("record_id", "evidence_id", "canonical_url", "domain", "title", "text_best", "first_seen_at", "last_seen_at").mapInArrow(_features, _FEATURES)


#: A better body outweighs all other bundles together (their trusts are up to 100 each).
BODY_WEIGHT = 1e9
#: Signature of a bundle that breaks a dependency within itself: a host that is not the domain, times out of order.
BROKEN = "!"


def consistent(name: str, signature: str, chosen: dict[str, tuple]) -> bool:
    """Whether a bundle of this signature goes with those chosen: of bundles that name a site all name the same."""
    if signature.startswith(BROKEN):
        return False
    if name == "times":
        return True
    site = signature.rpartition("|")[2]
    return not site or all(not other or other == site for k, x in chosen.items() if k != "times" for other in (x[1].rpartition("|")[2],))


def choose_bundles(candidates: dict[str, list[tuple]]) -> dict[str, int]:
    """Branch and bound: one ``(trust, signature, record[, seen])`` of each bundle, of greatest total trust.

    Signatures are ``site`` or ``what|site``; see ``consistent``. Bundles are decided body first, then by their
    greatest trust, candidates by trust; a branch ends where its trust plus the greatest trusts still to come does not
    exceed the best found. Ties go to the later seen, then the higher record. A bundle of which no candidate is
    consistent with the rest comes from its most trusted record.
    """
    names = sorted((k for k in candidates if candidates[k]), key=lambda k: (k != "body", -max(x[0] for x in candidates[k])))
    ranked = {k: sorted(candidates[k], key=lambda x: (-x[0], -(x[3] if len(x) > 3 else 0), -x[2])) for k in names}
    room = [0.0] * (len(names) + 1)
    for i in range(len(names) - 1, -1, -1):
        room[i] = room[i + 1] + ranked[names[i]][0][0]
    best: tuple[float, dict[str, int]] = (-1.0, {})

    def search(i: int, trust: float, chosen: dict[str, tuple]) -> None:
        nonlocal best
        if trust + room[i] <= best[0]:
            return
        if i == len(names):
            best = (trust, {k: v[2] for k, v in chosen.items()})
            return
        for item in ranked[names[i]]:
            if trust + item[0] + room[i + 1] <= best[0]:
                break
            if consistent(names[i], item[1], chosen):
                search(i + 1, trust + item[0], {**chosen, names[i]: item})
        search(i + 1, trust, chosen)  # the bundle left open, should nothing be consistent

    search(0, 0.0, {})
    return {k: best[1].get(k, ranked[k][0][2]) for k in names}


_CHOSEN = "evidence_id string, records long, body_record long, address_record long, label_record long, times_record long"


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for evidence_id, records, found in zip(pdf["evidence_id"], pdf["records"], pdf["found"], strict=True):
            by: dict[str, list[tuple[float, str, int]]] = {}
            for x in found:
                by.setdefault(x["bundle"], []).append((float(x["trust"]), x["signature"], int(x["record_id"]), int(x["seen"])))
            got = choose_bundles(by)
            rows.append((evidence_id, records, *(got.get(k) for k in ("body", "address", "label", "times"))))
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in _CHOSEN.split(", ")])
        for k in ("records", "body_record", "address_record", "label_record", "times_record"):
            out[k] = out[k].astype("Int64")
        yield out


def choose_survivors(records: DataFrame, least: int = 1) -> DataFrame:
    """evidence_id, records and the record that supplies each bundle, for groups of at least ``least`` records.

    Among bodies of equal faults the longer is the more complete, then the latest last_seen_at, then the higher
    record_id. Of times in order the latest last_seen_at is best, then the earliest first_seen_at. Records without an
    evidence_id form one group under null. A group without any usable text still gets a body record (trust 0). Every
    row counts as a record. Empty table: no rows.
    """
    feats = record_features(records)
    size = F.col("body_size") / (F.col("body_size") + 10_000.0)
    seen, none = F.coalesce("seen", F.lit(-1).cast("long")), F.lit(0).cast("long")

    def bundle(name: str, signature, trust, first, second):
        rank = F.struct(first.cast("long").alias("a"), seen.alias("seen"), second.cast("long").alias("b"), F.col("record_id").alias("record_id"))
        return F.struct(F.lit(name).alias("bundle"), F.coalesce(signature, F.lit("")).alias("signature"), trust.cast("double").alias("trust"), rank.alias("rank"))

    bundles = F.array(
        bundle("body", F.concat_ws("|", "faults", "site"), (F.col("body_trust") + size) * BODY_WEIGHT, F.col("body_size"), none),
        bundle("address", F.when(F.col("broken"), F.lit(BROKEN)).otherwise(F.col("site")), F.col("address_trust"), F.col("address_trust"), none),
        bundle("label", F.col("label_site"), F.col("label_trust"), F.col("label_trust"), none),
        bundle("times", F.when(F.col("times_trust") < 0, F.lit(BROKEN)).otherwise(F.lit("")), F.greatest("times_trust", none), F.col("times_trust"), -F.coalesce("first", none)),
    )
    reduced = feats.select("evidence_id", "record_id", F.inline(bundles)).groupBy("evidence_id", "bundle", "signature")
    reduced = reduced.agg(F.max(F.struct("rank", "trust")).alias("top"), F.count(F.lit(1)).alias("n"))
    groups = reduced.groupBy("evidence_id").agg(
        F.sum(F.when(F.col("bundle") == "body", F.col("n"))).alias("records"),
        F.collect_list(F.struct("bundle", "signature", F.col("top.trust").alias("trust"), F.col("top.rank.record_id").alias("record_id"), F.col("top.rank.seen").alias("seen"))).alias("found"),
    )
    return groups.where(F.col("records") >= least).mapInPandas(_choose, _CHOSEN)


def build_survivors(records: DataFrame) -> DataFrame:
    """One surviving record per evidence_id, each bundle whole from the record that ``sources`` names for it.

    Text, address, title and both times come from the chosen records. They are read again by one equi-join on
    record_id and folded by group.
    """
    chosen = choose_survivors(records)
    sources = F.struct("body_record", "address_record", "label_record", "times_record")
    roles = F.array(*[F.struct(F.lit(k).alias("role"), F.col(f"{k}_record").alias("record_id")) for k in ("body", "address", "label", "times")])
    picks = chosen.select("evidence_id", "records", sources.alias("sources"), F.inline(roles)).where(F.col("record_id").isNotNull())
    fields = {"body": ("source_kind", "text_best"), "address": ("canonical_url", "domain"), "label": ("title",), "times": ("first_seen_at", "last_seen_at")}
    read = records.select("record_id", *[c for columns in fields.values() for c in columns])
    parts = [F.max(F.when(F.col("role") == k, F.struct(*columns))).alias(k) for k, columns in fields.items()]
    out = picks.join(read, "record_id", "left").groupBy("evidence_id", "records", "sources").agg(*parts)
    return out.select("evidence_id", "body.source_kind", "address.canonical_url", "address.domain", "label.title", "body.text_best", "times.first_seen_at", "times.last_seen_at", "records", "sources")
