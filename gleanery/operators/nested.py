"""Flat tables from deeply nested JSON records, with Merkle identities of all subtrees.

Every object is canonicalised and hashed bottom-up, an inner object entering its parent only by its hash. Equal
objects, wherever they occur, therefore have one identity and are stored once (``objects``); every occurrence
stays as a row of the bridge (``occurrences``) with record, path, parent and ordinal.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from json.decoder import scanstring
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The four arrays and the names under which each is looked for, in order (fixed values of the data contract).
PLACES = {
    "posts": ("posts",),
    "media": ("media",),
    "web_documents": ("web_documents", "documents", "pages", "web_pages", "articles"),
    "search_results": ("search_results", "results"),
}

OCCURRENCES = (
    "event_id string, place string, parent_path string, child_path string, ordinal int, depth int, "
    "field string, object_id string, parent_object_id string, body string"
)
_COLUMNS = [x.split()[0] for x in OCCURRENCES.split(", ")]
_FLUSH = 20_000


def _refuse(constant: str) -> Any:
    raise ValueError(f"{constant} is no JSON")


_BLANK = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?", re.ASCII)


def parse_deep(text: str) -> Any:
    """A JSON text of any depth, parsed over an explicit stack; ValueError for what is no JSON."""
    at = _BLANK.match(text, 0).end()
    stack: list[tuple[Any, str | None]] = []  # open containers, each with the key that waits for its value
    node, key = None, None
    while True:
        c = text[at : at + 1]
        if c in ("{", "[") and c:
            made: Any = {} if c == "{" else []
            if node is not None:
                stack.append((node, key))
            node, key, at = made, None, _BLANK.match(text, at + 1).end()
            closed = text[at : at + 1] == ("}" if c == "{" else "]")
            value = made
        else:
            closed = False
            if c == '"':
                value, at = scanstring(text, at + 1, True)
            elif m := _ATOM.match(text, at):
                value, at = json.loads(m[0]), m.end()
            else:
                raise ValueError(f"no JSON at {at}")
            made = None
        while True:
            if made is not None and not closed:  # a container just begun: its first key or element follows
                break
            if made is not None:  # its closing bracket stands at `at`
                value, at, made = node, at + 1, None
                node, key = stack.pop() if stack else (None, None)
            if node is None:
                if _BLANK.match(text, at).end() != len(text):
                    raise ValueError("text behind the value")
                return value
            if isinstance(node, dict):
                node[key] = value
            else:
                node.append(value)
            at = _BLANK.match(text, at).end()
            sign = text[at : at + 1]
            if sign == ",":
                at = _BLANK.match(text, at + 1).end()
                break
            if sign != ("}" if isinstance(node, dict) else "]") or not sign:
                raise ValueError(f"no separator at {at}")
            made, closed = node, True
        if isinstance(node, dict):
            if text[at : at + 1] != '"':
                raise ValueError(f"no key at {at}")
            key, at = scanstring(text, at + 1, True)
            at = _BLANK.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at = _BLANK.match(text, at + 1).end()


def decode(text: Any) -> Any:
    """What a JSON text encodes, of any depth, JSON text inside a JSON string included; None where it encodes nothing."""
    value = text
    while isinstance(value, str):
        value = value.lstrip("\ufeff")
        try:
            value = json.loads(value, parse_constant=_refuse)
        except RecursionError:
            try:
                value = parse_deep(value)
            except ValueError:
                return None
        except ValueError:
            return None
    return value


def record_id(record: dict) -> str | None:
    """``collector_run_id:event_index``; None where either part lacks."""
    parts = []
    for key in ("collector_run_id", "event_index"):
        v = record.get(key)
        if isinstance(v, bool) or not isinstance(v, (str, int, float)):
            return None
        if isinstance(v, float) and v.is_integer():
            v = int(v)
        v = str(v).strip()
        if not v:
            return None
        parts.append(v)
    return ":".join(parts)


def _elements(value: Any) -> list | None:
    """The value of a place as an array, if it holds an object."""
    if isinstance(value, str):
        value = decode(value)
    if isinstance(value, dict):
        return [value]
    if isinstance(value, list) and any(isinstance(x, dict) for x in _leaves(value)):
        return value
    return None


def _leaves(items: list) -> Iterator[Any]:
    stack = list(items)
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack.extend(x)
        else:
            yield x


def find_place(record: dict, name: str) -> list | None:
    """The array of one place: in the record under each of its names, then in its context."""
    context = record.get("context")
    for root in (record, context if isinstance(context, dict) else {}):
        for alias in PLACES[name]:
            if alias in root and (found := _elements(root[alias])) is not None:
                return found
    return None


def _digest(*parts: str) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(p.encode("utf-8", "surrogatepass"))
        h.update(b"\0")
    return h.hexdigest()[:32]


def flatten_record(record: dict, bodies: bool = True) -> list[tuple]:
    """Bridge rows of one record, parents before their children; none without an event id.

    Post-order over an explicit stack (any depth): an object's identity is the hash of its sorted keys, scalars
    as compact JSON, inner array elements as ``{"$ref": identity}``. Arrays keep order, nulls their position.
    """
    event_id = record_id(record)
    if event_id is None:
        return []
    rows: list[list] = []
    for place in PLACES:
        array = find_place(record, place)
        if array is None:
            continue
        # frame: node, key within the parent node, path, nearest enclosing row, field, children, folded, own row
        stack: list[list] = [[array, None, place, None, place, iter(enumerate(array)), {}, None]]
        while stack:
            node, key, path, owner, field, children, folded, own = frame = stack[-1]
            listed = isinstance(node, list)
            for k, child in children:
                if not isinstance(child, (dict, list)):
                    folded[k] = json.dumps(child, ensure_ascii=False, separators=(",", ":"))
                    continue
                up = owner if own is None else own
                child_path, child_field, row = f"{path}/{k}", field if listed else k, None
                if listed and isinstance(child, dict):
                    row = len(rows)
                    above = rows[up] if up is not None else None
                    rows.append([event_id, place, above[3] if above else "", child_path, k, above[5] + 1 if above else 0, child_field, None, up, None])
                grand = iter(enumerate(child)) if isinstance(child, list) else iter(sorted(child.items()))
                stack.append([child, k, child_path, up, child_field, grand, {}, row])
                break
            else:
                stack.pop()
                if listed:
                    text = "[" + ",".join(folded[i] for i in range(len(node))) + "]"
                else:
                    text = "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{folded[k]}" for k in sorted(node)) + "}"
                    if own is not None:
                        identity = _digest("object", text)
                        rows[own][7] = identity
                        if bodies:
                            rows[own][9] = text
                        text = f'{{"$ref":"{identity}"}}'
                if stack:
                    stack[-1][6][key] = text
    return [(*r[:8], rows[r[8]][7] if r[8] is not None else None, r[9]) for r in rows]


def _flatten(bodies: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for pdf in batches:
            for raw in pdf.iloc[:, 0]:
                record = decode(raw)
                if isinstance(record, dict):
                    rows.extend(flatten_record(record, bodies))
                if len(rows) >= _FLUSH:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows = []
        yield pd.DataFrame(rows, columns=_COLUMNS)

    return run


_PLACED = ["event_id", "place", "parent_path", "child_path", "ordinal", "depth", "field"]


def places(records: DataFrame, raw: str = "raw_value", bodies: bool = False) -> DataFrame:
    """Every place where an object stands, with ``versions``: the identities found there over all deliveries."""
    rows = records.select(F.col(f"`{raw}`").alias("raw_value")).where(F.col("raw_value").isNotNull()).mapInPandas(_flatten(bodies), OCCURRENCES)
    return rows.groupBy(*_PLACED).agg(F.collect_set(F.struct("object_id", "parent_object_id", *(["body"] if bodies else []))).alias("versions"))


def occurrences(records: DataFrame, raw: str = "raw_value", bodies: bool = True) -> DataFrame:
    """The bridge: one row per occurrence of an array-element object, with its Merkle identity.

    Only the raw column is read. Null, damaged and non-object records and records without an event id give no
    rows; a record delivered again gives its rows once, a delivery with another content adds its own: one
    aggregation by place keeps the set of identities found there. ``bodies=False`` leaves the canonical bodies out.
    """
    out = places(records, raw, bodies).select(*_PLACED, F.inline("versions"))
    return out if bodies else out.withColumn("body", F.lit(None).cast("string"))


def objects(bridge: DataFrame) -> DataFrame:
    """Each distinct object once: identity and canonical body. A map-side first-value aggregation."""
    return bridge.groupBy("object_id").agg(F.min("body").alias("body"), F.count(F.lit(1)).alias("n_occurrences"))


#: Typed columns of the flat tables, by the field that holds the objects: column -> JSON paths tried in order.
_POST = {"post_id": ("$.post_id", "$.id"), "canonical_url": ("$.canonical_url", "$.url"), "author_handle": ("$.author_handle", "$.handle"), "author_name": ("$.author.name", "$.author_name"), "text": ("$.text", "$.full_text", "$.content", "$.body"), "posted_at": ("$.posted_at", "$.created_at"), "links": ("$.links",)}
_MEDIA = {"media_id": ("$.media_id", "$.id"), "media_kind": ("$.media_kind", "$.type", "$.kind"), "url": ("$.url", "$.src"), "ocr_text": ("$.ocr_text",), "caption": ("$.caption", "$.alt_text"), "width": ("$.size.width", "$.size.w", "$.width"), "height": ("$.size.height", "$.size.h", "$.height")}
FLAT_FIELDS = {
    "posts": _POST,
    "replies": _POST,
    "media": _MEDIA,
    "web_documents": {"document_id": ("$.document_id", "$.id"), "canonical_url": ("$.canonical_url", "$.url", "$.source_url", "$.page_url"), "title": ("$.title", "$.page_title", "$.headline"), "document_kind": ("$.document_kind", "$.kind"), "text": ("$.text", "$.content", "$.body"), "meta": ("$.meta",)},
    "search_results": {"rank": ("$.rank", "$.position"), "url": ("$.url", "$.href", "$.link"), "title": ("$.title",), "snippet": ("$.snippet", "$.description")},
    "badges": {"kind": ("$.kind",)},
    "entities": {"name": ("$.name",), "type": ("$.type",)},
    "blocks": {"bbox": ("$.bbox",)},
    "lines": {"conf": ("$.conf",), "text": ("$.text",)},
    "tables": {"table_id": ("$.table_id",), "caption": ("$.caption",)},
    "rows": {},
    "cells": {"v": ("$.v",)},
    "grid": {"c": ("$.c",)},
    "images": {"src": ("$.src",)},
    "sitelinks": {"title": ("$.title",), "url": ("$.url",)},
}


def flat_table(bridge: DataFrame, field: str, top_level: bool = False) -> DataFrame:
    """The related flat table of one field's objects: a row per occurrence with its keys, its parent's keys, typed columns.

    ``top_level`` takes the elements of the place of that name, else the objects that any enclosing object holds under
    the field, at whatever depth. ``rest`` is a JSON object of all fields that did not go whole into a column (null
    where there are none), inner objects as references to their identities: no field is lost. A field without typed
    columns has all its fields in ``rest``.
    """
    rows = bridge.where((F.col("field") == field) & ((F.col("depth") == 0) == F.lit(top_level)))
    columns = FLAT_FIELDS.get(field, {})
    # what a column took whole: the first path that holds something, if it is a field of the object itself
    taken = [F.coalesce(*[F.when(F.get_json_object("body", p).isNotNull(), F.lit(p[2:] if "." not in p[2:] else "")) for p in paths]) for paths in columns.values()]
    typed = [F.coalesce(*[F.get_json_object("body", p) for p in paths]).alias(c) for c, paths in columns.items()]
    own = F.from_json("body", "map<string,variant>")
    rest = F.map_filter(own, lambda k, v: ~F.array_contains(F.array_compact(F.array(*taken)), k)) if taken else own
    keys = ["event_id", "place", "child_path", "parent_path", "ordinal", "depth", "object_id", "parent_object_id"]
    return rows.select(*keys, *typed, F.when(F.cardinality(rest) > 0, F.to_json(rest)).alias("rest"))
