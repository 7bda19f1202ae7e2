"""Exactly one copy of each message that was delivered at least once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIVERIES = "__deliveries"


def _hashed(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """The columns beside the keys that can be hashed."""
    return [f.name for f in df.schema.fields if f.name not in keys and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]


def _hash(columns: Sequence[Column]) -> Column:
    return F.xxhash64(*columns) if columns else F.lit(0).cast("long")


def _folded(df: DataFrame, keys: Sequence[str], delivered_at: str) -> DataFrame:
    """keys, ``__kept`` (the row), ``__order`` (its time and tie-break) and the number of deliveries of each message.

    The tie-break is a hash over every column that can be hashed: two rows that tie on it are equal rows in effect.
    """
    at = F.col(f"`{delivered_at}`")
    order = F.struct(at.isNull().alias("late"), at.alias("at"), _hash([F.col(f"`{c}`") for c in _hashed(df, keys)]).alias("tie"))
    aggs = [F.min(order).alias("__order"), F.count(F.lit(1)).alias(DELIVERIES)]
    if rest := [c for c in df.columns if c not in keys]:
        aggs.insert(0, F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("__kept"))
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*aggs)


def keep_one_delivery(
    df: DataFrame,
    keys: Sequence[str] = ("event_id", "evidence_id"),
    delivered_at: str = "ingested_at",
    deliveries: str | None = None,
) -> DataFrame:
    """One row per message, the earliest delivery; equal times are decided by a hash of the row.

    One aggregation by the identifier with ``min_by`` over a struct: repeats of a key within a map task are
    folded before the shuffle, so a key that holds a third of all rows reaches its reducer once per map task.
    Null identifiers are values like any other (all rows with the same null parts are one message); a null
    delivery time counts as latest. Columns and their order stay; ``deliveries`` names an extra column with
    the number of rows folded. An empty table gives an empty table.
    """
    out = _folded(df, list(keys), delivered_at)
    cols = [F.col(f"`{c}`") if c in keys else F.col("__kept").getField(c).alias(c) for c in df.columns]
    if deliveries:
        cols.append(F.col(DELIVERIES).alias(deliveries))
    return out.select(*cols)


def repeated_messages(df: DataFrame, keys: Sequence[str] = ("event_id", "evidence_id"), delivered_at: str = "ingested_at") -> DataFrame:
    """The identifiers of the messages of which deliveries were left out, told from the rows that were kept.

    The same aggregation over whole rows as ``keep_one_delivery``, and an exact check of it: the kept row must be
    the one whose hash is the tie-break of the earliest delivery. Keys, nulls and empty tables as there.
    """
    keys = list(keys)
    kept = [F.col("__kept").getField(c) for c in _hashed(df, keys)]
    whole = (_hash(kept) == F.col("__order.tie")) if kept else F.lit(True)
    return _folded(df, keys, delivered_at).where((F.col(DELIVERIES) > 1) & whole).select(*[F.col(f"`{k}`") for k in keys])
