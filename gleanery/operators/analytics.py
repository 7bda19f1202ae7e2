"""Read-model building blocks: latest state, facets, histograms, conditional counts, hydration, paging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import scalars as S
from gleanery.session import cut


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the greatest by ``order`` (whose last column should be unique): one map-side aggregation."""
    rest = [c for c in (columns or df.columns) if c not in keys]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return got.select(*keys, *[F.col(f"__r.`{c}`").alias(c) for c in rest])


def final_view(df: DataFrame, keys: Sequence[str], version: str, tie: str) -> DataFrame:
    """The rows that a table of versions shows once merged: the last version of every key."""
    return latest_by(df, keys, [version, tie])


def summing_view(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Numerics summed per key, as a summing table merges them."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def facets(df: DataFrame, columns: Sequence[str], top: int = 200) -> DataFrame:
    """``facet, value, n`` of several columns in one pass, the greatest ``top`` values of each; empties do not count."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    counted = df.select(F.inline(pairs)).where(F.coalesce(F.col("value"), F.lit("")) != "").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("facet").orderBy(F.desc("n"), F.asc("value"))
    return counted.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).drop("rn")


def histogram(df: DataFrame, ts: str, minutes: int, by: Sequence[str] = (), distinct: str | None = None) -> DataFrame:
    """Counts per epoch-aligned bucket, and exact distinct values of a column."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.countDistinct(distinct).alias("n_distinct")] if distinct else [])
    return df.where(F.col(ts).isNotNull()).groupBy(S.bucket(F.col(ts), minutes).alias("bucket"), *by).agg(*aggs)


def activity(df: DataFrame, ts: str, frame: str, as_of: Column, by: Sequence[str] = (), distinct: str | None = None) -> DataFrame:
    """The histogram of a named frame that ends at ``as_of``."""
    window, minutes = S.FRAMES.get(frame, S.FRAMES["24h"])
    return histogram(df.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {window} MINUTE")), ts, minutes, by, distinct)


def queue_counts(df: DataFrame, queues: dict[str, Column]) -> DataFrame:
    """``queue, n`` of overlapping predicates in a single pass."""
    one = df.agg(*[F.count_if(p).alias(q) for q, p in queues.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(q).alias("queue"), F.col(q).alias("n")) for q in queues])))


def left_counts(base: DataFrame, key: str, others: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Base rows with the number of rows that other tables have for their key; each side is aggregated first."""
    out = base
    for name, (df, other_key) in others.items():
        n = df.groupBy(F.col(other_key).alias("__k")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, F.col(key) == F.col("__k"), "left").drop("__k").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return out


def merge_first(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of row sets in which the earlier set wins per key, the first by ``order`` within a set."""
    tagged = [p.withColumn("__prio", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in both.columns if c not in (*keys, "__prio")]
    got = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("__prio", *order)).alias("__r"))
    return got.select(*keys, *[F.col(f"__r.`{c}`").alias(c) for c in rest])


def page(df: DataFrame, sort: Sequence[Column], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """A page in a given order; the limit is the feature here, clamped to what a page may hold."""
    return df.orderBy(*sort).offset(max(0, min(offset, 1_000_000))).limit(S.clamp(limit, 50, most))


def after_key(df: DataFrame, columns: Sequence[str], last: Sequence, limit: int) -> DataFrame:
    """Keyset paging: rows after the last key in descending order, one more than asked to tell whether more follow."""
    cond = F.struct(*columns) < F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(c) for c, v in zip(columns, last, strict=True)])
    return df.where(cond).orderBy(*[F.desc(c) for c in columns]).limit(limit + 1)


def parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, state`` of a full comparison of two row sets by a hash of their canonical rows: only differences."""
    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).alias(f"__{name}"), F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias(f"__h_{name}"))

    a, b = hashed(left, "l"), hashed(right, "r")
    both = a.join(b, F.col("__l") == F.col("__r"), "full_outer")
    state = F.when(F.col("__r").isNull(), "missing").when(F.col("__l").isNull(), "extra").when(F.col("__h_l") != F.col("__h_r"), "differs")
    return both.select(F.coalesce("__l", "__r").alias(key), state.alias("state")).where(F.col("state").isNotNull())


def first_ranks(evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_id, best_rank``: the first rank of a run's ids among all evidence ids by count, then id; null without hit.

    Ids are spread by range and materialised; a rank is the place within its range after the sizes of those before.
    """
    counts = evidence.where(F.col("evidence_id").isNotNull()).groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n"))
    spread = cut(counts.select((-F.col("n")).alias("m"), "evidence_id").repartitionByRange("m", "evidence_id").withColumn("part", F.spark_partition_id()))
    sizes = spread.groupBy("part").agg(F.count(F.lit(1)).alias("ids"))
    before = sizes.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    placed = spread.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("m", "evidence_id")))
    ranks = placed.join(F.broadcast(before), "part").select("evidence_id", (F.col("before") + F.col("place")).alias("rank"))
    ids = runs.select("run_id", F.explode("evidence_ids").alias("evidence_id"))
    best = ids.join(ranks, "evidence_id").groupBy("run_id").agg(F.min("rank").alias("best_rank"))
    return runs.select("run_id").distinct().join(best, "run_id", "left")
