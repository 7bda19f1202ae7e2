"""Sinks: keyed and dynamic topics, compacted state, monthly tables, index and vector upserts, text metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.analytics import latest_by


def keyed(df: DataFrame, key: str, topic: str | None = None) -> DataFrame:
    """``key, value`` (and ``topic``) as a log takes them: the row as JSON under its key."""
    cols = [F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[c for c in df.columns if c != topic])).alias("value")]
    return df.select(*cols, *([F.col(topic).alias("topic")] if topic else []))


def write_topics(df: DataFrame, folder: str, key: str = "target_key", topic: str = "target_topic") -> None:
    """Messages to the topic that each names: one folder per topic."""
    keyed(df, key, topic).write.mode("append").partitionBy("topic").json(folder)


def append_monthly(df: DataFrame, folder: str, ts: str) -> None:
    """Append to a table partitioned by month."""
    df.withColumn("month", F.date_format(ts, "yyyyMM")).write.mode("append").partitionBy("month").parquet(folder)


def append_daily_json(df: DataFrame, folder: str, ts: str) -> None:
    df.withColumn("day", F.date_format(ts, "yyyyMMdd")).write.mode("append").partitionBy("day").json(folder)


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """State after an upsert: the last row per key of old and new together."""
    both = new if old is None else old.unionByName(new, allowMissingColumns=True)
    return latest_by(both, keys, order, new.columns)


class Snapshots:
    """State of a compacted topic as numbered snapshot folders; readers see the last complete one.

    A snapshot is written beside its predecessor and counts once its success marker is there, so a lost executor or
    a repeated batch leaves no half state. The rows are spread over ``buckets`` by their key and only buckets that a
    batch touches are written anew: a snapshot refers to the others where they lie. Snapshots before the last ``keep``
    are removed with the buckets that only they refer to.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32, keep: int = 2) -> None:
        self.spark, self.folder, self.buckets, self.keep = spark, folder.rstrip("/"), buckets, keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str, folder: str | None = None) -> bool:
        return self._fs.exists(self._path(f"{(folder or self.folder).rstrip('/')}/{name}"))

    def _names(self, sub: str = "") -> list[str]:
        root = self._path(self.folder + sub)
        return [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []

    def versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in self._names() if n.startswith("v=") and self.has(f"{n}/index/_SUCCESS"))

    def _index(self, version: int) -> dict[int, int]:
        """Bucket -> version that holds its rows."""
        rows = self.spark.read.schema("bucket int, held long").parquet(f"{self.folder}/v={version}/index").collect()
        return {r["bucket"]: r["held"] for r in rows}

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        v = self.versions()
        if not v:
            return None
        held = self._index(v[-1])
        paths = [f"{self.folder}/v={h}/rows/bucket={b}" for b, h in sorted(held.items()) if buckets is None or b in buckets]
        schema = self.spark.read.parquet(*[f"{self.folder}/v={h}/rows/bucket={b}" for b, h in list(held.items())[:1]]).schema if held else None
        if schema is None:
            return None
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def put(self, version: int, new: DataFrame, keys: list[str], order: list[str]) -> int:
        """Upserts ``new`` as the next snapshot; gives its number.

        A number that is there already is a repeated batch of the run that wrote it, whose rows are upserted again to no
        effect, or the batch of a run that counts anew, whose rows must not be lost: both become a snapshot behind
        the last one.
        """
        at = self.versions()
        number = version if not at or version > at[-1] else at[-1] + 1
        spread = new.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int"))
        touched = sorted(r["bucket"] for r in spread.select("bucket").distinct().collect())  # at most `buckets` numbers
        old = self.read(touched)
        state = upsert(old, new, keys, order)
        self._write(number, state, keys, touched, self._index(at[-1]) if at else {})
        return number

    def _write(self, number: int, rows: DataFrame, keys: list[str], touched: list[int], held: dict[int, int]) -> None:
        out = f"{self.folder}/v={number}"
        spread = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int"))
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/rows")
        written = {int(n[7:]) for n in self._names(f"/v={number}/rows") if n.startswith("bucket=")}
        index = {b: h for b, h in held.items() if b not in touched} | dict.fromkeys(written, number)
        self.spark.createDataFrame(sorted(index.items()), "bucket int, held long").coalesce(1).write.mode("overwrite").parquet(f"{out}/index")
        self._clean()

    def _clean(self) -> None:
        at = self.versions()
        kept = at[-self.keep :]
        used = {(b, h) for v in kept for b, h in self._index(v).items()}
        for v in at[: -self.keep]:
            if not any(h == v for _, h in used):
                self._fs.delete(self._path(f"{self.folder}/v={v}"), True)
            else:
                self._fs.delete(self._path(f"{self.folder}/v={v}/index"), True)
                for n in self._names(f"/v={v}/rows"):
                    if n.startswith("bucket=") and (int(n[7:]), v) not in used:
                        self._fs.delete(self._path(f"{self.folder}/v={v}/rows/{n}"), True)

    def delete(self, version: int, where: Column, keys: list[str]) -> int:
        """Deletes the rows that a condition holds for; gives their number."""
        old = self.read()
        if old is None:
            return 0
        gone = old.where(where).count()
        at = self.versions()
        number = max(version, at[-1] + 1)
        self._write(number, old.where(~F.coalesce(where, F.lit(False))), keys, list(range(self.buckets)), {})
        return gone


def get(state: DataFrame, key: str, column: str = "key") -> DataFrame:
    return state.where(F.col(column) == key)


def scan_prefix(state: DataFrame, prefix: str, column: str = "key") -> DataFrame:
    return state.where(F.col(column).startswith(prefix))


def vector_rows(points: DataFrame, ident: str, vectors: str = "vectors") -> DataFrame:
    """Named vectors in long form, so that an upsert of one name leaves the others."""
    return points.select(F.col(ident).alias("point_id"), F.explode(vectors).alias("vector_name", "vector")).where(F.size("vector") > 0)


def metric_lines(df: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """One line of metrics text per row."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in labels])
    return df.select(F.concat(F.lit(f"{name}{{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("value"))
