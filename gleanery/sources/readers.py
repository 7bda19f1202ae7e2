"""Readers beside the parquet tables: topics, files, JSON rows, metrics text, guarded SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "topic_name string, kafka_partition int, kafka_offset long, kafka_key string, received_at timestamp_ntz, raw_value string"


def topic_options(servers: str, topics: list[str], start: str = "earliest") -> dict[str, str]:
    """Options of a topic subscription: one topic or several, from the earliest or latest offsets."""
    return {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": start}


def read_topic(spark: SparkSession, options: dict[str, str], stream: bool = True) -> DataFrame:
    """Records of a log in the engine's shape; needs the Kafka package on the class path."""
    df = (spark.readStream if stream else spark.read).format("kafka").options(**options).load()
    return df.select(
        F.col("topic").alias("topic_name"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"),
        F.col("key").cast("string").alias("kafka_key"), F.col("timestamp").cast("timestamp_ntz").alias("received_at"), F.col("value").cast("string").alias("raw_value"),
    )


def stream_records(spark: SparkSession, folder: str, files_per_trigger: int = 64, archive: str | None = None) -> DataFrame:
    """The same records from a spool of parquet files; read files move to ``archive`` where one is given."""
    r = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger)
    if archive:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return r.parquet(folder)


def base64_records(df: DataFrame, value: str = "value") -> DataFrame:
    """Records of a REST log consumer: base64 text to JSON text."""
    return df.withColumn("raw_value", F.unbase64(value).cast("string"))


def text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``path, text`` of Markdown and text files below a folder, each once."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    df = df.where(F.lower("path").rlike(r"\.(md|markdown|txt)$"))
    return df.select("path", F.decode("content", "UTF-8").alias("text")).dropDuplicates(["path"])


def folder_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Files and bytes per kind of a folder tree, from metadata alone."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    kind = F.coalesce(F.nullif(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)), F.lit("")), F.lit("other"))
    return df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("last_modified"))


def metric_samples(lines: DataFrame, prefix: str = "", column: str = "value") -> DataFrame:
    """``name, labels map, sample`` of metrics text; comments and other prefixes are left out."""
    form = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)"
    c = F.col(column)
    name = F.regexp_extract(c, form, 1)
    pairs = F.regexp_extract_all(F.regexp_extract(c, form, 2), F.lit(r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_extract(p, r'="(.*)"$', 1).alias("v")))
    out = lines.where(~c.startswith("#") & (name != "") & name.startswith(prefix))
    return out.select(name.alias("name"), F.map_from_entries(entries).alias("labels"), F.expr(f"try_cast(regexp_extract({column}, '{form.replace(chr(92), chr(92) * 2)}', 3) AS double)").alias("sample"))


def sum_by_label(samples: DataFrame, name: str, label: str) -> DataFrame:
    return samples.where(F.col("name") == name).groupBy(F.col("labels")[label].alias(label)).agg(F.sum("sample").alias("total"))


#: First words that a guarded statement may have, and words it must not hold (fixed lists).
ALLOWED = ("select", "with", "show", "describe", "desc", "explain")
BLOCKED = ("insert", "update", "delete", "drop", "alter", "create", "truncate", "attach", "detach", "system", "grant", "revoke", "optimize", "rename", "set", "use", "cache", "refresh", "load")


def guarded_sql(spark: SparkSession, statement: str, limit: int = 200) -> DataFrame:
    """A read-only statement: single, of an allowed kind, without blocked words outside strings; at most ``limit`` rows
    unless it says its own limit. Anything else raises ValueError."""
    s = statement.strip().rstrip(";").strip()
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", s, flags=re.S)
    words = re.findall(r"[A-Za-z_]+", bare.lower())
    if not words or words[0] not in ALLOWED:
        raise ValueError("only reading statements are allowed")
    if ";" in bare:
        raise ValueError("only one statement is allowed")
    if blocked := sorted(set(words) & set(BLOCKED)):
        raise ValueError(f"blocked words: {', '.join(blocked)}")
    df = spark.sql(s)
    return df if words[0] not in ("select", "with") or re.search(r"\blimit\s+\d+\s*$", bare, re.I) else df.limit(limit)
