"""Views of the driver's tables as the engine's own: files, folders, usage, events, clipboard, rules, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.functions.paths import parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hours(n: Column) -> Column:
    return F.timestamp_seconds(F.lit(1_704_067_200) + n * 3600)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; 1704067200 is 2024-01-01 UTC."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in (".txt", ".md", ".pdf", ".log")]), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.concat(F.lit("doc-"), F.col("doc_id"), ext)
    return d.select(
        F.col("doc_id").alias("node_id"), F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("path"), name.alias("name"), F.lit(False).alias("is_dir"),
        F.col("n_chars").alias("size"), _hours(F.col("doc_id")).alias("modified"), _hours(F.col("doc_id") - 24).alias("created"), (F.col("doc_id") % 11 == 0).alias("hidden"),
        (F.col("doc_id") % 13 == 0).alias("in_package"), F.array(F.concat(F.lit("lang-"), "lang"), F.concat(F.lit("src"), (F.col("doc_id") % 3).cast("string"))).alias("tags"), "text",
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files (and some as folders), for searches by name."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("node_id"), F.concat(F.lit("/parts/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/"), "p_type", F.lit("/"), "p_name").alias("path"), F.col("p_name").alias("name"),
        (F.col("p_size") % 7 == 0).alias("is_dir"), (F.col("p_size") * 1024).cast("long").alias("size"), _hours(F.col("p_partkey")).alias("modified"), _hours(F.col("p_partkey")).alias("created"),
        (F.col("p_partkey") % 11 == 0).alias("hidden"), F.lit(False).alias("in_package"), F.array(F.col("p_type")).alias("tags"), F.lit(None).cast("string").alias("text"),
    )


def with_folders(rows: DataFrame) -> DataFrame:
    """Files and the folders right above them; folders have no size and negative ids by path."""
    up = rows.select(parent(F.col("path")).alias("path")).distinct()
    folder = up.select(
        (-F.crc32(F.col("path").cast("binary")) - 1).cast("long").alias("node_id"), "path", F.split_part("path", F.lit("/"), F.lit(-1)).alias("name"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"),
        F.lit(None).cast("timestamp").alias("modified"), F.lit(None).cast("timestamp").alias("created"), F.lit(False).alias("hidden"), F.lit(False).alias("in_package"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("text"),
    )
    return rows.unionByName(folder)


def opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, ts): an event is an opening of the file whose document id is the user's."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.join(files(spark, sf_dir).select("node_id", "path"), F.col("user_id") == F.col("node_id")).select("path", "ts")


def part_opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.join(parts(spark, sf_dir).select("node_id", "path"), F.col("user_id") == F.col("node_id")).select("path", "ts")


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, path, flags) from events: flags by type and id."""
    e = table(spark, sf_dir, "events")
    flag = F.when(F.col("event_type") == "view", 0x1000 | 0x10000).when(F.col("event_type") == "click", 0x800 | 0x10000).when(F.col("event_type") == "signup", 0x100 | 0x20000).when(F.col("event_type") == "purchase", 0x400 | 0x20000).otherwise(0x2 | 0x4)
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("/vol/u"), F.col("user_id") % 40, F.lit("/d"), F.col("user_id"), F.lit("/f"), F.col("event_id") % 97).alias("path"), flag.cast("int").alias("flags"))


def clipboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 600 + F.col("turn") * 7)
    n = F.col("conv_id") * 10 + F.col("turn")
    return c.select(
        F.concat("conv_id", F.lit("-"), "turn").alias("id"), at.alias("created_at"), at.alias("first_copied_at"), F.left("text", F.lit(4096)).alias("preview"),
        F.element_at(F.array(*[F.lit(k) for k in ("text", "url", "image", "richText", "file")]), (n % 5 + 1).cast("int")).alias("kind"), (n % 7 == 0).alias("pinned"),
        F.when(n % 6 == 0, F.concat(F.lit("Title "), "conv_id")).alias("title"), F.concat(F.lit("com.example."), "role").alias("bundle"), F.col("role").alias("app"), F.lit(None).cast("string").alias("ocr"),
        F.when(n % 5 == 0, F.lit("Work Replies")).alias("collection"), F.when(n % 4 == 0, F.concat(F.lit(";k"), "conv_id")).alias("keyword"), F.lit(None).cast("boolean").alias("expand"), F.lit(1).cast("int").alias("copies"),
    )
