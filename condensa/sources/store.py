"""The append store of reductions as a Parquet table, and reads of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from condensa.functions.text import content_hash, estimated_tokens, saved_ratio
from condensa.operators.classify import content_type
from condensa.operators.reducers import reduced

EVENT = "tool_name string, tool_input string, tool_output string"


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each text file: path, content."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def parse_events(lines: DataFrame) -> DataFrame:
    """Tool events from JSON lines (value); event is null where a line is no event, which then passes through."""
    event = F.from_json("value", EVENT)
    return lines.where(F.length(F.trim("value")) > 0).withColumn("event", F.when(event["tool_name"].isNotNull(), event))


def measure(rows: DataFrame, level: str = "medium", maybe_json: bool = True) -> DataFrame:
    """Classify where type_hint is null, reduce, and measure: the reduction pipeline in one narrow stage."""
    hint = F.col("type_hint") if "type_hint" in rows.columns else F.lit(None).cast("string")
    grade = F.col("level") if "level" in rows.columns else F.lit(level)
    rows = rows.withColumn("content_type", F.coalesce(hint, content_type(F.col("content"), maybe_json))).withColumn("level", grade)
    rows = rows.withColumn("compressed", reduced(F.col("content"), F.col("content_type"), F.col("level")))
    rows = rows.withColumns({"original_hash": content_hash(F.col("content")), "original_tokens": estimated_tokens(F.col("content")), "compressed_tokens": estimated_tokens(F.col("compressed"))})
    return rows.withColumn("ratio", saved_ratio(F.col("original_tokens"), F.col("compressed_tokens")))


def append(measured: DataFrame, path: str) -> None:
    """Append events; one row each, partitioned by session."""
    cols = ["id", "session_id", "content_type", "original_hash", F.col("content").alias("original"), "compressed", "original_tokens", "compressed_tokens", "ratio", "level", F.current_timestamp().alias("created_at")]
    measured.select(*cols).write.mode("append").option("compression", "zstd").partitionBy("session_id").parquet(path)


def latest_by_hash(store: DataFrame, *columns: str) -> DataFrame:
    """original_hash and the columns (original and compressed if none are named) of each hash's newest event."""
    wide = F.struct(*(columns or ("original", "compressed")))
    return store.groupBy("original_hash").agg(F.max_by(wide, "id").alias("x")).select("original_hash", "x.*")


def expand(store: DataFrame, hashes: DataFrame) -> DataFrame:
    """Originals of the given original_hash rows; null where unknown."""
    return hashes.join(latest_by_hash(store).drop("compressed"), "original_hash", "left")


def recent_items(store: DataFrame, n: int = 20) -> DataFrame:
    """The last n events of each session, newest first."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("id")))
    return store.withColumn("rank", rank).where(F.col("rank") <= n)


def count_accesses(accesses: DataFrame) -> DataFrame:
    return accesses.groupBy("project", "file").agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"))


def count_tool_usage(usage: DataFrame) -> DataFrame:
    return usage.groupBy("session_id", "tool_name").agg(F.count("*").alias("call_count"), F.max("ts").alias("last_used_at"))


def top_files(accesses: DataFrame, n: int = 20) -> DataFrame:
    """Each project's most accessed files, ties by name."""
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("access_count"), "file"))
    return count_accesses(accesses).withColumn("rank", rank).where(F.col("rank") <= n)


def log_files(log: DataFrame) -> DataFrame:
    """project, file: the distinct file names of change logs (project, value), one name a line, blank lines between commits."""
    names = log.select("project", F.regexp_replace("value", r"\r\z", "").alias("file"))
    return names.where(F.length(F.trim("file")) > 0).distinct()


def project_profile(log: DataFrame, accesses: DataFrame, n: int = 20) -> DataFrame:
    """Per project: files of its log, files tracked, and the n most accessed, when each of the log's files counts as one more access.

    accesses has project, file, ts.
    """
    changed = log_files(log)
    more = changed.withColumn("ts", F.lit(None).cast(accesses.schema["ts"].dataType))
    top = top_files(accesses.select("project", "file", "ts").unionByName(more), n)
    per_project = top.groupBy("project").agg(F.count("*").alias("tracked_files"), F.array_sort(F.collect_list(F.struct("rank", F.col("file").alias("path"), "access_count"))).alias("x"))
    listed = F.transform("x", lambda f: F.struct(f["path"].alias("path"), f["access_count"].alias("access_count")))
    recent = changed.groupBy("project").agg(F.count("*").alias("recent_files"))
    return per_project.join(recent, "project", "left").select("project", F.coalesce("recent_files", F.lit(0)).alias("recent_files"), "tracked_files", listed.alias("top_files"))

