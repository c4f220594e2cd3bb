"""Session statistics, quality, patterns and recommendations over reduction events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.functions.text import saved_ratio


def type_stats(events: DataFrame) -> DataFrame:
    """Per session and type: tokens before and after, count, ratio."""
    out = events.groupBy("session_id", "content_type").agg(F.sum("original_tokens").cast("bigint").alias("original_tokens"), F.sum("compressed_tokens").cast("bigint").alias("compressed_tokens"), F.count("*").alias("n"))
    return out.withColumn("ratio", saved_ratio(F.col("original_tokens"), F.col("compressed_tokens")))


def session_totals(events: DataFrame) -> DataFrame:
    stats = type_stats(events)
    out = stats.groupBy("session_id").agg(F.sum("original_tokens").cast("bigint").alias("original_tokens"), F.sum("compressed_tokens").cast("bigint").alias("compressed_tokens"), F.sum("n").cast("bigint").alias("n"), F.sort_array(F.collect_list(F.struct((-F.col("original_tokens")).alias("order"), "content_type", "original_tokens", "compressed_tokens", "ratio", "n"))).alias("by_type"))
    out = out.withColumn("tokens_saved", F.greatest(F.col("original_tokens") - F.col("compressed_tokens"), F.lit(0)))
    return out.withColumn("ratio", saved_ratio(F.col("original_tokens"), F.col("compressed_tokens")))


def quality(events: DataFrame) -> DataFrame:
    r = F.col("ratio")
    step = F.when(r > 0.9, -10.0).when(r > 0.7, -3.0).when(r >= 0.3, 2.0).otherwise(0.0)
    out = type_stats(events).groupBy("session_id").agg(F.sum("n").cast("bigint").alias("n"), F.sum(step).alias("steps"))
    out = out.withColumn("score", F.when(F.col("n") < 3, 50.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(80.0) + F.col("steps")))))
    s = F.col("score")
    band = F.when(s >= 90, "excellent").when(s >= 70, "good").when(s >= 50, "moderate").otherwise("poor")
    advice = F.when(s < 70, "Use level light or medium for better quality.")
    return out.select("session_id", "n", "score", band.alias("assessment"), advice.alias("recommendation"))


def session_class(events: DataFrame) -> DataFrame:
    tokens, kind = F.col("original_tokens"), F.col("content_type")
    sums = type_stats(events).groupBy("session_id").agg(F.sum(tokens).cast("bigint").alias("total"), F.sum(F.when(kind.startswith("code"), tokens).otherwise(0)).cast("bigint").alias("code"), F.sum(F.when(kind == "command_output", tokens).otherwise(0)).cast("bigint").alias("output"))
    part = lambda c: F.col(c) / F.greatest(F.col("total"), F.lit(1)) > 0.5
    label = F.when(F.col("total") == 0, "empty").when(part("output"), "debugging").when(part("code"), "code_review").otherwise("feature_build")
    return sums.select("session_id", "total", label.alias("session_class"))


def top_consumers(events: DataFrame, n: int | None = None) -> DataFrame:
    """Each session's types by falling tokens, ties by name; the first n if given."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("original_tokens"), "content_type"))
    out = type_stats(events).withColumn("rank", rank)
    return out.where(F.col("rank") <= n) if n else out


def percent_text(ratio: Column) -> Column:
    """A ratio as whole percent, ties to even."""
    return F.bround(ratio * 100, 0).cast("bigint").cast("string")


def recommendations(events: DataFrame) -> DataFrame:
    """One row for each advice, types by falling tokens first, then the session's class."""
    stats = type_stats(events).where((F.col("ratio") < 0.3) & (F.col("original_tokens") > 1000))
    text = F.concat(F.lit("Raise the level for '"), "content_type", F.lit("': only "), percent_text(F.col("ratio")), F.lit("% saved on "), F.col("original_tokens").cast("string"), F.lit(" tokens"))
    by_type = stats.select("session_id", (-F.col("original_tokens")).alias("place"), text.alias("advice"))
    c = F.col("session_class")
    advice = F.when(c == "debugging", "Debugging session: reduce command output at level aggressive.").when(c == "code_review", "Code review session: fold reviewed files at level aggressive.")
    by_class = session_class(events).select("session_id", F.lit(1).cast("bigint").alias("place"), advice.alias("advice")).where("advice is not null")
    return by_type.unionByName(by_class)


def bench_quality(saved: Column) -> Column:
    return F.when(saved < 0.05, 70.0).when(saved > 0.95, 75.0).when((saved >= 0.3) & (saved <= 0.8), 95.0).otherwise(88.0)


def bench_rows(measured: DataFrame) -> DataFrame:
    """engine, content_type, tokens before and after, saved, savings in percent and quality of measured samples (name, content_type, ...)."""
    saved = F.greatest(F.col("original_tokens") - F.col("compressed_tokens"), F.lit(0)).cast("bigint")
    tokens = F.greatest("original_tokens", F.lit(1)).cast("bigint")
    return measured.select(F.col("name").alias("engine"), "content_type", tokens.alias("original_tokens"), "compressed_tokens", saved.alias("tokens_saved"), (F.col("ratio") * 100).alias("savings_pct"), bench_quality(F.col("ratio")).alias("quality_score"))


def bench_footer(rows: DataFrame) -> DataFrame:
    """Total tokens saved and the mean savings."""
    return rows.agg(F.coalesce(F.sum("tokens_saved"), F.lit(0)).cast("bigint").alias("total_saved"), F.coalesce(F.avg("savings_pct"), F.lit(0.0)).alias("avg_savings"))


def bench_table(rows: DataFrame) -> DataFrame:
    """The bench rows as lines of aligned text."""
    line = F.format_string("%-28s %-14s %7d  %7d  %6.1f%%  %7.1f", "engine", "content_type", "original_tokens", "compressed_tokens", "savings_pct", "quality_score")
    return rows.select("engine", line.alias("line"))
