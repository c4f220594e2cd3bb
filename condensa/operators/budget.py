"""Token budgets: limits, levels by pressure, and the feedback of reduced sizes on levels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.functions.levels import BUDGET_SHARES, BUDGET_TOTAL, LEVELS


def limit_for(category: Column, total: int = BUDGET_TOTAL, shares: dict = BUDGET_SHARES) -> Column:
    """total times the category's single-precision share, cut to an integer; others have a tenth."""
    share = F.lit(0.1)
    for name, x in shares.items():
        share = F.when(category == name, F.lit(x)).otherwise(share)
    return (F.lit(float(total)) * share.cast("float").cast("double")).cast("bigint")


def level_for(used: Column, limit: Column) -> Column:
    p = F.try_divide(used.cast("double"), limit)
    return F.when(limit == 0, "aggressive").when(p < 0.5, "light").when(p < 0.8, "medium").otherwise("aggressive")


def category_of(kind: Column) -> Column:
    return F.when(kind.startswith("code"), "code").when(kind == "conversation", "conversation").when(kind == "mcp_schema", "mcp").otherwise("tool_output")


def running_usage(events: DataFrame) -> DataFrame:
    """Tokens used in the category before each event; events has session_id, category, seq, tokens."""
    w = Window.partitionBy("session_id", "category").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("tokens").over(w), F.lit(0)).cast("bigint")
    return events.withColumn("used_before", used).withColumn("level", level_for(F.col("used_before"), limit_for(F.col("category"))))


def used_and_left(usage: DataFrame, total: int = BUDGET_TOTAL) -> DataFrame:
    """Per session the tokens used in the known categories and what is left of the total, 0 at least; usage has session_id, category, tokens."""
    known = usage.where(F.col("category").isin(*BUDGET_SHARES))
    used = usage.select("session_id").distinct().join(known.groupBy("session_id").agg(F.sum("tokens").alias("used")), "session_id", "left")
    used = used.withColumn("used", F.coalesce("used", F.lit(0)).cast("bigint"))
    return used.withColumn("remaining", F.greatest(F.lit(total) - F.col("used"), F.lit(0)).cast("bigint"))


def fold_levels(total: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Levels of rows that come sorted by session, category and place; only the running sum is carried from batch to batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, used, limit = None, 0, 0
        for pdf in batches:
            levels, tokens = [], []
            for r in zip(pdf["session_id"], pdf["category"], pdf["light"], pdf["medium"], pdf["aggressive"], strict=True):
                if key != r[:2]:
                    key, used, limit = r[:2], 0, category_limit(r[1], total)
                n = pressure_step(used, limit)
                levels.append(LEVELS[n])
                tokens.append(r[2 + n])
                used += r[2 + n]
            yield pdf[["session_id", "category", "seq"]].assign(level=levels, tokens=tokens)

    return run


def category_limit(category: str, total: int = BUDGET_TOTAL) -> int:
    """limit_for of one category."""
    return int(total * float(np.float32(BUDGET_SHARES.get(category, 0.1))))


def pressure_step(used: int, limit: int) -> int:
    """Place of the level in LEVELS that a category's pressure asks for."""
    return 2 if not limit or used / limit >= 0.8 else 1 if used / limit >= 0.5 else 0


def feedback(sizes: DataFrame, total: int = BUDGET_TOTAL) -> DataFrame:
    """Levels that depend on the sizes they caused before: session_id, category, seq, level, tokens.

    sizes has the reduced size at each level (light, medium, aggressive).  Each event needs
    the one before it, so a session's category is one sorted run; it is read in batches
    and never held as a whole.
    """
    wide = sizes.select("session_id", "category", F.col("seq").cast("bigint").alias("seq"), *(F.col(v).cast("bigint").alias(v) for v in LEVELS))
    runs = wide.repartition("session_id", "category").sortWithinPartitions("session_id", "category", "seq", *LEVELS)
    return runs.mapInPandas(fold_levels(total), "session_id string, category string, seq long, level string, tokens long")
