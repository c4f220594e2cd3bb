"""The reducers as SQL functions, and table functions of lines and turns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from condensa.operators.diffs import make_patch
from condensa.operators.reducers import parse_turns, reduce_text, split_lines


class TextLines:
    """text_lines(text): place from 0, line."""

    def eval(self, text: str):
        for i, line in enumerate(split_lines(text or "")):
            yield i, line


class TextTurns:
    """text_turns(text): place from 0, role, number of lines, the turn's text."""

    def eval(self, text: str):
        for i, (role, rows) in enumerate(parse_turns(text or "")):
            yield i, role, len(rows), "\n".join(rows)


def register(spark: SparkSession) -> None:
    """Make reduce_text, unified_patch, text_lines and text_turns known to SQL."""

    @F.pandas_udf("string")
    def reduce(texts: pd.Series, kinds: pd.Series, level_names: pd.Series) -> pd.Series:
        return pd.Series([reduce_text(t, k, v) for t, k, v in zip(texts, kinds, level_names, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def patch(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else make_patch(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    spark.udf.register("reduce_text", reduce)
    spark.udf.register("unified_patch", patch)
    spark.udtf.register("text_lines", F.udtf(TextLines, returnType="place: int, line: string"))
    spark.udtf.register("text_turns", F.udtf(TextTurns, returnType="place: int, role: string, n: int, raw: string"))
