"""Text primitives as native columns: lines, trims, bytes, tokens, hashes, similarity."""

from __future__ import annotations

import base64
import sys
import types

import pandas as pd
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """Lines without their ends: one \\r before a \\n goes, no empty line after a final \\n."""
    parts = F.split(text, "\n", -1)
    ended = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    last = F.element_at(parts, -1)
    return F.when(last == "", ended).otherwise(F.concat(ended, F.array(last)))


def first_lines(text: Column, n: int) -> Column:
    """The first n lines; the rest of a long text is not split."""
    parts = F.split(text, "\n", n + 1)
    return F.transform(F.slice(parts, 1, n), lambda x: F.regexp_replace(x, r"\r\z", ""))


def trim_wide(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|(?<!\s)\s++\z", "")


def shorter_trimmed(text: Column, limit: int) -> Column:
    """Whether the trimmed text has less than limit bytes; only a text with white space at an end is trimmed."""
    blank = lambda c: c.rlike(r"(?U)\A\s")
    framed = blank(F.substring(text, 1, 1)) | blank(F.substring(text, -1, 1))
    return (F.octet_length(text) < limit) | (framed & (F.octet_length(trim_wide(text)) < limit))


def role_of(line: Column) -> Column:
    """The text before the first colon."""
    return F.substring_index(line, ":", 1)


def indent_width(line: Column) -> Column:
    """Bytes of white space in front."""
    return F.octet_length(line) - F.octet_length(F.regexp_replace(line, r"(?U)\A\s+", ""))


def cut_bytes(text: Column, limit: int) -> Column:
    """At most limit bytes of UTF-8, whole characters only, with ... if something went."""
    chars = F.split(F.substring(text, 1, limit), "")
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"), F.lit(True).alias("open"))

    def step(acc: Column, c: Column) -> Column:
        n = acc["n"] + F.octet_length(c)
        fits = acc["open"] & (n <= limit)
        return F.struct(F.when(fits, n).otherwise(acc["n"]).alias("n"), F.when(fits, F.concat(acc["out"], c)).otherwise(acc["out"]).alias("out"), fits.alias("open"))

    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.aggregate(chars, start, step, lambda a: a["out"]), F.lit("...")))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / F.lit(3.5)).cast("bigint")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def saved_ratio(before: Column, after: Column) -> Column:
    return F.when(before > 0, 1 - after / before).otherwise(F.lit(0.0))


def line_similarity(a: Column, b: Column) -> Column:
    """Equal characters at equal places over the larger byte length; 1 for equal lines."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x))
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(F.try_divide(F.when((a == "") | (b == ""), F.lit(0)).otherwise(same), longest))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "(?d)\\x1b\\[[0-9;]*[A-Za-z]|\\x1b\\].*?\\x07", "")


def line_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), trim_wide), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: both empty 1, one empty 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def tokenizer(ranks_path: str, pattern: str):
    """The byte-pair encoder of a vocabulary file; a process loads it once.

    Functions of this package reach a worker by value, a new copy for each task, so what
    is to outlast a task is kept in a module of its own.
    """
    kept = sys.modules.setdefault("condensa_kept", types.ModuleType("condensa_kept")).__dict__
    if (ranks_path, pattern) not in kept:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[ranks_path, pattern] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return kept[ranks_path, pattern]


def exact_tokens(text: Column, ranks_path: str, pattern: str) -> Column:
    """Byte-pair token counts by a vocabulary file of ranks on every executor; null and empty texts have 0."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = tokenizer(ranks_path, pattern)
        return texts.map(lambda t: len(enc.encode_ordinary(t or "")))

    return count(text)
