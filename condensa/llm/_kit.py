"""Shared helpers of the training-data operators: durable tables, joins with a
checked broadcast, connected components, word hashing and sorted-group loops."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only when its measured rows times its row width stay below this.
BROADCAST_BYTES = 8 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in local mode (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="condensa-"))
    return spark.sparkContext.getCheckpointDir()


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path, as the JVM has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again, which cuts its lineage.

    The table goes when the application ends, or before that by forget().
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, where = _hadoop(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete durable tables that nothing reads any more."""
    for t in tables:
        files, where = _hadoop(t.sparkSession, t._durable_path)
        files.delete(where, True)


def free_name(name: str, *tables: DataFrame) -> str:
    """The name, lengthened until no column of the tables has it."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sized_join(left: DataFrame, right: DataFrame, on, how: str, row_bytes: int = 64) -> DataFrame:
    """Join a durable right side; broadcast it only below BROADCAST_BYTES, else shuffle."""
    if right.count() * row_bytes <= BROADCAST_BYTES:
        right = F.broadcast(right)
    return left.join(right, on, how)


def row_key(*columns: Column) -> Column:
    """A 64-bit key of a row's values; nulls count by their place."""
    return F.xxhash64(*columns, *(F.isnull(c) for c in columns))


def buckets(rows: int) -> int:
    """Sub-buckets of rows: as many as each then has rows, so that neither they nor their list is one task's burden."""
    return max(1, math.isqrt(max(0, rows - 1)) + 1)


def numbered(rows: DataFrame, equal: Column, name: str = "nth") -> DataFrame:
    """Rows of a durable table numbered from 0 among those of one key, whichever of them gets which number.

    The table has a column pid, the partition it was written by: a hot key is numbered
    partition by partition and shifted by the partitions before, so no task sees all of it.
    """
    keyed = rows.withColumn("equal", equal)
    starts = keyed.groupBy("equal", "pid").agg(F.count("*").alias("rows"))
    starts = starts.select("equal", "pid", F.coalesce(F.sum("rows").over(Window.partitionBy("equal").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("equal", "pid").orderBy("pid")) - 1
    return keyed.withColumn("inside", inside).join(starts, ["equal", "pid"]).withColumn(name, F.col("start") + F.col("inside")).drop("equal", "pid", "start", "inside")


#: Places of the bitmap that keeps rows without a partner out of a shuffle, as 2^20 words of 64 bits: its size is fixed.
FILTER_WORD_BITS = 20


def may_be_in(df: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """The rows of df whose key may be a key of kept, by a bitmap of hashed keys.

    It has at most 2^FILTER_WORD_BITS rows at every size, so it can be broadcast;
    the more keys are kept the more rows pass, and the join that follows is exact.
    """
    place = F.xxhash64(key)
    word, bit = F.shiftrightunsigned(place, 64 - FILTER_WORD_BITS), place.bitwiseAND(F.lit(63)).cast("int")
    name, at, mask = (free_name(x, df) for x in ("word", "bit", "mask"))
    words = kept.select(word.alias(name), bit.alias(at)).groupBy(name).agg(F.expr(f"bit_or(shiftleft(1L, {at}))").alias(mask))
    passed = df.withColumn(name, word).withColumn(at, bit).join(F.broadcast(words), name)
    return passed.where(f"shiftright({mask}, {at}) & 1 = 1").select(*df.columns)


def held_join(left: DataFrame, right: DataFrame, key: str, row_bytes: int = 64) -> DataFrame:
    """Inner join of wide rows with a durable right side: broadcast below BROADCAST_BYTES, else only rows that may meet are shuffled."""
    if right.count() * row_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), key)
    return may_be_in(left, key, right).join(right, key)


def without(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of df whose key is not in the one column of the durable table gone; columns of any name stay."""
    name = free_name("gone", df)
    return sized_join(df, gone.toDF(name), key == F.col(name), "left_anti", 16)


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, root) of an undirected edge list (a, b): root is the smallest node reached.

    The rounds end when nothing changes; an unfinished result is an error, never returned.

    Alternating large-star and small-star rounds; each round is written to the
    shared folder, so lost executors cost one round at most.  A hub is reduced by
    a partial minimum before anything is joined to it.
    """
    cur = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, cur = cur, durable(moved.unionByName(low2.withColumnRenamed("m", "b")).distinct(), "cc")
        forget(last)
        mark = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    return cur.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def word_hashes(words: list) -> np.ndarray:
    """64-bit hashes of words; a str counts as its UTF-8 bytes."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def windows_hash(h: np.ndarray, offsets: list[int], seed: int = 1) -> np.ndarray:
    """Hash of the words at the given offsets from each start; starts whose span leaves the text are absent."""
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    acc, factor = np.full(n, np.uint64(seed), np.uint64), 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        for o in offsets:  # an odd factor for each place makes the sum depend on the order
            acc += h[o : o + n] * np.uint64(factor)
            factor = factor * 0xD6E8FEB86659FD93 & (2**64 - 1)
    return mix64(acc)


def sorted_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Regroup key-sorted batches so that no group is cut at a batch's end."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = pdf[key].iloc[-1]
        cut = int((pdf[key].to_numpy() != last).sum())
        if rest and rest[0][key].iloc[0] != pdf[key].iloc[0]:
            yield pd.concat(rest, ignore_index=True)
            rest = []
        if cut:
            head = pdf.iloc[:cut]
            yield pd.concat([*rest, head], ignore_index=True) if rest else head.reset_index(drop=True)
            rest = []
        rest.append(pdf.iloc[cut:])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes, by array passes."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root
