"""Operator 6: sharding by rendezvous hashing of stable record keys.

Every shard draws a weighted score from the record's key, the highest takes the
record, so one more shard takes records only into itself.  Slots number a shard's
rows from 0 without gaps: rows are ranked inside small sub-buckets of a shard and
shifted by the counts of the sub-buckets before, so no task sees a whole shard.

Defined results: a null doc_id is a key like any other; null text has size 1 and
the checksum of no bytes; repeated rows go to one shard and get slots of their
own, each in its place of a law that equal keys share; an empty table gives no rows;
only a text's length and checksum are read, however long; other columns of the input
are not read by op6 and pass assign_shards, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.llm._kit import buckets, durable, free_name, numbered, row_key

#: Bits of a draw: 13 hexadecimal digits of an MD5 sum.
DIGITS, STEPS = 13, float(1 << 52)
NULL_KEY = "null"


def draw(*parts: Column) -> Column:
    """A pseudorandom whole number below STEPS of the parts' texts."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit(NULL_KEY)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key; a shard's chance is its share of the weights."""
    def bid(shard: int, weight: float) -> Column:
        u = (draw(key, F.lit(shard)).cast("double") + F.lit(0.5)) / F.lit(STEPS)
        return F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(-shard).alias("shard"))

    if len(weights) == 1:
        return F.lit(0)
    return -F.greatest(*(bid(i, w) for i, w in enumerate(weights)))["shard"]


def shard_rows(df: DataFrame, key: str, weights: list[float], tie: list[str]) -> DataFrame:
    """Add shard and slot; rows of a shard are ordered by a hash, which spreads equal rows as well, then key (null last) and tie."""
    ties = [F.col(c) for c in tie]
    placed = durable(df.withColumn("shard", rendezvous(F.col(key), weights)).withColumn("pid", F.spark_partition_id()), "shards")
    n = buckets(placed.count() // len(weights) + 1)
    placed = numbered(placed, row_key(F.col(key), *ties)).withColumn("place", draw(F.lit("place"), F.col(key), *ties, F.col("nth")))
    placed = durable(placed.withColumn("part", F.floor(F.col("place") / F.lit(STEPS) * n).cast("int")), "shard-places")
    sizes = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    before = sizes.withColumn("start", F.sum("rows").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("place", F.col(key).asc_nulls_last(), *tie, "nth")) - 1
    out = placed.withColumn("inside", inside).join(before.drop("rows"), ["shard", "part"])
    return out.withColumn("slot", F.col("inside") + F.coalesce("start", F.lit(0))).drop("inside", "start", "part", "place", "nth")


def shard_documents(docs: DataFrame, shards: int = 16, weights: list[float] | None = None) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    weights = weights or [1.0] * shards
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    grown = rendezvous(F.col("doc_id"), [*weights, sum(weights) / len(weights)])
    out = shard_rows(rows.withColumn("grown_shard", grown.cast("int")), "doc_id", weights, ["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), "grown_shard")


def assign_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Documents with their shard as one more column: shard, or shard_ where the input has that name already."""
    return docs.withColumn(free_name("shard", docs), rendezvous(docs["doc_id"], [1.0] * shards).cast("int"))


def op6_sharding(spark, sf_dir):
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_draw(*parts: str) -> str:
    return "('0x' || left(md5(" + " || ':' || ".join(f"coalesce(({p})::VARCHAR, '{NULL_KEY}')" for p in parts) + f"), {DIGITS}))::BIGINT"


def _sql_shard(shards: int) -> str:
    bids = ", ".join(f"1.0::DOUBLE / -ln(({_sql_draw('doc_id', str(i))}::DOUBLE + 0.5) / {STEPS})" for i in range(shards))
    return f"list_position([{bids}], list_max([{bids}])) - 1"


#: A text's CRC-32 by a table of 256 remainders.
OP6_SQL = f"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32 FROM documents, t),
s AS (SELECT *, ({_sql_shard(16)})::INT AS shard, ({_sql_shard(17)})::INT AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY {_sql_draw("'place'", 'doc_id', 'text_crc32', 'size', 'nth')}, doc_id NULLS LAST, text_crc32, size, nth) - 1 AS slot, grown_shard
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text_crc32, size) - 1 AS nth FROM s)
"""
