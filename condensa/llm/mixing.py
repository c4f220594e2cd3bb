"""Operator 1: mixing sources to target weights.

Each source's words, taken in a pseudorandom order of its documents, are packed
into blocks of a fixed length.  A source's target turns into a number of slots;
output shards draw multinomial counts of them from what is left, and slot j of a
source maps through the source's pseudorandom permutation of block indices (a new
one in each pass over the source).  Blocks and slots meet by index in a join.

Documents get word offsets by ranks in sub-buckets of their source plus the
sub-buckets' starts, so a source with a third of all rows is many tasks' work.
Only one row per source reaches the driver (MAX_SOURCES bounds that).

Defined results: null or empty text has size 0 and is never taken; a null source
is a source of its own, the last; repeated rows take words each for itself; a
corpus without words, or an empty table, has target 0 everywhere; texts of any length
are packed whole; other columns are not read.  A block has BLOCK_WORDS words, or a 256th
of the source where that is less, so that a small source's slots still come near its
target; a source's last block may be shorter.  A corpus of over MAX_SOURCES sources is
an error: the targets are one list on the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.llm._kit import buckets, durable, mix64, numbered, row_key, sized_join

WORDS = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 128
SHARDS = 256
MAX_SOURCES = 100_000
CYCLE = (5.0, 2.0, 1.0)


def targets(sizes: list[float], weights: list[float], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Shares of share * total by weight, none above cap times its size; the excess is reshared."""
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def draw_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """shards x sources: multinomial draws from the slots left, so that the columns sum to slots."""
    rng, left = np.random.default_rng(seed), np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for m in range(shards):
        total = int(left.sum())
        if m == shards - 1 or not total:
            out[m] = left
        else:
            got = np.minimum(rng.multinomial(-(-total // (shards - m)), left / total), left)
            out[m] = got
        left -= out[m]
    return out


def permuted(j: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom bijection of 0 .. n-1: a four-round Feistel network, walked until inside."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    low = np.uint64((1 << half) - 1)

    def once(x):
        a, b = x >> np.uint64(half), x & low
        for r in range(4):
            with np.errstate(over="ignore"):
                a, b = b, a ^ (mix64(b + np.uint64((seed * 31 + r * 1_000_003 + 12345) & (2**64 - 1))) & low)
        return (a << np.uint64(half)) | b

    x = once(j.astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def _slot_rows(sent, seed: int, step: int):
    """The slots of chunks (id): source, block that the permutation gives, slot, and the shard whose draw the slot is part of."""

    def run(batches):
        chunks, slots, blocks, ends = sent.value
        for pdf in batches:
            for c in pdf["id"].to_numpy():
                s = int(np.searchsorted(chunks, c, side="right")) - 1
                first, n = int(c - chunks[s]) * step, int(blocks[s])
                j = np.arange(first, min(first + step, int(slots[s])))
                turn = j // n
                index = np.concatenate([permuted(j[turn == t] % n, n, seed + 7919 * s + 104_729 * int(t)) for t in np.unique(turn)])
                yield pd.DataFrame({"s": s, "block": index, "slot": j, "shard": np.searchsorted(ends[:, s], j, side="right")})

    return run


def _mixed_pieces(docs: DataFrame, share: float, cap: float, cycle, seed: int, key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces): each document's place in its source, and the part of it in every slot that takes it.

    rows: row, doc_id, source, size, source_size, target, s, len, at, key;
    pieces: row, s, shard, slot, block, from (word of the document), words.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("th"), key.alias("key"), F.spark_partition_id().alias("pid"))
    rows = durable(rows, "mix-rows")
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # Python compares by code point
    sizes = [r["size"] for r in found]
    goal = targets([float(x) for x in sizes], [cycle[i % len(cycle)] for i in range(len(found))], share, cap)
    length = [max(1, min(BLOCK_WORDS, x // 256)) for x in sizes]
    n_blocks = [-(-x // n) for x, n in zip(sizes, length, strict=True)]
    slots = [min(round(g / x * b), math.floor(cap * b)) if x else 0 for g, x, b in zip(goal, sizes, n_blocks, strict=True)]
    known = spark.createDataFrame([(i, r["source"], s, float(g), n, buckets(r["rows"])) for i, (r, s, g, n) in enumerate(zip(found, sizes, goal, length, strict=True))], "s int, src string, source_size long, target double, len int, parts int")
    rows = numbered(rows, row_key(F.col("doc_id"), F.col("th"), F.col("source"), F.col("size"), F.col("key")))
    rows = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("src"))).drop("src")  # at most MAX_SOURCES rows
    rows = rows.withColumn("place", F.xxhash64("doc_id", "th", "nth", F.lit(seed))).withColumn("part", F.floor((F.shiftrightunsigned("place", 11).cast("double") / float(1 << 53)) * F.col("parts")).cast("int"))
    starts = rows.groupBy("s", "part").agg(F.sum("size").alias("words")).withColumn("start", F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("words")
    inside = F.sum("size").over(Window.partitionBy("s", "part").orderBy("place", "doc_id", "size", "key", "nth").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, ["s", "part"]).withColumn("at", F.col("start") + F.col("inside")).withColumn("row", F.monotonically_increasing_id())
    placed = durable(placed.select("row", "doc_id", "source", "size", "source_size", "target", "s", "len", "at", "key"), "mix-placed")
    step = 1 << 16
    n_chunks = [-(-n // step) for n in slots]
    # a shard's slots of a source end where its draws and those of the shards before add up to
    ends = draw_counts(slots, SHARDS, seed).cumsum(axis=0)
    sent = spark.sparkContext.broadcast((np.cumsum([0, *n_chunks[:-1]]) if n_chunks else np.zeros(0), np.array(slots), np.array(n_blocks), ends))
    total = sum(n_chunks)
    slot_rows = spark.range(0, total, 1, max(1, min(total, 4096))).mapInPandas(_slot_rows(sent, seed, step), "s int, block long, slot long, shard int")
    first, last = F.floor(F.col("at") / F.col("len")), F.floor((F.col("at") + F.col("size") - 1) / F.col("len"))
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("at"), F.col("block") * F.col("len"))
    words = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("len")) - begin
    pieces = pieces.select("row", "s", "block", (begin - F.col("at")).alias("from"), words.alias("words"))
    # both sides grow with the input: never broadcast
    return placed, pieces.join(slot_rows.hint("merge"), ["s", "block"]).select("row", "s", "shard", "slot", "block", "from", "words")


def _taken(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    got = pieces.groupBy("row").agg(F.sum("words").cast("long").alias("taken"))
    return placed.join(got, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, cycle=CYCLE, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, and the words that the mixed slots take of it."""
    return _taken(*_mixed_pieces(docs, share, cap, cycle, seed, F.lit(0))).select("doc_id", "source", "size", "source_size", "target", "taken")


def _planned(docs: DataFrame, key: Column, plan: DataFrame, row_bytes: int) -> DataFrame:
    """docs with the plan of their key (mix_key, mix_rows and more); of rows equal in all columns one stands for all."""
    joined = sized_join(docs, plan, key == F.col("mix_key"), "inner", row_bytes)
    if not plan.where("mix_rows > 1").limit(1).count():
        return joined
    return joined.where("mix_rows = 1").unionByName(joined.where("mix_rows > 1").dropDuplicates(["mix_key"]))


def mixed_blocks(docs: DataFrame, share: float = 1.5, cap: float = 2.0, cycle=CYCLE, seed: int = 17) -> DataFrame:
    """The mix itself, one row per slot: shard, source, slot, block, doc_ids, n_words, text (words joined by spaces)."""
    docs = docs.select("doc_id", "source", "text")
    key = row_key(*(docs[c] for c in docs.columns))
    placed, pieces = _mixed_pieces(docs, share, cap, cycle, seed, key)
    pieces = durable(pieces, "mix-pieces")
    spots = placed.where("size > 0").groupBy("key").agg(F.collect_list(F.struct("row", "at", "size", "len")).alias("spots"))
    plan = durable(spots.select(F.col("key").alias("mix_key"), F.size("spots").alias("mix_rows"), "spots"), "mix-spots")
    texts = _planned(docs, key, plan, 80).select(F.regexp_extract_all("text", F.lit(WORDS), 0).alias("all"), F.explode("spots").alias("x"))

    def cut(words: Column) -> Column:  # bound by the outer transform, so that the words are found once a document
        first, last = F.floor(F.col("x.at") / F.col("x.len")), F.floor((F.col("x.at") + F.col("x.size") - 1) / F.col("x.len"))

        def one(block: Column) -> Column:
            begin = F.greatest(F.lit(0).cast("long"), block * F.col("x.len") - F.col("x.at"))
            end = F.least(F.col("x.size"), (block + 1) * F.col("x.len") - F.col("x.at"))
            return F.struct(block.alias("block"), F.array_join(F.slice(words, (begin + 1).cast("int"), (end - begin).cast("int")), " ").alias("text"))

        return F.transform(F.sequence(first, last), one)

    texts = texts.select(F.col("x.row").alias("row"), F.explode(F.element_at(F.transform(F.array("all"), cut), 1)).alias("b")).select("row", "b.block", "b.text")
    full = pieces.join(texts, ["row", "block"]).join(placed.select("row", "doc_id", "source", "at"), "row")
    parts = full.groupBy("shard", "s", "source", "slot", "block").agg(F.array_sort(F.collect_list(F.struct("at", "row", "doc_id", "text"))).alias("p"), F.sum("words").cast("long").alias("n_words"))
    return parts.select("shard", "source", "slot", "block", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), "n_words", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def mixed_documents(docs: DataFrame, share: float = 1.5, cap: float = 2.0, cycle=CYCLE, seed: int = 17) -> DataFrame:
    """The documents as often as the mix takes their words, on average: the whole times, and once more by the rest as chance.

    Of rows equal in all columns, one stands for the copies of all.  Columns of any name pass.
    """
    names = docs.columns
    key = row_key(*(docs[c] for c in names))
    taken = _taken(*_mixed_pieces(docs, share, cap, cycle, seed, key)).where("taken > 0")
    chance = F.shiftrightunsigned(F.xxhash64("s", "at", F.lit(seed + 1)), 11).cast("double") / float(1 << 53)  # the place is a row's own
    times = F.floor(F.col("taken") / F.col("size") + chance).cast("int")
    plan = taken.groupBy("key").agg(F.sum(times).cast("int").alias("mix_times"), F.count("*").alias("mix_rows")).where("mix_times > 0")
    plan = durable(plan.withColumnRenamed("key", "mix_key"), "mix-plan")
    renamed = docs.toDF(*(f"c{i}" for i in range(len(names))))  # the plan's names cannot clash with these
    joined = _planned(renamed, row_key(*(renamed[c] for c in renamed.columns)), plan, 24)
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select(*renamed.columns).toDF(*names)


def op1_mixing(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mixing_targets(spark, sf_dir):
    """The columns of op1_mixing that no draw decides."""
    return op1_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


#: Sources in the order in which their targets reach twice their size; the first one that does not ends the run of those that do.
TARGETS_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source) AS i, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
c AS (SELECT *, total - coalesce(sum(2 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_, sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM o),
k AS (SELECT coalesce(min(i), (SELECT count(*) + 1 FROM c)) AS first FROM c WHERE left_ * w / weights <= 2 * source_size),
t AS (SELECT source, source_size, CASE WHEN i < first THEN 2.0::DOUBLE * source_size ELSE (SELECT left_ FROM c WHERE i = first) * w / (SELECT weights FROM c WHERE i = first) END AS target FROM c, k)
SELECT d.doc_id, d.size::BIGINT AS size, t.source_size, t.target FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
"""
