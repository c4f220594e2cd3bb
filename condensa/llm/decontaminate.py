"""Operator 3: benchmark decontamination by spaced-seed hashing.

Fixed masks choose word positions in a short span; the words in between may be
substituted.  Hashes of the benchmark's spans and of the documents' are joined,
and around each hit the document is compared with the item word by word on the
hit's diagonal: the widest stretch with few substitutions counts.

Benchmark items are sent to the tasks in slices of a bounded number of words
(SLICE_WORDS); each slice sees every document, so a large benchmark costs more
passes and never more memory.

Defined results: null or empty texts match nothing; items with fewer words than
the shortest mask are compared whole only if the words stand consecutively;
repeated documents and items give rows each; ties between stretches go to the
longer, then the earlier one; texts of any length are read whole; empty tables give
no rows, or leave the documents as they are; extra columns are not read and pass
clean_documents whatever their names.  Ids stay in the JVM, so none is rounded.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensa.llm._kit import durable, row_key, windows_hash, without, word_hashes

#: 1 keeps a word position, 0 ignores it.
MASKS = ("11111111", "1101100111", "11010110011", "101101001101", "1110100101011")
#: A match needs this many aligned words (or the whole item), this percentage of them equal.
LEAST_WORDS, LEAST_EQUAL = 13, 80
SLICE_WORDS = 2_000_000
#: Words of documents whose seeds are looked up together.
TOGETHER_WORDS = 20_000
_WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def mask_offsets(n: int) -> list[list[int]]:
    """Positions of each mask that fits in n words; items too short for all use every word."""
    fit = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS if len(m) <= n]
    return fit or [list(range(n))]


def best_stretch(same: np.ndarray, least: int, percent: int) -> tuple[int, int, int] | None:
    """(length, start, equal) of the longest stretch, ends equal, with at least percent of its words equal.

    A stretch from the a-th to the b-th equal word is dense enough if the surplus at b
    lies at most 100 - percent below that at a; the smallest such a is found by bisecting
    the running minima of the surplus, so time and memory grow with the overlap only.
    """
    at = np.flatnonzero(same)
    if not len(at):
        return None
    surplus = 100 * np.arange(len(at), dtype=np.int64) - percent * at
    lowest = np.minimum.accumulate(surplus)
    # lowest falls: the first a with lowest[a] <= surplus[b] + 100 - percent
    first = np.searchsorted(-lowest, -(surplus + 100 - percent), side="left")
    length = at - at[first] + 1
    j = int(np.argmax(length))  # the first of equal lengths starts first
    if length[j] < least:
        return None
    return int(length[j]), int(at[first[j]]), int(j - first[j] + 1)


class SeedIndex:
    """Spaced-seed hashes of benchmark items, sorted for the join, with a table that keeps most other hashes out."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(tokens(t)) for _, t in items]
        rows: dict[tuple[int, ...], list] = {}
        for n, h in enumerate(self.words):
            for off in mask_offsets(len(h)) if len(h) else []:
                x = windows_hash(h, off, seed=len(off))
                rows.setdefault(tuple(off), []).append((x, np.full(len(x), n), np.arange(len(x))))
        self.tables = {}
        for off, parts in rows.items():
            x, n, p = (np.concatenate([r[i] for r in parts]) for i in range(3))
            order = np.argsort(x, kind="stable")
            some = np.zeros(1 << max(10, (16 * len(x)).bit_length()), bool)  # by low bits: whether a hash may be there
            some[x & np.uint64(len(some) - 1)] = True
            self.tables[off] = (x[order], n[order], p[order], some)

    def diagonals(self, texts: list[np.ndarray]) -> list[set[tuple[int, int]]]:
        """(item number, shift) of every seed that a text shares with an item; texts are read together."""
        flat = np.concatenate(texts)
        size = np.array([len(h) for h in texts])
        first, owner = np.cumsum(size) - size, np.repeat(np.arange(len(texts)), size)
        out: list[set[tuple[int, int]]] = [set() for _ in texts]
        for off, (x, n, p, some) in self.tables.items():
            mine = windows_hash(flat, list(off), seed=len(off))
            at = np.flatnonzero(some[mine & np.uint64(len(some) - 1)])
            at = at[owner[at] == owner[at + off[-1]]]  # spans that leave their text are none
            lo = np.searchsorted(x, mine[at])
            lo[lo == len(x)] = 0
            hit = x[lo] == mine[at]
            for d, k in zip(at[hit].tolist(), lo[hit].tolist(), strict=True):
                t, key = int(owner[d]), x[k]
                while k < len(x) and x[k] == key:
                    out[t].add((int(n[k]), d - int(first[t]) - int(p[k])))
                    k += 1
        return out

    def verified(self, h: np.ndarray, diagonals: set[tuple[int, int]], least: int, percent: int) -> dict[int, tuple[int, int, int]]:
        """Item number -> (words, start in the text, equal words) of the best stretch on the given diagonals."""
        out: dict[int, tuple[int, int, int]] = {}
        for n, shift in sorted(diagonals):
            item = self.words[n]
            a, b = max(0, -shift), min(len(item), len(h) - shift)
            got = best_stretch(item[a:b] == h[a + shift : b + shift], min(least, len(item)), percent)
            if got and (n not in out or (got[0], -(a + shift + got[1])) > (out[n][0], -out[n][1])):
                out[n] = (got[0], a + shift + got[1], got[2])
        return out

    def match(self, texts: list[np.ndarray], least: int, percent: int) -> list[dict[int, tuple[int, int, int]]]:
        """verified() of each text."""
        return [self.verified(h, found, least, percent) for h, found in zip(texts, self.diagonals(texts), strict=True)]


def _matches(sent, least: int, percent: int):
    @F.pandas_udf("array<struct<item_id:bigint,n_words:int,first_word:int,n_equal:int>>")
    def run(texts: pd.Series) -> pd.Series:
        slice_ = sent.value  # one object in a Python worker, so its tasks share the index
        if "index" not in slice_:
            slice_["index"] = SeedIndex(slice_["items"])
        index, out, held, words = slice_["index"], [], [], 0

        def flush():
            for found in index.match(held, least, percent):
                out.append([{"item_id": index.ids[n], "n_words": length, "first_word": start, "n_equal": equal} for n, (length, start, equal) in found.items()] or None)
            held.clear()

        for t in texts:
            held.append(word_hashes(tokens(t)))
            words += len(held[-1])
            if words > TOGETHER_WORDS:
                flush()
                words = 0
        if held:
            flush()
        return pd.Series(out, dtype=object)

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_WORDS, percent: int = LEAST_EQUAL, key: Column | None = None) -> DataFrame:
    """doc_id (or key), item_id, n_words, first_word, n_equal: each document's best overlap with each item it meets."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text is not null")
    words = items.agg(F.sum(F.length("text") / 4 + 1)).first()[0] or 0
    slices = max(1, int(-(-words // SLICE_WORDS)))
    mine, found = F.col("doc_id") if key is None else key.alias("key"), None
    for i in range(slices):
        part = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i).collect()]
        matches = _matches(spark.sparkContext.broadcast({"items": part}), least, percent)
        got = docs.select(mine, F.explode(matches("text")).alias("m"))  # explode drops texts without matches
        got = got.select(got.columns[0], "m.item_id", "m.n_words", "m.first_word", "m.n_equal")
        found = got if found is None else found.unionByName(got)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without an overlap, with their columns, whatever these are called."""
    key = row_key(docs["doc_id"], docs["text"])
    hit = durable(overlaps(docs, benchmark, key=key).select("key").distinct(), "decontaminate")
    return without(docs, key, hit)


def op3_decontaminate(spark, sf_dir):
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql() -> str:
    masks = ", ".join(f"({len(m)}, {[i for i, c in enumerate(m) if c == '1']})" for m in MASKS)
    words = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
    key = "array_to_string(list_transform(o, lambda x: w[p + x + 1]), ' ')"
    return f"""
WITH m AS (SELECT * FROM (VALUES {masks}) v(span, o)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
b AS MATERIALIZED (SELECT row_number() OVER () AS n, item_id, {words} AS w FROM benchmark WHERE text IS NOT NULL),
bo AS (SELECT n, w, o FROM b JOIN m ON span <= len(w) UNION ALL SELECT n, w, range(len(w)) FROM b WHERE len(w) BETWEEN 1 AND (SELECT min(span) FROM m) - 1),
bs AS (SELECT n, o, p, {key} AS k FROM (SELECT *, unnest(range(len(w) - o[-1])) AS p FROM bo)),
ds AS (SELECT r, o, p, {key} AS k FROM (SELECT d.*, x.o, unnest(range(len(w) - x.o[-1])) AS p FROM d JOIN (SELECT DISTINCT o FROM bs) x ON len(w) > x.o[-1])),
g AS MATERIALIZED (SELECT DISTINCT ds.r, bs.n, ds.p - bs.p AS shift FROM ds JOIN bs ON ds.o = bs.o AND ds.k = bs.k),
e AS MATERIALIZED (SELECT r, n, shift, i, row_number() OVER (PARTITION BY r, n, shift ORDER BY i) AS c FROM (
 SELECT g.*, unnest(list_filter(range(greatest(0, -shift), least(len(b.w), len(d.w) - shift)), lambda i: b.w[i + 1] = d.w[i + shift + 1])) AS i FROM g JOIN b USING (n) JOIN d USING (r))),
s AS (SELECT x.r, x.n, x.shift, y.i - x.i + 1 AS n_words, x.i + x.shift AS first_word, y.c - x.c + 1 AS n_equal FROM e x JOIN e y ON x.r = y.r AND x.n = y.n AND x.shift = y.shift AND y.c >= x.c JOIN b ON b.n = x.n
 WHERE y.i - x.i + 1 >= least({LEAST_WORDS}, len(b.w)) AND 100 * (y.c - x.c + 1) >= {LEAST_EQUAL} * (y.i - x.i + 1)),
t AS (SELECT *, row_number() OVER (PARTITION BY r, n ORDER BY n_words DESC, first_word, shift) AS rank FROM s)
SELECT doc_id, item_id, n_words::INT AS n_words, first_word::INT AS first_word, n_equal::INT AS n_equal FROM t JOIN d USING (r) JOIN b USING (n) WHERE rank = 1"""


OP3_SQL = _sql()
