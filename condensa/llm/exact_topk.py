"""Operator 7: exact top-k inner products by block-at-a-time pruning.

A task orders its vectors by recursive bisection along their main axis, so that alike
ones share a block.  A block keeps, per dimension, the largest and smallest value: their
sum over a query's signed terms bounds every score in the block.  Per query the blocks
are taken by falling bound and scored through the block's own matrix (its forward index)
until the bound is below the k-th score.  Queries come in sets of at most QUERY_ROWS rows,
which bounds what is broadcast; each task keeps k rows per query and the ranks are merged
by key.

Scores are exact integers.  Where every product sum stays below 2^53, doubles hold them;
vectors and queries with larger components are scored in doubles with an error bound
first, and what may reach the k best is scored again in whole numbers of any size.

Defined results: null vectors and vectors with null or non-finite components take no
part, neither do null ids; ties, at rank k too, go to the smaller id; repeated rows count
each; an empty table gives no rows; vectors of other lengths than the query's meet it in
the leading dimensions; a score beyond a long is given as the nearest long and ranks by
its own value, up to 38 digits; other columns are not read, whatever their names.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS = 16_384
BLOCK_ROWS = 64
LONG, DIGITS = 2**63 - 1, 10**38 - 1


def _matrix(vectors, dims: int, scale: float) -> np.ndarray:
    """Rows of floor(scale * x), as doubles."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : min(len(v), dims)] = v[:dims]
    return np.floor(scale * out)


def similar_order(x: np.ndarray) -> np.ndarray:
    """Row numbers in runs of BLOCK_ROWS alike rows: halves along the axis of the largest spread, again and again."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK_ROWS:
            out.append(rows)
            continue
        part = x[rows] - x[rows].mean(axis=0)
        axis = part[np.argmax((part * part).sum(axis=1))]
        for _ in range(4):  # power steps towards the main axis
            axis = part.T @ (part @ axis)
            size = np.abs(axis).max()
            if not size or not np.isfinite(size):
                break
            axis = axis / size
        cut = -(-(len(rows) // 2) // BLOCK_ROWS) * BLOCK_ROWS
        order = np.argsort(part @ axis, kind="stable")
        todo += [rows[order[cut:]], rows[order[:cut]]]
    return np.concatenate(out) if out else np.empty(0, np.int64)


class Blocks:
    """Blocks of vectors with their bounds."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        order = similar_order(x)
        self.x, self.ids = x[order], ids[order]
        self.cuts = np.arange(0, len(ids), BLOCK_ROWS)
        self.high, self.low = np.maximum.reduceat(self.x, self.cuts), np.minimum.reduceat(self.x, self.cuts)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Queries x blocks: no score in a block is larger."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return up @ self.high.T + down @ self.low.T

    def rows(self, b: int) -> slice:
        return slice(self.cuts[b], self.cuts[b] + BLOCK_ROWS)


class Best:
    """The k best (score, smaller id first) of each query so far; scores are whole numbers that doubles hold."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.q_ids, self.q, self.k = ids, q, k
        self.score = np.full((len(ids), k), -np.inf)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.scored = self.met = 0

    def search(self, blocks: Blocks) -> None:
        bound = blocks.bounds(self.q)
        order = np.argsort(-bound, axis=1, kind="stable")
        every = np.arange(len(self.q))
        self.met += bound.size
        for r in range(order.shape[1]):  # each query's r-th best block
            b = order[every, r]
            every, b = (z[bound[every, b] >= self.score[every, -1]] for z in (every, b))
            if not len(every):
                break
            self.scored += len(every)
            turn = np.argsort(b, kind="stable")
            for who in np.split(every[turn], np.flatnonzero(np.diff(b[turn])) + 1):
                self._add(who, blocks, int(order[who[0], r]))

    def _add(self, who: np.ndarray, blocks: Blocks, b: int) -> None:
        rows = blocks.rows(b)
        score = self.q[who] @ blocks.x[rows].T
        ids = np.broadcast_to(blocks.ids[rows], score.shape)
        score = np.where(ids == self.q_ids[who][:, None], -np.inf, score)
        some = (score >= self.score[who, -1][:, None]).any(axis=1)
        who, score, ids = who[some], score[some], ids[some]
        score, ids = np.hstack([self.score[who], score]), np.hstack([self.id[who], np.where(np.isinf(score), np.iinfo(np.int64).max, ids)])
        top = np.lexsort((ids, -score), axis=-1)[:, : self.k]
        self.score[who], self.id[who] = np.take_along_axis(score, top, 1), np.take_along_axis(ids, top, 1)

    def found(self) -> list[tuple[int, int, int]]:
        n, j = np.nonzero(np.isfinite(self.score))
        return list(zip(self.q_ids[n].tolist(), self.id[n, j].tolist(), self.score[n, j].astype(np.int64).tolist(), strict=True))


def large_scores(q_id: int, q: np.ndarray, blocks: Blocks, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """best, a query's k best (-score, id) so far, and those of the blocks, in whole numbers of any size."""
    whole = [int(v) for v in q]
    with np.errstate(over="ignore", invalid="ignore"):
        slack = 1e-13 * len(q) * (np.abs(q) @ np.maximum(np.abs(blocks.high), np.abs(blocks.low)).T)
        bound = blocks.bounds(q[None])[0] + slack
        for b in np.argsort(np.where(np.isnan(bound), -np.inf, -bound), kind="stable"):
            least = float(-best[-1][0]) if len(best) == k else -np.inf
            if bound[b] < least - abs(least) * 1e-15:
                break
            x, ids = blocks.x[blocks.rows(b)], blocks.ids[blocks.rows(b)]
            near = x @ q
            most = near + 1e-13 * len(q) * (np.abs(x) @ np.abs(q))
            for i in np.flatnonzero(~(most < least - abs(least) * 1e-15) & (ids != q_id)):
                best.append((-sum(int(a) * w for a, w in zip(x[i], whole, strict=True)), int(ids[i])))
            best = sorted(best)[:k]
    return best


def _search(queries, k: int, scale: float):
    def run(batches):
        q_ids, q = queries.value
        dims = q.shape[1]
        most = 2.0**26 / max(1, dims) ** 0.5  # products of smaller components add up to less than 2^53
        small = np.abs(q).max(axis=1, initial=0) <= most
        best, large = Best(q_ids[small], q[small], k), {}
        for pdf in batches:
            if not len(pdf):
                continue
            x, ids = _matrix(pdf["v"].tolist(), dims, scale), pdf["vec_id"].to_numpy()
            tame = np.abs(x).max(axis=1, initial=0) <= most
            if tame.any() and small.any():
                best.search(Blocks(x[tame], ids[tame]))
            for rows, who in ((~tame, np.arange(len(q))), (tame, np.flatnonzero(~small))):
                if rows.any() and len(who):
                    blocks = Blocks(x[rows], ids[rows])
                    for n in who:
                        large[n] = large_scores(int(q_ids[n]), q[n], blocks, large.get(n, []), k)
        out = best.found() + [(int(q_ids[n]), i, -s) for n, got in large.items() for s, i in got]
        if out:
            frame = pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype=object)
            over = [Decimal(max(-DIGITS, min(DIGITS, s))) if abs(s) > LONG else None for s in frame["score"]]
            frame["score"] = [max(-LONG - 1, min(LONG, s)) for s in frame["score"]]
            yield frame.astype({"query_id": "int64", "vec_id": "int64", "score": "int64"}).assign(over=pd.Series(over, dtype=object))

    return run


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the components as doubles, of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score of (vec_id, v) rows for each row of queries; components count as floor(scale * x)."""
    spark = vectors.sparkSession
    n = queries.count()
    sets = max(1, -(-n // QUERY_ROWS))
    kinds, found = "query_id long, vec_id long, score long, over decimal(38,0)", None
    for i in range(sets):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(sets)) == i).toPandas()
        if not len(part):
            continue
        dims = max((len(v) for v in part["v"]), default=0)
        sent = spark.sparkContext.broadcast((part["vec_id"].to_numpy(np.int64), _matrix(part["v"].tolist(), dims, scale)))
        got = vectors.mapInPandas(_search(sent, k, scale), kinds)
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = spark.createDataFrame([], kinds)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("over", F.col("score").cast("decimal(38,0)"))), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark, sf_dir):
    v = taking_part(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(v, v.where("vec_id % 100 = 0"))


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
