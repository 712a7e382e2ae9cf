"""Exact top-k search by inner product with MaxScore."""
from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treadline.session import materialise

SCALE = 1024
SHARD, QUERIES = 1 << 14, 1 << 13


class Postings:
    """The inverted lists of a shard: per term the rows that have it and their weights, and the largest and least weight."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]) -> None:
        self.ids, self.n = ids, len(ids)
        self.terms = max(map(len, vectors), default=0)
        dense = np.zeros((self.terms, self.n), np.int64)
        for k, v in enumerate(vectors):
            dense[: len(v), k] = v
        self.weights = dense
        self.rows: list[np.ndarray | None] = []
        for d in range(self.terms):
            rows = np.flatnonzero(dense[d])
            self.rows.append(None if len(rows) == self.n else rows)
        # A row without the term counts as weight 0.
        self.high = np.array([dense[d].max(initial=0) for d in range(self.terms)], np.int64)
        self.low = np.array([dense[d].min(initial=0) for d in range(self.terms)], np.int64)

    def best(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The ``k`` rows of highest score but for ``own``, as (score, id), ties to smaller ids.

        Terms are taken by falling upper bound. While the bounds of the rest can lift a new row to the k-th best score known so far, a term is
        essential and its whole list is traversed. The other terms are probed only for rows that can still reach that score, and
        rows fall out as the bounds shrink. The k-th best partial score, plus the least the rest can add, is a floor from the start.
        """
        width = min(self.terms, len(query))
        q = query[:width]
        up = np.maximum(q * self.high[:width], q * self.low[:width])
        down = np.minimum(q * self.high[:width], q * self.low[:width])
        order = np.argsort(-(up - down), kind="stable")
        rest_up, rest_down = int(up.sum()), int(down.sum())
        score = np.zeros(self.n, np.int64)
        alive: np.ndarray | None = None
        allowed = self.ids != own
        size = min(k, int(allowed.sum()))
        if not size:
            return []
        for step, d in enumerate(order.tolist()):
            rest_up, rest_down = rest_up - int(up[d]), rest_down - int(down[d])
            if q[d]:
                if alive is None:
                    rows = self.rows[d]
                    if rows is None:
                        score += q[d] * self.weights[d]
                    else:
                        score[rows] += q[d] * self.weights[d][rows]
                else:
                    score[alive] += q[d] * self.weights[d][alive]
            if step % 8 == 7 and step + 1 < width:
                now = np.flatnonzero(allowed) if alive is None else alive
                floor = np.partition(score[now], len(now) - size)[len(now) - size] + rest_down
                alive_now = now[score[now] + rest_up >= floor]
                # Lists are traversed whole until so few rows are left that probing is cheaper.
                if alive is not None or 2 * len(alive_now) <= self.n:
                    alive = alive_now
        now = np.flatnonzero(allowed) if alive is None else alive
        cut = np.partition(score[now], len(now) - size)[len(now) - size]
        now = now[score[now] >= cut]
        top = now[np.lexsort((self.ids[now], -score[now]))[:size]]
        return [(int(score[i]), int(self.ids[i])) for i in top]


def scaled_components(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component as a long; null for vectors that are null or hold null, NaN or infinity."""
    x = F.transform(vector, lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(vector.isNotNull() & ~odd, F.transform(x, lambda c: F.floor(c * scale).cast("long")))


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
          shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each query row: ``query_id``, ``rank``, the row's id, ``score``.

    Rows are dealt by hash to shards of about ``shard`` rows, queries to blocks of about ``block``; a task searches one shard for one block
    with MaxScore, and the shards' short lists are merged. Shards are sent once per block of queries, so the grid's traffic stays small beside
    its arithmetic. Scores are exact 64-bit integers.

    Vectors that are null, or hold null or non-finite components, take no part; nor do rows without an id. A missing component of a shorter vector counts
    as 0. A query is not its own candidate, nor are other rows of its id; repeated rows count each. With fewer than ``k`` candidates all
    are returned.
    """
    vectors = materialise(df.select(F.col(id_col).cast("long").alias("id"), scaled_components(F.col(vector_col), scale).alias("v"), is_query.alias("asks"))
                          .where(F.col("id").isNotNull() & F.col("v").isNotNull()))
    n, asking = vectors.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asking // block))
    every = lambda m, name: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    tie = F.xxhash64("id", "v")
    rows = vectors.select("id", "v", F.pmod(tie, F.lit(shards)).cast("int").alias("shard"), every(blocks, "block"))
    queries = (vectors.where("asks").select("id", "v").distinct()
               .select("id", "v", F.pmod(tie, F.lit(blocks)).cast("int").alias("block"), every(shards, "shard")))

    def search(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(asked) and len(found):
            lists = Postings(found["id"].to_numpy(np.int64), [np.asarray(v, np.int64) for v in found["v"]])
            for q, v in zip(asked["id"], asked["v"]):
                out += [(q, i, s) for s, i in lists.best(np.asarray(v, np.int64), q, k)]
        return pd.DataFrame(out, columns=["query_id", "found_id", "score"]).astype("int64")

    local = (queries.groupBy("block", "shard").cogroup(rows.groupBy("block", "shard"))
             .applyInPandas(search, "query_id bigint, found_id bigint, score bigint"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "found_id"))
    return (local.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias(id_col), "score"))
