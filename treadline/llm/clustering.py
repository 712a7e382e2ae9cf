"""Centroid clustering with ns-bounds: Lloyd's rounds, exact in whole numbers, that skip the distances which bounds rule out.

For each vector and centroid the last distance worked out is kept, with the round of it. The centroids of all rounds are kept as well, so a bound is loosened by
the norm of the centroid's *total* displacement since that round, which is never more than the sum of its moves round by round. A vector stays where it is without
any distance if its loosened upper bound lies below all loosened lower bounds; else its own distance is worked out, and then those to the centroids
whose bounds still fail. Distances are whole numbers, compared exactly; bounds are floating point with a margin, and only ever decide that nothing need be worked out.

Each round is one pass of Spark over the vectors and their bounds, written to the shared folder, from which a lost executor's share can be made again. Centroids move by what the vectors that changed
cluster add and take away, summed per task: a task returns one row per centroid. The driver holds centroids and their history, ``rounds * k`` vectors, and no more.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treadline.llm.common import delete, written

CLUSTERS, ROUNDS, COMPONENTS, SEED, SCALE = 8, 10, 64, 3, 1024
#: Whole components from here on would overflow 64-bit squared distances of 64 components.
TOO_LARGE = 1 << 27
#: Relative error allowed for square roots and their sums, far above that of floating point.
MARGIN = 1e-9


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS) -> DataFrame:
    """``id`` and ``v``, the components as whole numbers, of the rows with as many components, all finite. A component beyond +-2^27 is an error."""
    x = F.col(vector_col)
    usable = (F.size(x) == components) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    floor = lambda c: F.when(F.abs(c.cast("double") * SCALE) < TOO_LARGE, F.floor(c.cast("double") * SCALE)).otherwise(
        F.raise_error(F.lit("a component is too large for exact 64-bit distances")).cast("long"))
    return df.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(x, floor).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of the ``k`` smallest digests of seed and id, equal digests in the order of their components; null ids come last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def squared(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = points - centroid
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """Of each vector its cluster ``near``, and of each centroid the last squared distance ``far`` with its round ``at``; -1 before the first."""

    def __init__(self, near: np.ndarray, far: np.ndarray, at: np.ndarray) -> None:
        self.near, self.far, self.at = near, far, at

    @staticmethod
    def none(n: int, k: int) -> Bounds:
        return Bounds(np.zeros(n, np.int32), np.zeros((n, k), np.int64), np.full((n, k), -1, np.int32))

    def assign(self, points: np.ndarray, centroids: np.ndarray, moved: np.ndarray, now: int) -> int:
        """Put each vector into its nearest cluster, ties to the smaller number; ``moved[t, j]`` is how far centroid j is from where it was in round t. Returns the distances worked out."""
        n, k = self.far.shape
        if not n:
            return 0
        rows, known = np.arange(n), self.at >= 0
        loose = np.sqrt(self.far.astype(float)), np.where(known, moved[np.maximum(self.at, 0), np.arange(k)], np.inf)
        low = np.maximum(loose[0] * (1 - MARGIN) - loose[1] * (1 + MARGIN), 0)
        high = ((loose[0] + loose[1]) * (1 + MARGIN))[rows, self.near]
        low[rows, self.near] = np.inf
        failed = np.flatnonzero((low <= high[:, None]).any(1) | ~known[rows, self.near])
        if not len(failed):
            return 0
        own = self.near[failed]
        least = self._work_out(points, centroids, failed, own, now)
        done, best, bound = len(failed), own.copy(), np.sqrt(least.astype(float)) * (1 + MARGIN)
        for j in range(k):
            ask = np.flatnonzero((low[failed, j] <= bound) & (own != j))
            rows_j = failed[ask]
            d = self._work_out(points, centroids, rows_j, np.full(len(ask), j), now)
            done += len(ask)
            closer = (d < least[ask]) | ((d == least[ask]) & (j < best[ask]))
            least[ask[closer]], best[ask[closer]] = d[closer], j
            bound[ask[closer]] = np.sqrt(d[closer].astype(float)) * (1 + MARGIN)
        self.near[failed] = best
        return done

    def _work_out(self, points: np.ndarray, centroids: np.ndarray, rows: np.ndarray, cluster: np.ndarray, now: int) -> np.ndarray:
        d = squared(points[rows], centroids[cluster])
        self.far[rows, cluster], self.at[rows, cluster] = d, now
        return d


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.reshape(-1)))


_NAMES = ["id", "v", "near", "far", "at", "cluster", "members", "total", "worked"]


def _round(state: DataFrame, history: list[np.ndarray], id_kind: str) -> DataFrame:
    """One assignment. Rows with a ``cluster`` are not vectors but what a task adds to that cluster: ``members``, ``total`` of components, and distances ``worked`` out."""
    now, k, width = len(history) - 1, len(history[-1]), history[-1].shape[1]
    centroids = history[-1]
    moved = np.array([np.sqrt(np.array([int(((a - b).astype(object) ** 2).sum()) for a, b in zip(then, centroids)], float)) for then in history])
    id_type = state.select("id").limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, total, worked = np.zeros(k, np.int64), np.zeros((k, width), np.int64), 0
        none = lambda n: [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())]
        for batch in batches:
            n = batch.num_rows
            points = _matrix(batch.column(1), width, np.int64)
            bounds = Bounds(batch.column(2).to_numpy().copy(), _matrix(batch.column(3), k, np.int64), _matrix(batch.column(4), k, np.int32)) if now else Bounds.none(n, k)
            before = bounds.near.copy()
            worked += bounds.assign(points, centroids, moved, now)
            changed = np.flatnonzero(before != bounds.near) if now else np.arange(n)
            for sign, cluster in ((1, bounds.near), (-1, before)):
                for j in range(k if sign > 0 or now else 0):
                    mine = changed[cluster[changed] == j]
                    members[j] += sign * len(mine)
                    total[j] += sign * points[mine].sum(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bounds.near), _list(bounds.far), _list(bounds.at), *none(n)], names)
        rows = [pa.nulls(k, id_type), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.int32()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*rows, pa.array(np.arange(k, dtype=np.int32)), pa.array(members), _list(total), pa.array([worked] + [0] * (k - 1), pa.int64())], names)

    names = _NAMES
    return state.mapInArrow(run, f"id {id_kind}, v array<bigint>, near int, far array<bigint>, at array<int>, cluster int, members bigint, total array<bigint>, worked bigint")


def _changes(placed: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The sums of the tasks' rows: ``k`` rows reach the driver."""
    total = F.array(*[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)])
    rows = placed.where("cluster IS NOT NULL").groupBy("cluster").agg(F.sum("members").alias("members"), F.sum("worked").alias("worked"), total.alias("total")).collect()
    members, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    for r in rows:
        members[r.cluster], sums[r.cluster] = r.members, r.total
    return members, sums, sum(r.worked for r in rows)


class Fit:
    """The vectors in their clusters after the last assignment, the ``history`` of the centroids, and the distances ``worked`` out in each assignment."""

    def __init__(self, placed: DataFrame, history: list[np.ndarray], worked: list[int]) -> None:
        self.placed, self.history, self.worked = placed, history, worked


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> Fit | None:
    """Lloyd's rounds over ``id`` and ``v``; None without vectors. With fewer vectors than ``k`` each is a centroid."""
    start = first_centroids(vectors, k, seed)
    if not len(start):
        return None
    k, width = start.shape
    id_kind = dict(vectors.dtypes)["id"]
    history, worked = [start], []
    members, sums, state, before = np.zeros(k, np.int64), np.zeros((k, width), np.int64), vectors, None
    for step in range(rounds + 1):
        placed, path = written(_round(state, history, id_kind))
        more, added, n = _changes(placed, k, width)
        members, sums = members + more, sums + added
        worked.append(n)
        if before:
            delete(vectors.sparkSession, before)
        before = path
        state = placed.where("cluster IS NULL").select(*_NAMES[:5])
        if step < rounds:
            # Floor division of whole numbers; an empty cluster keeps its centroid.
            history.append(np.where(members[:, None] > 0, sums // np.maximum(members, 1)[:, None], history[-1]))
    return Fit(state, history, worked)


def clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, seed: int = SEED) -> DataFrame:
    """One row per vector kept: id, ``cluster``, squared ``distance`` to its centroid, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Vectors that are null, of another length, or hold null or non-finite components are left out. Ties of distance go to the smaller cluster. Rows of one id are vectors of their own, null ids
    are clustered but the last to start a cluster, an empty table gives no rows, and only id and vector are read, whatever the other columns are called.
    """
    id_kind = dict(df.dtypes)[id_col]
    found = fit(whole_vectors(df, id_col, vector_col, components), k, rounds, seed)
    if found is None:
        return df.sparkSession.createDataFrame([], f"`{id_col}` {id_kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    last = found.history[-1]
    centres = [(j, [int(x) for x in c], hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(last)]
    # A row per centroid, so its size is that of the parameter k.
    centre = F.broadcast(df.sparkSession.createDataFrame(centres, "cluster int, centre array<bigint>, centroid_sha256 string"))
    square = F.aggregate(F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    apart, _ = written(found.placed.withColumnRenamed("near", "cluster").join(centre, "cluster").select("id", "cluster", square.alias("distance"), "centroid_sha256"))
    sums = {r.cluster: r.inertia for r in apart.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("inertia")).collect()}
    own = reduce(lambda acc, j: acc.when(F.col("cluster") == j, F.lit(sums[j]).cast("long")), sorted(sums), F)
    return apart.select(F.col("id").alias(id_col), "cluster", "distance", own.alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256")
