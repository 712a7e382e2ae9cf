"""Camera timing: aligned sets of frames from several roles, their drift, and pulse liveness."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treadline.operators import ordered
from treadline.operators.ordered import CHUNK

# Fixed value: tolerated deviation from the median timestamp of a set.
SYNC_TOLERANCE_MS = 1.0


def twice_median(t: Column) -> Column:
    """Twice the median of a sorted array of whole numbers: exact, where nanoseconds since the epoch exceed a double."""
    n = F.size(t)
    return F.get(t, F.floor((n - 1) / 2).cast("int")) + F.get(t, F.floor(n / 2).cast("int"))


def role_sets(frames: DataFrame, keys: Sequence[str] = ("frame_number",), n_roles: int = 4) -> DataFrame:
    """Frames of all roles with one number: per-role deviation from the median timestamp, and the worst one, in ms.

    A role contributes its latest timestamp. Sets with fewer than ``n_roles`` roles are incomplete and dropped.
    """
    one = frames.groupBy(*keys, "role").agg(F.max("timestamp_ns").alias("t"))
    g = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_roles"), twice_median(F.array_sort(F.collect_list("t"))).alias("_m"),
                               F.collect_list(F.struct("role", "t")).alias("_r")).where(F.col("n_roles") >= n_roles)
    delta = F.map_from_entries(F.transform("_r", lambda r: F.struct(r["role"], (2 * r["t"] - F.col("_m")) / 2e6)))
    worst = F.array_max(F.transform("_r", lambda r: F.abs(2 * r["t"] - F.col("_m")) / 2e6))
    return g.select(*keys, "n_roles", delta.alias("delta_ms"), worst.alias("worst_ms"))


def sync_report(sets: DataFrame, tolerance_ms: float = SYNC_TOLERANCE_MS, last_sets: int | None = None,
                frame: str = "frame_number") -> DataFrame:
    """Worst deviation of all sets, or of the last ``last_sets`` where a number is given; without any set: not in sync,
    infinite. ``worst_deltas_ms`` has the absolute deviation of each role in the worst set, the earliest of equals."""
    d = sets if last_sets is None else sets.orderBy(F.desc(frame)).limit(last_sets)
    worst = F.struct(F.col("worst_ms"), -F.col(frame))
    return d.agg(F.count(F.lit(1)).alias("n_sets"), F.coalesce(F.max("worst_ms"), F.lit(float("inf"))).alias("worst_ms"),
                 F.max_by(frame, worst).alias("worst_frame"),
                 F.max_by(F.transform_values("delta_ms", lambda _, v: F.abs(v)), worst).alias("worst_deltas_ms"),
                 F.coalesce(F.max("worst_ms") <= tolerance_ms, F.lit(False)).alias("in_sync"))


def pulse_gaps(pulses: DataFrame, keys: Sequence[str], ts: str, hz: float, frame: str = "frame",
               size: int = CHUNK) -> DataFrame:
    """Pulses that came more than two periods after the one before."""
    d = ordered.over_halo(pulses, keys, {"_p": lambda w: F.lag(ts).over(w)}, frame, before=1, size=size)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_p").cast("timestamp"))) / 1e6
    return d.withColumn("gap_s", gap).where(F.col("gap_s") > 2.0 / float(hz)).drop("_p")
