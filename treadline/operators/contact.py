"""From keypoints to contact signals, and from contact signals to runs.

A contact table has one row per frame of a channel: ``keys, frame, in_stance`` (0/1) plus optional measurements.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treadline.functions.geometry import distance
from treadline.operators import ordered
from treadline.operators.ordered import CHUNK


def fill_gaps(df: DataFrame, keys: Sequence[str], values: Sequence[str], frame: str = "frame",
              size: int = CHUNK) -> DataFrame:
    """Linear interpolation of missing values; ends hold the nearest value; a channel without any value becomes 0."""
    return ordered.interpolated(df, keys, values, frame, size)


def trend_contact(df: DataFrame, keys: Sequence[str], x: str = "x", frame: str = "frame",
                  size: int = CHUNK) -> DataFrame:
    """Treadmill rule: a frame is in stance when the next position lies behind it; the last frame is swing."""
    d = ordered.over_halo(df, keys, {"_nx": lambda w: F.lead(x).over(w)}, frame, after=1, size=size)
    return d.withColumn("in_stance", F.coalesce((F.col("_nx") < F.col(x)).cast("int"), F.lit(0))).drop("_nx")


def displacement_contact(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", bias: float = 1.0,
                         frame: str = "frame", size: int = CHUNK) -> DataFrame:
    """Free-run rule: in stance when the step since the previous frame is shorter than the mean step times ``bias``."""
    w = ordered.chunk_window(keys, frame)
    # The step is found and summed in the same chunks, so the rows are shuffled once.
    d = ordered.halo(df, frame, before=1, size=size)
    d = d.withColumn("_d", distance(F.col(x), F.col(y), F.lag(x).over(w), F.lag(y).over(w))).where(~F.col("_halo")).drop("_halo")
    total = lambda n: lambda up, _: F.sum(n).over(up.rowsBetween(ordered.Window.unboundedPreceding, ordered.Window.unboundedFollowing))
    d = ordered.carry(d, keys, {"_s": F.sum("_d"), "_k": F.count("_d")}, {"_sum": total("_s"), "_n": total("_k")})
    short = F.col("_d") < F.try_divide(F.col("_sum"), F.col("_n")) * bias
    return d.withColumn("in_stance", F.coalesce(short.cast("int"), F.lit(0))).drop("_d", "_sum", "_n", "_chunk")


def contact_runs(df: DataFrame, keys: Sequence[str], value: str = "in_stance", frame: str = "frame",
                 aggs: Mapping[str, tuple[str, Column]] | None = None, size: int = CHUNK) -> DataFrame:
    """Maximal runs of one value: ``start``, ``end`` (exclusive), value, ``n_rows`` and any per-run aggregates."""
    return ordered.islands(df, keys, frame, value=value, aggs=aggs, size=size)


def stored_runs(df: DataFrame, keys: Sequence[str], value: str = "in_stance", frame: str = "frame",
                aggs: Mapping[str, tuple[str, Column]] | None = None, size: int = CHUNK) -> DataFrame:
    """:func:`contact_runs`, written to the shared folder.

    For operators that compare runs with their neighbours, which read the runs twice. A runs table is a small fraction of
    the frames it stands for, so writing it costs far less than shuffling and scanning the frames again.
    """
    return ordered.islands(df, keys, frame, value=value, aggs=aggs, size=size, stored=True).drop("n_rows")


def stance_segments(df: DataFrame, keys: Sequence[str], value: str = "in_stance", frame: str = "frame",
                    size: int = CHUNK) -> DataFrame:
    """Stance bouts as ``[start, end)``; only the frames in stance are shuffled. Channels of one frame give none."""
    many = ordered.with_totals(df, keys, {"_n": ("sum", F.lit(1))}, frame, size).where("_n >= 2")
    return ordered.islands(many.where(F.col(value) == 1), keys, frame, size=size).drop("n_rows")


def onsets(df: DataFrame, keys: Sequence[str], values: Sequence[str] = ("in_stance",), frame: str = "frame",
           size: int = CHUNK) -> DataFrame:
    """Add ``<value>_on``: 1 on frames that enter stance (a channel starts from swing)."""
    return ordered.over_halo(
        df, keys,
        {f"{v}_on": (lambda w, v=v: ((F.col(v) == 1) & (F.coalesce(F.lag(v).over(w), F.lit(0)) == 0)).cast("int"))
         for v in values}, frame, before=1, size=size)


def correct_runs(runs: DataFrame, keys: Sequence[str], value: str = "in_stance", size: int = CHUNK) -> DataFrame:
    """Flip short spurious runs between two longer runs of the other value.

    A run is short when it has at most ``ceil(mean run length / 4)`` frames. Only interior runs of channels with three
    or more runs are looked at, once, on the original lengths. Adds ``corrected`` and ``opens`` (the corrected value
    differs from the corrected value before it).
    """
    length = F.col("end") - F.col("start")
    d = runs.withColumn("_len", length)
    d = ordered.neighbours(d, keys, "start", {
        "_l2": ("_len", -2), "_v2": (value, -2), "_l1": ("_len", -1), "_v1": (value, -1),
        "_r1": ("_len", 1), "_w1": (value, 1)}, size,
        totals={"_n": ("sum", F.col("_len")), "_k": ("sum", F.lit(1))})
    thr = F.ceil(F.col("_n") / F.col("_k") / 4.0)

    def flips(left, mid, right, lv, rv):
        return F.coalesce((F.col("_k") >= 3) & (F.col(mid) <= thr) & (F.col(left) > thr) & (F.col(right) > thr)
                          & (F.col(lv) == F.col(rv)), F.lit(False))

    here = F.when(flips("_l1", "_len", "_r1", "_v1", "_w1"), F.col("_v1")).otherwise(F.col(value))
    before = F.when(flips("_l2", "_l1", "_len", "_v2", value), F.col("_v2")).otherwise(F.col("_v1"))
    d = d.withColumns({"corrected": here, "opens": ~here.eqNullSafe(before)})
    return d.drop("_len", "_n", "_k", "_l2", "_v2", "_l1", "_v1", "_r1", "_w1")


def auto_correct(df: DataFrame, keys: Sequence[str], value: str = "in_stance", frame: str = "frame",
                 size: int = CHUNK) -> DataFrame:
    """Frame-level :func:`correct_runs`: ``keys, frame`` and the corrected value."""
    return corrected_frames(correct_runs(stored_runs(df, keys, value, frame, size=size), keys, value, size), keys, value, frame, size)


def corrected_frames(runs: DataFrame, keys: Sequence[str], value: str = "in_stance", frame: str = "frame", size: int = CHUNK) -> DataFrame:
    """The frames of corrected runs: ``keys, frame`` and the corrected value."""
    frames = ordered.expand(runs.select(*keys, "start", "end", F.col("corrected").alias(value)), name=frame, size=size)
    return frames.select(*keys, frame, value)


def contact_spine(detected: DataFrame, trials: DataFrame, limbs: Sequence[str], size: int = CHUNK) -> DataFrame:
    """Dense contact table: every frame of every limb, 0 where nothing in stance was detected.

    ``detected`` has ``trial_id, limb, frame, is_in_stance``; ``trials`` has ``trial_id, n_frames``.
    """
    spine = ordered.expand(trials.select("trial_id", F.lit(0).alias("start"), F.col("n_frames").alias("end")), size=size)
    spine = spine.withColumn("limb", F.explode(F.array(*[F.lit(x) for x in limbs])))
    hits = detected.where("is_in_stance").select("trial_id", "limb", "frame").distinct().withColumn("_hit", F.lit(1))
    return (spine.join(hits, ["trial_id", "limb", "frame"], "left")
            .select("trial_id", "limb", "frame", F.coalesce("_hit", F.lit(0)).alias("in_stance")))


def apply_edits(df: DataFrame, edits: DataFrame, keys: Sequence[str], value: str = "in_stance",
                frame: str = "frame") -> DataFrame:
    """Flip the frames listed in ``edits`` (an odd number of edits flips) and mark them ``edited``."""
    flips = edits.groupBy(*keys, frame).agg((F.count(F.lit(1)) % 2).cast("int").alias("_flip"))
    d = df.join(flips, [*keys, frame], "left")
    return (d.withColumn(value, F.col(value).bitwiseXOR(F.coalesce("_flip", F.lit(0))))
            .withColumn("edited", F.col("_flip").isNotNull()).drop("_flip"))


def active_bounds(df: DataFrame, keys: Sequence[str], active: Column, frame: str = "frame") -> DataFrame:
    """First and last (exclusive) frame with any contact; (0, 0) for a recording without contact."""
    hit = F.when(active, F.col(frame))
    return df.groupBy(*keys).agg(F.coalesce(F.min(hit), F.lit(0)).alias("start"),
                                 F.coalesce(F.max(hit) + 1, F.lit(0)).alias("end"))


def traversals(df: DataFrame, keys: Sequence[str], active: Column, frame: str = "frame", min_frames: int = 20,
               empty_frames: int = 30, size: int = CHUNK) -> DataFrame:
    """Traversals of the walkway: contact separated by fewer than ``empty_frames`` empty frames, long enough.

    ``start`` is the first and ``end`` the last frame with contact, both counted from 1. A traversal still open when
    the recording ends is closed there, so its ``end`` is the last frame of the recording.
    """
    d = df.select(*keys, frame, active.alias("_active"))
    n = d.groupBy(*keys).agg((F.max(frame) + 1).alias("_n"))
    isl = ordered.islands(d.where("_active"), keys, frame, gap=empty_frames, size=size)
    isl = isl.join(n, list(keys))
    open_end = F.col("_n") - F.col("end") < empty_frames
    end = F.when(open_end, F.col("_n")).otherwise(F.col("end"))
    return (isl.select(*keys, (F.col("start") + 1).alias("start"), end.cast("int").alias("end"),
                       open_end.alias("flushed"))
            .where(F.col("end") - F.col("start") >= min_frames))


def frames_of_traversals(df: DataFrame, runs: DataFrame, trial: str = "trial_id", frame: str = "frame",
                         size: int = CHUNK) -> DataFrame:
    """Contact rows of each traversal, as a trial of its own (``<trial>#<start>``) with frames counted from its start.

    Traversals do not overlap, so every frame belongs to at most one: an equi-join on (trial, frame).
    """
    covered = ordered.expand(runs.select(trial, F.col("start").alias("_s"), (F.col("start") - 1).alias("_a"), F.col("end").alias("_b")),
                             "_a", "_b", frame, size).select(trial, "_s", frame)
    d = df.join(covered, [trial, frame])
    return (d.withColumn(frame, (F.col(frame) + 1 - F.col("_s")).cast("int"))
            .withColumn(trial, F.concat_ws("#", F.col(trial).cast("string"), F.col("_s").cast("string"))).drop("_s"))
