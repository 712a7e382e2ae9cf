"""Timing, stride and body metrics per channel. ``keys`` is usually ``["trial_id", "limb"]``."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treadline.functions import geometry as geo
from treadline.functions import metrics as fm
from treadline.operators import contact, ordered
from treadline.operators.ordered import CHUNK


def _basics(per_key: DataFrame, keys: Sequence[str], fps: float) -> DataFrame:
    """Timing from ``_k`` stance runs, ``_stance`` stance frames, ``_first``, ``_last`` and ``_last_on`` frames."""
    strides = F.greatest(F.col("_k") - 1, F.lit(0)).cast("int")
    swing = F.col("_last") - F.col("_first") + 1 - F.col("_stance")
    paired = F.col("_last_on") - F.col("_first")

    def per_stride(frames: Column) -> Column:
        return F.coalesce(F.try_divide(frames, strides) * 1000.0 / float(fps), F.lit(0.0))

    return per_key.select(
        *keys, strides.alias("n_strides"), per_stride(F.col("_stance")).alias("stance_ms"),
        per_stride(swing).alias("swing_ms"),
        F.when(strides > 0, F.try_divide(strides, paired / float(fps))).otherwise(0.0).alias("stride_hz"))


def gait_basics(df: DataFrame, keys: Sequence[str], fps: float, value: str = "in_stance", frame: str = "frame",
                size: int = CHUNK) -> DataFrame:
    """Strides, mean stance and swing time per stride, stride frequency.

    The signal is trimmed to its first..last stance frame. Stance and swing frames of the whole trimmed signal are
    divided by the number of strides (stance runs - 1); the frequency counts only complete stance + swing pairs, which
    span the first to the last stance onset.
    """
    d = contact.onsets(df.select(*keys, frame, value), keys, (value,), frame, size)
    on, st = F.col(f"{value}_on") == 1, F.col(value) == 1
    g = d.groupBy(*keys).agg(
        F.sum(f"{value}_on").alias("_k"), F.sum(value).alias("_stance"),
        F.min(F.when(st, F.col(frame))).alias("_first"), F.max(F.when(st, F.col(frame))).alias("_last"),
        F.max(F.when(on, F.col(frame))).alias("_last_on"))
    return _basics(g, keys, fps)


def gait_basics_of_runs(runs: DataFrame, keys: Sequence[str], fps: float) -> DataFrame:
    """:func:`gait_basics` from runs with ``corrected`` and ``opens`` (see ``contact.correct_runs``)."""
    st = F.col("corrected") == 1
    g = runs.groupBy(*keys).agg(
        F.sum((st & F.col("opens")).cast("int")).alias("_k"),
        F.sum(F.when(st, F.col("end") - F.col("start")).otherwise(0)).alias("_stance"),
        F.min(F.when(st, F.col("start"))).alias("_first"), (F.max(F.when(st, F.col("end"))) - 1).alias("_last"),
        F.max(F.when(st & F.col("opens"), F.col("start"))).alias("_last_on"))
    return _basics(g, keys, fps)


def stride_table(df: DataFrame, keys: Sequence[str], fps: float, value: str = "in_stance", frame: str = "frame",
                 size: int = CHUNK) -> DataFrame:
    """Complete strides: each stance run with the swing run after it, if another stance follows."""
    runs = contact.stored_runs(df, keys, value, frame, size=size)
    d = ordered.neighbours(runs, keys, "start", {"_e1": ("end", 1), "_s2": ("start", 2)}, size)
    d = d.where((F.col(value) == 1) & F.col("_s2").isNotNull())
    return d.select(*keys, "start", (F.col("end") - F.col("start")).alias("stance_frames"),
                    (F.col("_s2") - F.col("end")).alias("swing_frames"),
                    ((F.col("_s2") - F.col("start")) / float(fps)).alias("stride_s"))


def stride_lengths(df: DataFrame, keys: Sequence[str], fps: float, x: str = "x", y: str = "y",
                   belt_speed: float | None = None, mm_per_px: float = 1.0, value: str = "in_stance",
                   frame: str = "frame", size: int = CHUNK) -> DataFrame:
    """Strides as ``[start, end)`` with their length.

    Free run: distance between the positions at both ends; treadmill: belt speed times duration. A signal that starts in
    stance is cut touchdown to touchdown. One that starts in swing gives its first stance run as first stride and then
    lift-off to lift-off. A stride that ends past the recording is skipped, and so is a channel with one stance run.
    """
    runs = contact.stored_runs(df, keys, value, frame, {"x": ("start", F.col(x)), "y": ("start", F.col(y))}, size)
    return strides_of_runs(runs, keys, fps, belt_speed, mm_per_px, value, size)


def strides_of_runs(runs: DataFrame, keys: Sequence[str], fps: float, belt_speed: float | None = None, mm_per_px: float = 1.0,
                    value: str = "in_stance", size: int = CHUNK) -> DataFrame:
    """:func:`stride_lengths` from maximal runs with the position ``x, y`` on their first frame."""
    runs = runs.withColumn("_pos", F.struct(F.col("start").alias("f"), "x", "y"))
    st = F.col(value) == 1
    d = ordered.neighbours(runs, keys, "start", {
        "_p0": ("_pos", -1), "_p1": ("_pos", 1), "_p2": ("_pos", 2)}, size,
        totals={"_k": ("sum", st.cast("int")), "_first": ("min", F.when(st, F.col("start")))})
    from_stance = F.col("_first") == 0
    # The swing run before a stance run starts at the previous lift-off; before the first stance run there is none.
    begin = F.when(from_stance | (F.col("start") == F.col("_first")), F.col("_pos")).otherwise(F.col("_p0"))
    finish = F.when(from_stance, F.col("_p2")).otherwise(F.col("_p1"))
    d = d.where(st & (F.col("_k") >= 2)).withColumns({"_b": begin, "_f": finish}).where("_f is not null")
    if belt_speed is None:
        length = geo.distance(F.col("_b.x"), F.col("_b.y"), F.col("_f.x"), F.col("_f.y")) * float(mm_per_px)
    else:
        length = F.lit(float(belt_speed)) * ((F.col("_f.f") - F.col("_b.f")) / float(fps))
    return d.select(*keys, F.col("_b.f").alias("start"), F.col("_f.f").alias("end"), length.alias("stride_length"))


def stride_summary(strides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frame-weighted mean of non-zero stride lengths and their sample deviation per stride."""
    n = F.col("end") - F.col("start")
    hit = F.col("stride_length") > 0
    return strides.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum(F.when(hit, F.col("stride_length") * n)), F.sum(F.when(hit, n))), F.lit(0.0))
        .alias("stride_length_mean"),
        F.coalesce(F.stddev_samp("stride_length"), F.lit(0.0)).alias("stride_length_variability"),
        F.count(F.lit(1)).alias("n_lengths"))


def stride_length_frames(df: DataFrame, strides: DataFrame, keys: Sequence[str], frame: str = "frame",
                         size: int = CHUNK) -> DataFrame:
    """Stride length on every frame, 0 outside strides."""
    covered = ordered.expand(strides.select(*keys, "start", "end", "stride_length"), name=frame, size=size)
    return (df.select(*keys, frame).join(covered.select(*keys, frame, "stride_length"), [*keys, frame], "left")
            .withColumn("stride_length", F.coalesce("stride_length", F.lit(0.0))))


def sem(values: Column) -> Column:
    """Aggregate: standard error of the mean, 0 below two values."""
    return F.coalesce(F.stddev_samp(values) / F.sqrt(F.count(values)), F.lit(0.0))


def variability(values: Column) -> Column:
    """Aggregate: sample standard deviation, 0 below two values."""
    return F.coalesce(F.stddev_samp(values), F.lit(0.0))


def stance_angle(df: DataFrame, keys: Sequence[str], angle: Column, value: str = "in_stance") -> DataFrame:
    """Mean angle over stance frames only; 0 for a channel never in stance."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(F.col(value) == 1, angle)), F.lit(0.0)).alias("angle_mean_deg"))


def body_speed(df: DataFrame, keys: Sequence[str], x: str, fps: float, mm_per_px: float = 1.0,
               frame: str = "frame") -> DataFrame:
    """Signed travel speed from the first and last position."""
    dist = (F.max_by(x, frame) - F.min_by(x, frame)) * float(mm_per_px)
    dur = (F.count(F.lit(1)) - 1) / float(fps)
    return df.groupBy(*keys).agg(F.coalesce(F.try_divide(dist, dur), F.lit(0.0)).alias("body_speed_mm_s"))


def limb_drift_speed(df: DataFrame, trial: Sequence[str], limb: str, x: str, fps: float, px_per_mm: float = 1.0,
                     frame: str = "frame") -> DataFrame:
    """Median over limbs of |last - first| positive position per second of recording."""
    seen = F.when(F.col(x) > 0, F.col(frame))
    g = df.groupBy(*trial, limb).agg(
        F.count(F.lit(1)).alias("_n"), F.count(seen).alias("_m"),
        F.max_by(x, seen).alias("_b"), F.min_by(x, seen).alias("_a"))
    speed = F.when((F.col("_m") >= 2) & (F.col("_n") >= 2),
                   F.abs(F.col("_b") - F.col("_a")) / float(px_per_mm) / ((F.col("_n") - 1) / max(float(fps), 1.0)))
    return g.groupBy(*trial).agg(F.coalesce(F.median(speed), F.lit(0.0)).alias("body_speed_mm_s"))


def mean_angle(df: DataFrame, keys: Sequence[str], dy: Column, dx: Column, name: str = "body_axis_angle_deg") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.degrees(F.atan2(dy, dx))).alias(name))


def pair_widths(df: DataFrame, keys: Sequence[str], left: Column, right: Column, mm_per_px: float = 1.0,
                name: str = "width") -> DataFrame:
    """Mean absolute difference of two limbs' coordinates on the frames both have."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.avg(F.abs(left - right) * float(mm_per_px)), F.lit(0.0)).alias(name))


def intensity_summary(df: DataFrame, trial: Sequence[str], limb: str = "limb", value: str = "intensity",
                      area: str | None = None) -> DataFrame:
    """Stand index (sum), mean of the limb means, maximum, fore asymmetry and the largest contact area."""
    g = df.groupBy(*trial, limb).agg(F.sum(value).alias("_s"), F.avg(value).alias("_m"), F.max(value).alias("_x"),
                                     *([F.max(area).alias("_a")] if area else []))
    side = lambda n: F.coalesce(F.sum(F.when(F.col(limb) == n, F.col("_s"))), F.lit(0.0))
    return g.groupBy(*trial).agg(
        F.sum("_s").alias("stand_index"), F.avg("_m").alias("mean_intensity"), F.max("_x").alias("max_intensity"),
        fm.intensity_asymmetry(side("LF"), side("RF")).alias("intensity_asymmetry_lf_rf"),
        *([F.max("_a").alias("max_contact_area_px")] if area else []))


def trial_symmetry(basics: DataFrame, trial: Sequence[str], limb: str = "limb") -> DataFrame:
    """Mean of the fore and hind left/right symmetry scores over the pairs that are present."""
    v = lambda n, c: F.max(F.when(F.col(limb) == n, F.col(c)))
    g = basics.groupBy(*trial).agg(*[v(n, c).alias(f"_{n}_{c}") for n in ("LF", "RF", "LH", "RH")
                                     for c in ("stance_ms", "swing_ms")])
    pair = lambda a, b: fm.gait_symmetry(
        F.col(f"_{a}_stance_ms"), F.col(f"_{b}_stance_ms"), F.col(f"_{a}_swing_ms"), F.col(f"_{b}_swing_ms"))
    has = lambda a, b: F.col(f"_{a}_stance_ms").isNotNull() & F.col(f"_{b}_stance_ms").isNotNull()
    scores = F.array_compact(F.array(F.when(has("LF", "RF"), pair("LF", "RF")), F.when(has("LH", "RH"), pair("LH", "RH"))))
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return g.select(*trial, F.when(F.size(scores) > 0, mean).otherwise(0.0).alias("gait_symmetry"))
