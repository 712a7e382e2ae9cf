"""Per-step and per-limb contact metrics. A step is one stance bout of one limb. Values are left unrounded."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treadline.operators import contact, ordered
from treadline.operators.ordered import CHUNK


def _positive_mean(c: str) -> Column:
    return F.coalesce(F.avg(F.when(F.col("_stance") & (F.col(c) > 0), F.col(c))), F.lit(0.0))


def _stance_mean(c: str) -> Column:
    return F.coalesce(F.avg(F.when(F.col("_stance"), F.col(c))), F.lit(0.0))


def bouts(df: DataFrame, keys: Sequence[str], fps: float, px_per_mm: float = 1.0, value: str = "in_stance",
          x: str = "cx", intensity: str = "intensity", area: str | None = "area_px", frame: str = "frame",
          size: int = CHUNK) -> DataFrame:
    """All runs of a contact signal with the step measures; ``_stance`` marks the stance bouts.

    Stride length runs to the next touchdown, swing to it from lift-off; the last bout has neither. A bout that touches
    the last frame of the recording has no pressure measures. Braking is the part before the first pressure peak.
    ``area=None`` leaves the contact area out, which only :func:`limb_aggregates` needs.
    """
    fps, rate = float(fps), max(float(fps), 1.0)
    i, f = F.col(intensity), F.col(frame)
    areas = {"_amax": ("max", F.col(area)), "_asum": ("sum", F.col(area))} if area else {}
    runs = contact.stored_runs(df, keys, value, frame, {
        "_x": ("min", F.struct(f.alias("f"), F.col(x).alias("x"))), "_imax": ("max", i), "_isum": ("sum", i),
        "_peak": ("max", F.struct(i.alias("v"), (-f).alias("f"))), **areas}, size)
    d = ordered.neighbours(runs, keys, "start", {
        "_next": ("start", 1), "_td": ("start", 2), "_tx": ("_x", 2)}, size)
    n = F.col("end") - F.col("start")
    zero = F.lit(0.0)
    inside = F.col("_next").isNotNull()
    d = d.withColumns({
        "_stance": F.col(value) == 1, "stance_frames": n, "stand_s": n / rate,
        "stride_length_mm": F.coalesce(F.abs(F.col("_tx.x") - F.col("_x.x")) / float(px_per_mm), zero),
        "swing_frames": F.coalesce(F.col("_td") - F.col("end"), F.lit(0)),
        "max_intensity": F.when(inside, F.col("_imax")).otherwise(zero),
        "mean_intensity": F.when(inside, F.col("_isum") / n).otherwise(zero),
        "area_under_curve": F.when(inside, F.col("_isum") / fps).otherwise(zero),
        "braking_s": F.when(inside, (-F.col("_peak.f") - F.col("start")) / rate).otherwise(zero),
        "propulsion_s": F.when(inside, (F.col("end") - 1 + F.col("_peak.f")) / rate).otherwise(zero),
    })
    d = d.withColumn("swing_s", F.col("swing_frames") / rate)
    d = d.withColumn("step_cycle_s", F.col("stand_s") + F.col("swing_s"))
    both = F.col("braking_s") + F.col("propulsion_s")
    d = d.withColumns({
        "swing_speed_mm_s": F.coalesce(F.when(F.col("swing_s") > 0, F.try_divide("stride_length_mm", "swing_s")), zero),
        "speed_mm_s": F.coalesce(F.when(F.col("step_cycle_s") > 0, F.try_divide("stride_length_mm", "step_cycle_s")), zero),
        "braking_index": F.when(both > 0, F.try_divide("braking_s", both)).otherwise(zero),
        "propulsion_index": F.when(both > 0, F.try_divide("propulsion_s", both)).otherwise(zero),
    })
    return d.drop("_x", "_tx", "_td", "_next", "_peak", "_imax", "_isum")


STEP_COLUMNS = ("start", "end", "stance_frames", "stand_s", "stride_length_mm", "swing_frames", "swing_s",
                "step_cycle_s", "swing_speed_mm_s", "speed_mm_s", "max_intensity", "mean_intensity",
                "area_under_curve", "braking_s", "propulsion_s", "braking_index", "propulsion_index")


def step_metrics(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stance bouts of :func:`bouts`."""
    return runs.where("_stance").select(*keys, *STEP_COLUMNS)


def step_pressure(df: DataFrame, keys: Sequence[str], fps: float, px_per_mm: float = 1.0, value: str = "in_stance",
                  intensity: str = "intensity", area: str = "area_px", frame: str = "frame",
                  size: int = CHUNK) -> DataFrame:
    """Pressure of every stance bout: largest contact area, print area (area over time) and stand index."""
    d = ordered.islands(df.where(F.col(value) == 1), keys, frame, aggs={
        "max_intensity": ("max", F.col(intensity)), "_is": ("sum", F.col(intensity)),
        "_am": ("max", F.col(area)), "_as": ("sum", F.col(area))}, size=size)
    n, rate, mm2 = F.col("n_rows"), max(float(fps), 1.0), float(px_per_mm) ** 2
    d = d.withColumns({
        "stance_frames": n, "stand_s": n / rate, "mean_intensity": F.col("_is") / n,
        "max_contact_area_cm2": F.col("_am") / mm2 / 100.0,
        "print_area_cm2": F.col("_as") / float(fps) / mm2 / 100.0})
    d = d.withColumn("stand_index", F.col("mean_intensity") * F.col("print_area_cm2") * F.col("stand_s"))
    return d.drop("_is", "_am", "_as", "n_rows")


def limb_pressure(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-limb pressure; the intensity at the largest contact is the highest among the bouts that reach it."""
    top = F.max(F.struct("max_contact_area_cm2", "max_intensity"))
    return steps.groupBy(*keys).agg(
        F.max("max_contact_area_cm2").alias("max_contact_area_cm2"), F.sum("print_area_cm2").alias("print_area_cm2"),
        F.avg("mean_intensity").alias("mean_intensity"), F.max("max_intensity").alias("max_intensity"),
        top.getField("max_intensity").alias("max_contact_max_intensity"),
        F.avg("stand_index").alias("avg_stand_index"), F.sum("stand_index").alias("total_stand_index"))


# The names of the metrics.
LIMB_METRICS = (
    "max_contact_area_cm2", "avg_contact_area_cm2", "total_contact_s", "max_contact_s", "contact_time_pct",
    "step_cycle_s", "stride_length_cm", "step_length_cm", "avg_stance_s", "avg_swing_s", "duty_cycle_pct", "swing_phase_pct",
    "avg_braking_s", "avg_propulsion_s", "braking_index", "propulsion_index", "avg_swing_speed_cm_s",
    "avg_instantaneous_speed_cm_s", "total_speed_cm_s", "peak_swing_speed_cm_s", "max_intensity", "avg_max_intensity", "total_auc",
    "n_steps")


def limb_aggregates(runs: DataFrame, keys: Sequence[str], fps: float, px_per_mm: float = 1.0,
                    min_frames: int = 3) -> DataFrame:
    """Per-limb contact metrics from :func:`bouts`. Means of times, lengths and speeds use positive values only.
    A channel shorter than ``min_frames`` or without a step is all zero."""
    st = F.col("_stance")
    mm2, rate = float(px_per_mm) ** 2, max(float(fps), 1.0)
    g = runs.groupBy(*keys).agg(
        F.max("end").alias("_n"), F.sum(st.cast("int")).cast("int").alias("n_steps"),
        (F.coalesce(F.max(F.when(st, F.col("_amax"))), F.lit(0.0)) / mm2 / 100.0).alias("max_contact_area_cm2"),
        (F.coalesce(F.try_divide(F.sum(F.when(st, F.col("_asum"))), F.sum(F.when(st, F.col("stance_frames")))),
                    F.lit(0.0)) / mm2 / 100.0).alias("avg_contact_area_cm2"),
        (F.coalesce(F.sum(F.when(st, F.col("stance_frames"))), F.lit(0)) / rate).alias("total_contact_s"),
        F.coalesce(F.max(F.when(st, F.col("stand_s"))), F.lit(0.0)).alias("max_contact_s"),
        _positive_mean("step_cycle_s").alias("step_cycle_s"),
        (_positive_mean("stride_length_mm") / 10.0).alias("stride_length_cm"),
        # For one limb a step is as long as a stride.
        (_positive_mean("stride_length_mm") / 10.0).alias("step_length_cm"),
        _stance_mean("stand_s").alias("avg_stance_s"), _positive_mean("swing_s").alias("avg_swing_s"),
        _stance_mean("braking_s").alias("avg_braking_s"), _stance_mean("propulsion_s").alias("avg_propulsion_s"),
        _stance_mean("braking_index").alias("braking_index"),
        _stance_mean("propulsion_index").alias("propulsion_index"),
        (_positive_mean("swing_speed_mm_s") / 10.0).alias("avg_swing_speed_cm_s"),
        (_positive_mean("speed_mm_s") / 10.0).alias("avg_instantaneous_speed_cm_s"),
        (F.coalesce(F.sum(F.when(st, F.col("stride_length_mm"))), F.lit(0.0)) / 10.0).alias("_stride_cm"),
        (F.coalesce(F.max(F.when(st, F.col("swing_speed_mm_s"))), F.lit(0.0)) / 10.0).alias("peak_swing_speed_cm_s"),
        F.coalesce(F.max(F.when(st, F.col("max_intensity"))), F.lit(0.0)).alias("max_intensity"),
        _positive_mean("max_intensity").alias("avg_max_intensity"),
        F.coalesce(F.sum(F.when(st, F.col("area_under_curve"))), F.lit(0.0)).alias("total_auc"))
    total = F.col("_n") / rate
    pct = lambda a: F.coalesce(F.try_divide(F.col(a) * 100.0, F.col("step_cycle_s")), F.lit(0.0))
    g = g.withColumns({
        "contact_time_pct": F.col("total_contact_s") * 100.0 / total, "total_speed_cm_s": F.col("_stride_cm") / total,
        "duty_cycle_pct": pct("avg_stance_s"), "swing_phase_pct": pct("avg_swing_s")})
    long_enough = F.col("_n") >= min_frames
    return g.select(*keys, *[F.when(long_enough, F.col(c)).otherwise(F.lit(0).cast(dict(g.dtypes)[c])).alias(c)
                             for c in LIMB_METRICS])


def number_steps(steps: DataFrame, keys: Sequence[str], size: int = CHUNK) -> DataFrame:
    """Step ordinal per limb, counted from 1 in order of touchdown."""
    return ordered.number_rows(steps, keys, ["start"], F.floor(F.col("start") / size), name="step_num", start=1)
