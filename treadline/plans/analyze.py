"""End-to-end plans: keypoints to gait results, contact tables to the full metric suites.

Each plan covers all recordings of its input in one job. Windows inside a plan share the keys ``(trial_id, limb, chunk)``.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treadline.functions import geometry as geo
from treadline.functions import metrics as fm
from treadline.operators import contact, gait, ordered, steps, support
from treadline.operators.ordered import CHUNK
from treadline.schemas import LIMB_ROWS
from treadline.session import materialise

TRIAL = ["trial_id"]
LIMB = ["trial_id", "limb"]


def frame_table(keypoints: DataFrame) -> DataFrame:
    """Long keypoints to one row per frame with ``<part>_x`` / ``<part>_y``; the centre of mass is the mean of the two
    body midpoints."""
    parts = sorted({p for r in LIMB_ROWS for p in r[4:6]} | {"Nose", "Butt", "MidPoint1", "MidPoint2"})
    pick = lambda p, c: F.max(F.when(F.col("bodypart") == p, F.col(c)))
    g = keypoints.groupBy("trial_id", "frame").agg(*[pick(p, c).alias(f"{p}_{c}") for p in parts for c in "xy"])
    return g.withColumns({f"com_{c}": geo.midpoint(F.col(f"MidPoint1_{c}"), F.col(f"MidPoint2_{c}")) for c in "xy"})


def limb_frames(frames: DataFrame) -> DataFrame:
    """One row per limb and frame with toe, heel, and the body axis of the frame."""
    axis = {"nose_x": "Nose_x", "nose_y": "Nose_y", "butt_x": "Butt_x", "butt_y": "Butt_y", "com_x": "com_x", "com_y": "com_y"}
    rows = F.explode(F.array(*[F.struct(
        F.lit(limb).alias("limb"), *[F.col(f"{part}_{c}").alias(f"{name}_{c}") for name, part in (("toe", toe), ("heel", heel)) for c in "xy"])
        for limb, _, _, _, toe, heel in LIMB_ROWS]))
    return frames.select("trial_id", "frame", *[F.col(s).alias(n) for n, s in axis.items()], rows.alias("l")).select(
        "trial_id", "l.limb", "frame", "l.toe_x", "l.toe_y", "l.heel_x", "l.heel_y", *axis)


def analyze(keypoints: DataFrame, fps: float, mode: str = "free", belt_speed: float | None = None,
            mm_per_px: float = 1.0, autocorrect: bool = True, size: int = CHUNK) -> dict[str, DataFrame]:
    """Keypoints (missing where unlikely) to per-limb results.

    Gaps are interpolated first, contact is derived from the trend (treadmill) or the displacement (free run) of the
    limb's midpoint and corrected, then timing, stride lengths, stance angles and stance widths follow. Returns
    ``contact`` (per frame), ``strides``, ``limbs`` (one row per trial and limb) and ``trials`` (symmetry).
    """
    frames = frame_table(keypoints).drop(*[f"MidPoint{i}_{c}" for i in (1, 2) for c in "xy"])
    frames = contact.fill_gaps(frames, TRIAL, [c for c in frames.columns if c not in ("trial_id", "frame")], size=size)
    d = limb_frames(frames)
    d = d.withColumns({"x": geo.midpoint(F.col("toe_x"), F.col("heel_x")), "y": geo.midpoint(F.col("toe_y"), F.col("heel_y"))})
    c = F.col
    angle = geo.axis_angle(c("toe_x"), c("toe_y"), c("heel_x"), c("heel_y"), c("nose_x"), c("nose_y"), c("butt_x"), c("butt_y"))
    width = geo.point_line_distance(c("x"), c("y"), c("com_x"), c("com_y"), c("nose_x"), c("nose_y")) * float(mm_per_px)
    # Written here because two branches read it, and Spark shares no shuffle behind the arrays of the gap filling.
    d = materialise(d.select(*LIMB, "frame", "x", "y", angle.alias("angle"), width.alias("width")))
    if mode == "treadmill":
        d = contact.trend_contact(d, LIMB, size=size)
    else:
        d = contact.displacement_contact(d, LIMB, size=size)
    # Frames are read once, for their runs; corrections, strides and means need runs only.
    measures = {f"{n}_{k}": ("sum", v) for n in ("angle", "width") for k, v in (("sum", c(n)), ("n", c(n).isNotNull().cast("int")))}
    runs = contact.stored_runs(d, LIMB, aggs={"x": ("start", c("x")), "y": ("start", c("y")), **measures}, size=size)
    frames = d.select(*LIMB, "frame", "in_stance", "x", "y")
    if autocorrect:
        runs = materialise(contact.correct_runs(runs, LIMB, size=size))
        fixed = contact.corrected_frames(runs, LIMB, size=size)
        frames = frames.drop("in_stance").join(fixed, [*LIMB, "frame"]).select(*frames.columns)
        merged = ordered.islands(
            runs.drop("in_stance").withColumns({"in_stance": c("corrected"), "_last": c("end") - 1}), LIMB, "start", "_last", "in_stance",
            aggs={"x": ("start", c("x")), "y": ("start", c("y"))}, size=size, stored=True)
    else:
        runs = runs.withColumns({"corrected": c("in_stance"), "opens": F.lit(True)})
        merged = runs
    basics = gait.gait_basics_of_runs(runs, LIMB, fps)
    strides = gait.strides_of_runs(merged, LIMB, fps, belt_speed=belt_speed, mm_per_px=mm_per_px, size=size)
    on = lambda n: F.sum(F.when(c("corrected") == 1, c(n)))
    shape = runs.groupBy(*LIMB).agg(
        F.coalesce(F.try_divide(on("angle_sum"), on("angle_n")), F.lit(0.0)).alias("angle_mean_deg"),
        F.try_divide(F.sum("width_sum"), F.sum("width_n")).alias("stance_width_mean"))
    limbs = (basics.join(gait.stride_summary(strides, LIMB), LIMB, "left").join(shape, LIMB)
             .na.fill(0.0, ["stride_length_mean", "stride_length_variability"]).na.fill(0, ["n_lengths"]))
    return {"contact": frames, "strides": strides, "limbs": limbs, "trials": gait.trial_symmetry(basics, TRIAL)}


def contact_suite(df: DataFrame, fps: float, px_per_mm: float = 1.0, size: int = CHUNK, reuse: bool = False) -> DataFrame:
    """Run-level metrics of a dense contact table (``trial_id, limb, frame, in_stance, intensity, cx, area_px``) as rows
    ``trial_id, limb, metric, value``; trial-level metrics have no limb. Set ``reuse`` when ``df`` is itself the result
    of heavy work, so that it is written once and not worked out again for every group of metrics."""
    df = materialise(df) if reuse else df
    per = steps.limb_aggregates(steps.bouts(df, LIMB, fps, px_per_mm, size=size), LIMB, fps, px_per_mm)
    wide = support.to_wide(df, TRIAL)
    wide = materialise(wide) if reuse else wide
    length = wide.groupBy(*TRIAL).agg(((F.max("frame") + 1) / max(float(fps), 1.0)).alias("run_duration_s"))
    total = per.groupBy(*TRIAL).agg(F.sum("n_steps").cast("double").alias("n_steps_total"))
    parts = [long_metrics(per, LIMB)] + [long_metrics(t, TRIAL) for t in (
        gait.limb_drift_speed(df, TRIAL, "limb", "cx", fps, px_per_mm), support.joint_stance(wide, TRIAL),
        support.coordination(wide, TRIAL, size=size), length, total)]
    return reduce(DataFrame.unionByName, parts)


def long_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns to rows ``trial_id, limb, metric, value``."""
    names = [c for c in df.columns if c not in keys]
    limb = F.col("limb") if "limb" in keys else F.lit(None).cast("string")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]))
    return df.select("trial_id", limb.alias("limb"), rows.alias("r")).select("trial_id", "limb", "r.metric", "r.value")


def flat_metrics(metrics: DataFrame) -> DataFrame:
    """One map per trial: ``<limb>_<metric>`` or ``<metric>`` to value, for export."""
    name = F.concat(F.coalesce(F.concat("limb", F.lit("_")), F.lit("")), "metric")
    return metrics.groupBy("trial_id").agg(F.map_from_entries(F.collect_list(F.struct(name.alias("k"), F.col("value").alias("v")))).alias("metrics"))


def metric_suite(df: DataFrame, fps: float, mm_per_px: float = 1.0, belt_speed: float | None = None,
                 body: DataFrame | None = None, size: int = CHUNK, reuse: bool = False) -> DataFrame:
    """The full gait suite of a dense contact table, as rows ``trial_id, limb, metric, value``.

    ``df`` has ``trial_id, limb, frame, in_stance`` and, optionally, ``x, y`` (limb midpoints) and ``intensity`` (plus
    ``area_px``). ``body`` has per-frame ``trial_id, frame, com_x`` and, optionally, ``front_x, front_y, rear_x,
    rear_y`` and ``fore_x, fore_y, hind_x, hind_y, com_y, ref_x, ref_y``. Metrics without input are left out. ``reuse``
    is as in :func:`contact_suite`.
    """
    if reuse:
        df, body = materialise(df), None if body is None else materialise(body)
    c = F.col
    basics = gait.gait_basics(df, LIMB, fps, size=size)
    basics = materialise(basics) if reuse else basics
    per = basics.select(
        *LIMB, "stance_ms", "swing_ms", fm.cycle_ms(c("stance_ms"), c("swing_ms")).alias("cycle_ms"),
        fm.stance_pct(c("stance_ms"), c("swing_ms")).alias("pct_stance"), fm.swing_pct(c("stance_ms"), c("swing_ms")).alias("pct_swing"),
        fm.duty_cycle(c("stance_ms"), c("swing_ms")).alias("duty_cycle"),
        fm.swing_to_stance(c("stance_ms"), c("swing_ms")).alias("swing_to_stance"), c("stride_hz").alias("stride_frequency_hz"), "n_strides")
    hz = F.coalesce(F.avg(F.when(c("stride_frequency_hz") > 0, c("stride_frequency_hz"))), F.lit(0.0))
    side = lambda n, m: F.max(F.when(c("limb") == n, c(m)))
    trial = per.groupBy(*TRIAL).agg(
        *[F.avg(m).alias(f"avg_{m}") for m in ("stance_ms", "swing_ms", "cycle_ms", "pct_stance", "pct_swing", "duty_cycle", "swing_to_stance")],
        hz.alias("avg_stride_frequency_hz"), fm.cadence(hz).alias("cadence_steps_per_min"),
        *[fm.symmetry_index(side(a, m), side(b, m)).alias(n) for n, a, b, m in (
            ("symmetry_index_stance", "LF", "RF", "stance_ms"), ("symmetry_index_swing", "LF", "RF", "swing_ms"),
            ("symmetry_index_hind_stance", "LH", "RH", "stance_ms"), ("symmetry_index_hind_swing", "LH", "RH", "swing_ms"))])
    measures = {"x": "x", "y": "y"} if "x" in df.columns else {}
    wide = support.to_wide(df, TRIAL, measures)
    wide = materialise(wide) if reuse else wide
    parts = [per, trial, support.onset_regularity(wide, TRIAL, size=size), support.phase_dispersion(wide, TRIAL, fps, size=size)]
    if measures:
        strides = gait.stride_lengths(df, LIMB, fps, belt_speed=belt_speed, mm_per_px=mm_per_px, size=size)
        # Every frame of a stride counts once, so the sums are weighted by stride duration.
        n, v = (c("end") - c("start")).cast("double"), c("stride_length")
        s = strides.where("stride_length > 0").groupBy(*TRIAL).agg(
            F.sum(n).alias("n"), F.sum(v * n).alias("s"), F.sum(v * v * n).alias("q"))
        mean = c("s") / c("n")
        s = s.select("trial_id", mean.alias("stride_length_avg_mm"), F.coalesce(F.sqrt(F.greatest(F.lit(0.0), F.try_divide(
            c("q") - c("s") * mean, c("n") - 1))), F.lit(0.0)).alias("stride_length_variability"))
        parts.append(s)
        parts.append(trial.select("trial_id", "avg_swing_ms").join(s, "trial_id").select(
            "trial_id", fm.swing_speed(c("stride_length_avg_mm"), c("avg_swing_ms")).alias("swing_speed_mm_ms")))
        parts.append(gait.pair_widths(wide, TRIAL, c("lf_x"), c("rf_x"), mm_per_px, "step_width_avg_mm"))
        parts.append(gait.pair_widths(wide, TRIAL, c("lf_x"), c("lh_x"), mm_per_px, "toe_spread_mm"))
    if body is not None:
        parts.append(gait.body_speed(body, TRIAL, "com_x", fps, mm_per_px))
        if "front_x" in body.columns:
            parts.append(gait.mean_angle(body, TRIAL, c("front_y") - c("rear_y"), c("front_x") - c("rear_x")))
        if "fore_x" in body.columns:
            apart = F.avg(geo.distance(c("fore_x"), c("fore_y"), c("hind_x"), c("hind_y")) * float(mm_per_px))
            turn = F.avg(geo.signed_angle(c("fore_x") - c("hind_x"), c("fore_y") - c("hind_y"), c("ref_x") - c("com_x"), c("ref_y") - c("com_y")))
            parts.append(body.groupBy(*TRIAL).agg(apart.alias("base_of_support_mm"), turn.alias("step_angle_deg")))
    if "intensity" in df.columns:
        parts.append(gait.intensity_summary(df, TRIAL, area="area_px" if "area_px" in df.columns else None))
    return reduce(DataFrame.unionByName, [long_metrics(p, LIMB if "limb" in p.columns else TRIAL) for p in parts])


def cycles_from_detections(det: DataFrame, roi: DataFrame | None, fps: float, px_per_mm: float, min_area: int = 5,
                           iou_min: float = 0.3, max_gap: int = 3, size: int = CHUNK) -> dict[str, DataFrame]:
    """Detections with masks to cycles: area and body gates, linking, cycle summary, centre-of-pressure path, numbering."""
    from treadline.operators import cycles, pixels, tracking
    d = det.where(F.col("area_px") >= min_area)
    if roi is not None:
        d = pixels.gate_by_body(d, roi)
    d = materialise(d)
    keep = [c for c in d.columns if c not in (*TRIAL, "frame", "det_id", "mask")]
    tracked = materialise(tracking.link_by_iou(d, TRIAL, iou_min, max_gap, size=size, keep=keep))
    cyc = cycles.build_cycles(tracked, TRIAL, fps=fps, px_per_mm=px_per_mm, size=size)
    cop = cycles.pressure_centre_path(tracked, TRIAL, px_per_mm=px_per_mm, size=size)
    cyc = materialise(cycles.number_cycles(cyc.join(cop, [*TRIAL, "track_id"]), TRIAL, size=size))
    frames = cycles.frame_records(tracked, fps, px_per_mm).join(cyc.select(*TRIAL, "track_id", "cycle_id"), [*TRIAL, "track_id"])
    return {"cycle": cyc, "cycle_frame": frames, "trim": cycles.trim_range(tracked, det.select(*TRIAL).distinct(), TRIAL)}
