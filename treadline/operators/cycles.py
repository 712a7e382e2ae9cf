"""Contact cycles: one row per tracked footprint, from its per-frame detections."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treadline.functions import metrics as fm
from treadline.operators import ordered
from treadline.operators.ordered import CHUNK
from treadline.schemas import DEFAULT_FPS, DEFAULT_PX_PER_MM


def frame_records(det: DataFrame, fps: float = DEFAULT_FPS, px_per_mm: float = DEFAULT_PX_PER_MM,
                  origin: int = 0) -> DataFrame:
    """Physical units per detection: ``time_s`` (frames counted from ``origin``), ``area_mm2`` and centroid in mm."""
    return det.withColumns({
        "time_s": (F.col("frame") - origin) / float(fps),
        "area_mm2": fm.px2_to_mm2(F.col("area_px"), px_per_mm),
        "centroid_x_mm": fm.px_to_mm(F.col("cx"), px_per_mm),
        "centroid_y_mm": fm.px_to_mm(F.col("cy"), px_per_mm)})


def _first_top(value: str, pick: str | None = None):
    """Aggregate: the frame (or ``pick``) of the highest value, the earliest frame on ties."""
    return F.max_by(pick or "frame", F.struct(F.col(value), -F.col("frame")))


def build_cycles(det: DataFrame, trial: Sequence[str], track: str = "track_id", fps: float = DEFAULT_FPS,
                 px_per_mm: float = DEFAULT_PX_PER_MM, min_frames: int = 2, decay: float = 6.0,
                 weight_share: float = 0.8, clean_below: float = 3.0, loading_to: str = "intensity",
                 size: int = CHUNK) -> DataFrame:
    """Cycle summary per track.

    True lift-off is the last frame at or above ``decay``; the duration runs to it. Weight is borne on the frames with
    at least ``weight_share`` of the peak intensity. ``loading_to="intensity"`` measures loading and unloading around the
    intensity peak with unloading to the true lift-off; ``"area"`` around the area peak, up to the last frame.
    """
    keys = [*trial, track]
    d = ordered.with_totals(det, keys, {"_top": ("max", F.col("mean_intensity"))}, size=size)
    fps = float(fps)
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("n_frames"), F.min("frame").alias("touchdown_frame"),
        F.max("frame").alias("liftoff_frame"), _first_top("area_px").alias("peak_area_frame"),
        _first_top("mean_intensity").alias("peak_intensity_frame"),
        F.max(F.when(F.col("mean_intensity") >= decay, F.col("frame"))).alias("_true"),
        F.count_if(F.col("mean_intensity") >= weight_share * F.col("_top")).alias("_wb"),
        F.max("area_px").alias("max_area_px"),
        F.max("mean_intensity").alias("peak_pressure"),
        F.max_by(F.struct("cx", "cy", "x1", "y1", "x2", "y2", "mean_intensity"),
                 F.struct("area_px", -F.col("frame"))).alias("_p"),
        F.min_by("mean_intensity", "frame").alias("touchdown_intensity"),
        F.max_by("mean_intensity", "frame").alias("liftoff_intensity"))
    g = g.where(F.col("n_frames") >= min_frames)
    true = F.coalesce("_true", "touchdown_frame")
    to_area = loading_to == "area"
    peak = F.col("peak_area_frame" if to_area else "peak_intensity_frame")
    stop = F.col("liftoff_frame") if to_area else true
    area = fm.px2_to_mm2(F.col("max_area_px"), px_per_mm)
    return g.select(
        *keys, "n_frames", "touchdown_frame", "liftoff_frame", true.alias("true_liftoff_frame"), "peak_area_frame",
        "peak_intensity_frame", ((stop - F.col("touchdown_frame")) / fps).alias("duration_s"),
        ((peak - F.col("touchdown_frame")) / fps).alias("loading_duration_s"),
        (F.col("_wb") / fps).alias("weight_bearing_duration_s"), ((stop - peak) / fps).alias("unloading_duration_s"),
        "max_area_px", area.alias("max_area_mm2"),
        fm.px_to_mm(F.col("_p.cx"), px_per_mm).alias("peak_centroid_x_mm"),
        fm.px_to_mm(F.col("_p.cy"), px_per_mm).alias("peak_centroid_y_mm"),
        fm.px_to_mm(F.col("_p.y2") - F.col("_p.y1"), px_per_mm).alias("print_length_mm"),
        fm.px_to_mm(F.col("_p.x2") - F.col("_p.x1"), px_per_mm).alias("print_width_mm"),
        F.col("_p.mean_intensity").alias("mean_pressure_at_peak"), "peak_pressure",
        (F.col("_p.mean_intensity") * area).alias("stand_index"),
        F.coalesce(F.try_divide(F.col("_p.mean_intensity"), area), F.lit(0.0)).alias("pressure_area_ratio"),
        "touchdown_intensity", "liftoff_intensity",
        (F.col("liftoff_intensity") < clean_below).alias("is_clean_liftoff"))


def pressure_centre_path(det: DataFrame, trial: Sequence[str], track: str = "track_id",
                         px_per_mm: float = DEFAULT_PX_PER_MM, size: int = CHUNK) -> DataFrame:
    """Length of the centroid path of a track and the distance between its ends, in mm."""
    keys = [*trial, track]
    w = ordered.chunk_window(keys)
    xy = F.struct("cx", "cy")
    step = lambda x, y, px, py: F.hypot(F.col(x) - px, F.col(y) - py) / float(px_per_mm)
    d = ordered.with_chunk(det.select(*keys, "frame", "cx", "cy"), size=size)
    d = d.withColumn("_step", step("cx", "cy", F.lag("cx").over(w), F.lag("cy").over(w)))
    # One row per chunk of a track; only the step into a chunk and the ends of the track need more than that chunk.
    part = d.groupBy(*keys, "_chunk").agg(F.sum("_step").alias("_in"), F.min_by(xy, "frame").alias("_a"), F.max_by(xy, "frame").alias("_z"))
    before = F.lag("_z").over(Window.partitionBy(*keys).orderBy("_chunk"))
    part = part.withColumn("_into", step("_a.cx", "_a.cy", before["cx"], before["cy"]))
    a, z = F.min_by("_a", "_chunk"), F.max_by("_z", "_chunk")
    return part.groupBy(*keys).agg(
        (F.coalesce(F.sum("_in"), F.lit(0.0)) + F.coalesce(F.sum("_into"), F.lit(0.0))).alias("cop_path_length_mm"),
        (F.hypot(z["cx"] - a["cx"], z["cy"] - a["cy"]) / float(px_per_mm)).alias("cop_displacement_mm"))


def number_cycles(cycles: DataFrame, trial: Sequence[str], track: str = "track_id", size: int = CHUNK) -> DataFrame:
    """``cycle_id`` from 1 per trial, by touchdown, then track. The key of a cycle is ``(trial, cycle_id)``."""
    return ordered.number_rows(cycles, trial, ["touchdown_frame", track],
                               F.floor(F.col("touchdown_frame") / size), name="cycle_id", start=1)


def geometry_comparison(det: DataFrame, pixels: DataFrame, trial: Sequence[str], track: str = "track_id") -> DataFrame:
    """Peak-frame area and box of a track against the area and box of the union of its mask pixels."""
    keys = [*trial, track]
    peak = det.groupBy(*keys).agg(F.max_by(F.struct("area_px", "x1", "y1", "x2", "y2"),
                                           F.struct("area_px", -F.col("frame"))).alias("p"))
    union = pixels.select(*keys, "x", "y").distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("union_area_px"), (F.max("x") - F.min("x") + 1).alias("union_width"),
        (F.max("y") - F.min("y") + 1).alias("union_height"))
    return peak.join(union, keys).select(
        *keys, F.col("p.area_px").alias("peak_area_px"), (F.col("p.x2") - F.col("p.x1")).alias("peak_width"),
        (F.col("p.y2") - F.col("p.y1")).alias("peak_height"), "union_area_px", "union_width", "union_height")


def print_curves(det: DataFrame, trial: Sequence[str], track: str = "track_id", size: int = CHUNK) -> DataFrame:
    """Pressure, area and frame lists of a print, in frame order; a print longer than ``size`` frames is listed in
    parts, so that no row holds an unbounded list."""
    rows = F.array_sort(F.collect_list(F.struct("frame", "mean_intensity", "area_px")))
    part = F.floor(F.col("frame") / size).cast("int").alias("part")
    g = det.groupBy(*trial, track, part).agg(rows.alias("r"))
    return g.select(*trial, track, "part", F.col("r.frame").alias("frames"),
                    F.col("r.mean_intensity").alias("pressure_curve"), F.col("r.area_px").alias("area_curve"))


def trim_range(det: DataFrame, trials: DataFrame, trial: Sequence[str]) -> DataFrame:
    """First and last frame of any track per trial; (0, -1) where nothing was tracked."""
    g = det.groupBy(*trial).agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    return (trials.select(*trial).distinct().join(g, list(trial), "left")
            .na.fill({"first_frame": 0, "last_frame": -1}))
