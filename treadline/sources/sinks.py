"""Sinks: export tables in their fixed layouts, and writers. A writer writes all trials of a table in one job."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treadline.functions import metrics as fm
from treadline.operators import steps
from treadline.operators.ordered import CHUNK
from treadline.schemas import LIMBS

# Column orders of the export files.
CYCLE_COLUMNS = (
    "cycle_id", "paw_id", "touchdown_frame", "liftoff_frame", "peak_area_frame", "peak_intensity_frame", "duration_s",
    "loading_duration_s", "weight_bearing_duration_s", "unloading_duration_s", "peak_centroid_x_mm", "peak_centroid_y_mm",
    "print_length_mm", "print_width_mm", "max_area_mm2", "max_area_px", "mean_pressure_at_peak", "peak_pressure", "stand_index",
    "pressure_area_ratio", "cop_path_length_mm", "cop_displacement_mm", "n_frames")
DETAIL_COLUMNS = (
    "cycle_id", "frame", "time_s", "centroid_x_mm", "centroid_y_mm", "area_mm2", "area_px", "mean_intensity", "peak_intensity",
    "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")
LIMB_COLUMNS = (
    "paw", "n_steps", "avg_stance_s", "avg_swing_s", "duty_cycle_pct", "stride_length_cm", "step_length_cm", "avg_swing_speed_cm_s",
    "avg_instantaneous_speed_cm_s", "max_contact_area_cm2", "print_area_cm2", "mean_intensity", "max_intensity",
    "max_contact_max_intensity", "avg_stand_index", "total_stand_index", "cadence_steps_per_min")
STEP_COLUMNS = (
    "paw", "step_num", "start_frame", "end_frame", "stance_frames", "stand_s", "swing_frames", "swing_s", "stride_length_cm",
    "swing_speed_cm_s", "instantaneous_speed_cm_s", "max_intensity", "mean_intensity", "max_contact_area_cm2", "braking_s",
    "propulsion_s", "braking_index", "propulsion_index")
SUMMARY_COLUMNS = (
    "name", "side", "limb", "stance_duration_ms", "swing_duration_ms", "n_strides", "stride_length_mean", "stride_length_variability",
    "stride_frequency_hz", "paw_angle_mean_deg", "stance_width_mean")


def layout(df: DataFrame, keys: Sequence[str], columns: Sequence[str], names: dict[str, Column] | None = None) -> DataFrame:
    """Columns in their export order; what no operator produces is an empty column."""
    names = names or {}
    have = set(df.columns)
    cols = [names[c].alias(c) if c in names else F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]
    return df.select(*keys, *cols)


def cycle_table(cycles: DataFrame) -> DataFrame:
    return layout(cycles, ["trial_id"], CYCLE_COLUMNS, {} if "paw_id" in cycles.columns else {"paw_id": F.lit("")})


def detail_table(frames: DataFrame) -> DataFrame:
    box = {f"bbox_{c}": F.col(c) for c in ("x1", "y1", "x2", "y2") if c in frames.columns}
    return layout(frames, ["trial_id"], DETAIL_COLUMNS, box)


def limb_table(contact: DataFrame, pressure: DataFrame) -> DataFrame:
    """Per-limb summary from contact and pressure aggregates (the pressure side wins where both have a column)."""
    own = [c for c in contact.columns if c in ("trial_id", "limb") or c not in pressure.columns]
    d = contact.select(*own).join(pressure, ["trial_id", "limb"], "left")
    return layout(d, ["trial_id"], LIMB_COLUMNS, {"paw": F.col("limb")})


def step_table(step_rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Per-step rows with their ordinal; lengths and speeds in cm."""
    d = steps.number_steps(step_rows, ["trial_id", "limb"], size)
    c = F.col
    return layout(d, ["trial_id"], STEP_COLUMNS, {
        "paw": c("limb"), "start_frame": c("start"), "end_frame": c("end"), "stride_length_cm": c("stride_length_mm") / 10.0,
        "swing_speed_cm_s": c("swing_speed_mm_s") / 10.0, "instantaneous_speed_cm_s": c("speed_mm_s") / 10.0})


def pressure_table(rows: DataFrame) -> DataFrame:
    """Per-frame pressure rows as displayed: four digits below 100, two above."""
    return rows.select(*[fm.display_round(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def summary_table(limbs: DataFrame, names: DataFrame) -> DataFrame:
    """One row per limb of an analysis; ``names`` is the limb dimension."""
    d = limbs.withColumnRenamed("limb", "_l").join(names.select(F.col("limb").alias("_l"), "limb_name", "side", "girdle"), "_l")
    c = F.col
    return layout(d, ["trial_id"], SUMMARY_COLUMNS, {
        "name": c("limb_name"), "limb": c("girdle"), "stance_duration_ms": c("stance_ms"), "swing_duration_ms": c("swing_ms"),
        "stride_frequency_hz": c("stride_hz"), "paw_angle_mean_deg": c("angle_mean_deg")})


def contact_table(contact: DataFrame) -> DataFrame:
    """Per-frame contact, one column per limb."""
    v = lambda n: F.max(F.when(F.col("limb") == n, F.col("in_stance"))).alias(f"{n}_stance")
    return contact.groupBy("trial_id", "frame").agg(*[v(n) for n in LIMBS])


def print_index(prints: DataFrame) -> DataFrame:
    """Flat index of prints with fixed formats; decay frames are counted from ``decay_phase_mask``."""
    fmt = lambda f, c: F.when(c.isNull(), "").otherwise(F.format_string(f, c))
    c = F.col
    return prints.select(
        "trial_id", "print_id", "touchdown_frame", "liftoff_frame", "true_liftoff_frame", "n_frames",
        F.size(F.filter("decay_phase_mask", lambda m: m)).alias("n_extension_frames"), fmt("%.4f", c("duration_s")).alias("duration_s"),
        fmt("%.3f", c("max_area_mm2")).alias("max_area_mm2"), fmt("%.3f", c("peak_centroid_x_mm")).alias("peak_centroid_x_mm"),
        fmt("%.3f", c("peak_centroid_y_mm")).alias("peak_centroid_y_mm"), fmt("%.3f", c("peak_pressure")).alias("peak_pressure"),
        fmt("%.4f", c("decay_tau_ms")).alias("decay_tau_ms"), fmt("%.4f", c("decay_r2")).alias("decay_r2"),
        c("is_clean_liftoff").cast("int").alias("is_clean_liftoff"), F.format_string("prints/print_%03d", c("print_id")).alias("dir_path"))


def footprint_table(feet: DataFrame) -> DataFrame:
    """Detected feet with fixed formats; an unassigned foot is named after its label."""
    c = F.col
    return feet.select(
        "trial_id", "frame", F.coalesce("limb", F.concat(F.lit("blob_"), c("label").cast("string"))).alias("paw"), "area_px",
        F.format_string("%.2f", c("area_mm2")).alias("area_mm2"), F.format_string("%.1f", c("intensity_mean")).alias("mean_intensity"),
        c("intensity_max").alias("max_intensity"), F.format_string("%.1f", c("intensity_total")).alias("sum_intensity"),
        c("is_in_stance").cast("int").alias("is_in_stance"))


def label_lines(det: DataFrame, width: int = 1920, height: int = 384, min_area: int = 5) -> DataFrame:
    """One label file per frame: boxes clamped to the image, as normalised four-point polygons, largest first.

    Small detections and boxes that the clamping empties are left out. A frame's lines are bounded by its detections.
    """
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.col(c), F.lit(n - 1)))
    d = det.where(F.col("area_px") >= min_area).select(
        "trial_id", "frame", "area_px", clamp("x1", width).alias("x1"), clamp("y1", height).alias("y1"), clamp("x2", width).alias("x2"),
        clamp("y2", height).alias("y2")).where("x2 > x1 and y2 > y1")
    nx1, nx2 = F.col("x1") / float(width), F.col("x2") / float(width)
    ny1, ny2 = F.col("y1") / float(height), F.col("y2") / float(height)
    line = F.format_string("0 %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f", nx1, ny1, nx2, ny1, nx2, ny2, nx1, ny2)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("area_px")).alias("a"), "x1", "y1", "x2", "y2", line.alias("line"))))
    g = d.groupBy("trial_id", "frame").agg(rows.alias("r"))
    return g.select("trial_id", F.format_string("frame_%04d", "frame").alias("file_name"), F.array_join(F.col("r.line"), "\n").alias("content"))


def subject_label(animal: Column) -> Column:
    """Letters and digits only; ``subject`` if nothing is left."""
    s = F.regexp_replace(animal, r"[^\p{L}\p{N}]", "")
    return F.when(s == "", "subject").otherwise(s)


def session_label(date: Column) -> Column:
    """``ses-yyyyMMdd`` of an ISO date, ``ses-01`` otherwise. (The fallback is not doubled.)"""
    return F.concat(F.lit("ses-"), F.coalesce(F.date_format(date.try_cast("timestamp"), "yyyyMMdd"), F.lit("01")))


def cycle_documents(cycles: DataFrame, frames: DataFrame, size: int = CHUNK) -> DataFrame:
    """Nested cycles: one document per cycle with its frames in order. Cycles longer than ``size`` frames come in parts,
    so that no document is unbounded."""
    f = F.array_sort(F.collect_list(F.struct("frame", "time_s", "centroid_x_mm", "centroid_y_mm", "area_mm2", "mean_intensity")))
    g = frames.groupBy("trial_id", "cycle_id", F.floor(F.col("frame") / size).cast("int").alias("part")).agg(f.alias("frames"))
    keep = ["touchdown_frame", "liftoff_frame", "duration_s", "max_area_mm2", "peak_centroid_x_mm", "peak_centroid_y_mm", "print_length_mm",
            "print_width_mm", "cop_path_length_mm", "n_frames"]
    return cycles.select("trial_id", "cycle_id", *keep).join(g, ["trial_id", "cycle_id"])


def write_csv(df: DataFrame, path: str, by: Sequence[str] = ("trial_id",)) -> None:
    """CSV with header and blanks for missing values, one folder per ``by``."""
    df.write.mode("overwrite").partitionBy(*by).option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)


def write_tsv_gz(df: DataFrame, path: str, by: Sequence[str]) -> None:
    (df.write.mode("overwrite").partitionBy(*by).option("header", "true").option("sep", "\t").option("nullValue", "")
     .option("emptyValue", "").option("compression", "gzip").csv(path))


def write_json(df: DataFrame, path: str, by: Sequence[str] = ("trial_id",)) -> None:
    df.write.mode("overwrite").partitionBy(*by).json(path)


def write_trial(cycles: DataFrame, frames: DataFrame, path: str) -> None:
    """Cycle summary, frame detail and nested documents of all trials."""
    write_csv(cycle_table(cycles), f"{path}/cycles_summary")
    write_csv(detail_table(frames), f"{path}/footprints_detail")
    write_json(cycle_documents(cycles, frames), f"{path}/trial_data")


def write_animal(tables: dict[str, DataFrame], animals: DataFrame, path: str) -> None:
    """Every table of every animal in one go, one folder per animal. ``animals`` maps ``trial_id`` to ``animal_id``."""
    for name, df in tables.items():
        write_csv(df.join(animals.select("trial_id", "animal_id"), "trial_id"), f"{path}/{name}", ("animal_id", "trial_id"))


def write_subjects(trials: DataFrame, pose: DataFrame, limb_metrics: DataFrame, summary: DataFrame, path: str) -> None:
    """Subject / session tree: participants and sessions (TSV), pose and limb metrics (gzipped TSV), summary (JSON).

    ``trials`` has ``trial_id, animal_id, species, operator, experiment_date``.
    """
    t = trials.select("*", F.concat(F.lit("sub-"), subject_label(F.col("animal_id"))).alias("subject"),
                      session_label(F.col("experiment_date")).alias("session"))
    tsv = lambda df, p: df.write.mode("overwrite").option("header", "true").option("sep", "\t").csv(f"{path}/{p}")
    tsv(t.select(F.col("subject").alias("participant_id"), "species", "trial_id", "operator"), "participants")
    tsv(t.select("subject", F.col("session").alias("session_id"), F.col("experiment_date").alias("acq_time")), "sessions")
    place = t.select("trial_id", "subject", "session")
    by = ["subject", "session"]
    write_tsv_gz(pose.join(place, "trial_id"), f"{path}/pose", by)
    write_tsv_gz(limb_metrics.join(place, "trial_id"), f"{path}/limb_metrics", [*by, "limb"])
    write_json(summary.join(place, "trial_id"), f"{path}/summary", by)


def write_truth_json(truth: DataFrame, path: str) -> None:
    write_json(truth, path)


def write_labels(lines: DataFrame, path: str) -> None:
    """Label text, one folder per trial and frame file."""
    lines.write.mode("overwrite").partitionBy("trial_id", "file_name").text(path)
