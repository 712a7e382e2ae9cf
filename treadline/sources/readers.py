"""Readers: pose tables, file catalogues, ground truth, body boxes and tracker events, all as DataFrames."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treadline.functions import geometry as geo
from treadline.functions import metrics as fm
from treadline.operators import ordered
from treadline.operators.series import median_filter
from treadline.schemas import BODY_ROI, GROUND_TRUTH, LIMBS, limb_dimension

# First cells of the three header rows of a pose table.
HEADER_CELLS = ("scorer", "bodyparts", "coords")
# Camera roles a recording session must have, and video suffixes.
REQUIRED_ROLES = ("bottom", "left", "right", "top")
VIDEO_SUFFIXES = ("mp4", "avi", "mov", "mkv")
# Columns of the commercial time-series sheet (limb, touchdown time, stride, position) and of the
# per-frame pressure sheet (frame; limb followed by total, maximum, minimum, mean).
SHEET_LIMB, SHEET_TOUCHDOWN, SHEET_STRIDE, SHEET_POSITION = "脚印", "首次着地时间", "步幅", "步伐位置"
PRESSURE_KINDS = {"总": "total", "最大": "max", "最小": "min", "平均": "mean"}


def stem(path: Column) -> Column:
    """File name without directory and suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                        F.col("_metadata.file_block_start").alias("block"))


def read_pose(spark: SparkSession, path: str | Sequence[str], likelihood: float = 0.1,
              height: float | None = None) -> DataFrame:
    """Pose CSVs with three header rows to long keypoints; the trial is the file stem.

    Columns are matched exactly by (body part, coordinate). Coordinates under the likelihood threshold are missing;
    ``height`` flips y. Files that share one header layout need no join; otherwise rows meet their own file's header.
    """
    raw = _lines(spark, path).withColumn("cells", F.split("value", ","))
    first = F.lower(F.trim(F.col("cells")[0]))
    head = raw.where(first.isin(*HEADER_CELLS)).groupBy("file").agg(
        F.max(F.when(first == HEADER_CELLS[1], F.col("cells"))).alias("parts"),
        F.max(F.when(first == HEADER_CELLS[2], F.col("cells"))).alias("coords")).where("parts is not null and coords is not null")
    layouts = head.select("parts", "coords").distinct().limit(2).collect()
    if not layouts:
        raise ValueError(f"no pose header rows in {path}")
    rows = raw.select("file", "cells", F.trim(F.col("cells")[0]).try_cast("int").alias("frame")).where("frame is not null")
    if len(layouts) == 1:
        lit = lambda xs: F.array(*[F.lit(x) for x in xs])
        rows = rows.withColumns({"parts": lit(layouts[0]["parts"]), "coords": lit(layouts[0]["coords"])})
    else:
        rows = rows.join(head, "file")
    cell = F.posexplode(F.arrays_zip("parts", "coords", "cells"))
    d = rows.select("file", "frame", cell.alias("pos", "c")).where("pos > 0")
    d = d.select("file", "frame", F.trim("c.parts").alias("bodypart"), F.lower(F.trim("c.coords")).alias("coord"),
                 F.trim("c.cells").try_cast("double").alias("v"))
    pick = lambda n: F.max(F.when(F.col("coord") == n, F.nanvl("v", F.lit(None).cast("double"))))
    g = d.groupBy("file", "frame", "bodypart").agg(pick("x").alias("x"), pick("y").alias("y"), pick("likelihood").alias("likelihood"))
    y = F.col("y") if height is None else geo.flip_y(F.col("y"), height)
    ok = F.coalesce(F.col("likelihood"), F.lit(1.0))
    return g.select(stem(F.col("file")).alias("trial_id"), "frame", "bodypart", geo.confident(F.col("x"), ok, likelihood).alias("x"),
                    geo.confident(y, ok, likelihood).alias("y"), "likelihood")


def pose_errors(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of pose CSVs that are neither header nor data, so that one bad file does not stop the others."""
    raw = _lines(spark, path)
    cell = F.trim(F.split("value", ",")[0])
    bad = ~F.lower(cell).isin(*HEADER_CELLS) & cell.try_cast("int").isNull() & (F.trim("value") != "")
    return raw.where(bad).select(stem(F.col("file")).alias("trial_id"), "value")


def limb_keypoints(keypoints: DataFrame) -> DataFrame:
    """Toe and heel of every limb and frame."""
    parts = limb_dimension(keypoints.sparkSession)
    ends = parts.select("limb", F.explode(F.map_from_arrays(F.array(F.lit("toe"), F.lit("heel")), F.array("toe", "heel"))).alias("end", "bodypart"))
    d = keypoints.join(ends, "bodypart")
    v = lambda e, c: F.max(F.when(F.col("end") == e, F.col(c))).alias(f"{e}_{c}")
    return d.groupBy("trial_id", "limb", "frame").agg(*[v(e, c) for e in ("toe", "heel") for c in "xy"])


def filter_keypoints(keypoints: DataFrame, window: int = 5, size: int = ordered.CHUNK) -> DataFrame:
    """Moving median of every body part's track."""
    return median_filter(keypoints, ["trial_id", "bodypart"], ["x", "y"], window, size=size)


def image_points(keypoints: DataFrame, missing_as_zero: bool = False) -> DataFrame:
    """Keypoints as ``joint, u, v`` observations; optionally 0 where a coordinate is missing."""
    c = lambda n: F.coalesce(n, F.lit(0.0)) if missing_as_zero else F.col(n)
    return keypoints.select("trial_id", "frame", F.col("bodypart").alias("joint"), c("x").alias("u"), c("y").alias("v"))


def list_files(spark: SparkSession, root: str | Sequence[str]) -> DataFrame:
    """Paths, sizes and times below the roots. Only metadata columns are selected, so no content is read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select("path", "length", "modificationTime"))


def list_videos(files: DataFrame, suffixes: Sequence[str] = VIDEO_SUFFIXES) -> DataFrame:
    """Video paths, each once, by suffix in any case."""
    return files.where(F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$")).select("path").distinct().orderBy("path")


def list_sessions(files: DataFrame, roles: Sequence[str] = REQUIRED_ROLES) -> DataFrame:
    """Sessions ``<animal>/<time>/<role>.mp4``: roles present and missing, bytes, completeness. Folders without any role
    file are no sessions."""
    p = r"([^/]+)/([^/]+)/([^/]+)\.mp4$"
    d = files.select(*[F.regexp_extract("path", p, i).alias(n) for i, n in ((1, "animal_id"), (2, "session_ts"), (3, "role"))], "length")
    g = d.where(F.col("role").isin(*roles)).groupBy("animal_id", "session_ts").agg(
        F.array_sort(F.collect_set("role")).alias("roles_present"), F.sum("length").alias("total_size_bytes"))
    missing = F.array_except(F.array(*[F.lit(r) for r in roles]), "roles_present")
    return g.select("*", missing.alias("roles_missing"), (F.size(missing) == 0).alias("is_complete"))


def pose_outputs(files: DataFrame, suffixes: Sequence[str] = VIDEO_SUFFIXES) -> DataFrame:
    """Per video the pose files in its folder whose name starts with its stem: filtered and raw CSV and the better one.

    A file is offered under every prefix of its name, which makes "starts with" an equi-join.
    """
    folder = lambda c: F.regexp_extract(c, r"^(.*)/", 1)
    videos = list_videos(files, suffixes).select(F.col("path").alias("video"), folder("path").alias("folder"), stem(F.col("path")).alias("stem"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    low = F.lower(name)
    kind = (F.when(low.endswith("_filtered.csv"), "filtered_csv").when(low.endswith("_filtered.h5"), "filtered_h5")
            .when(low.endswith("_meta.json"), "meta").when(low.endswith(".csv"), "csv").when(low.endswith(".h5"), "h5"))
    f = files.select("path", folder("path").alias("folder"), name.alias("n"), kind.alias("kind")).where("kind is not null")
    f = f.withColumn("stem", F.explode(F.transform(F.sequence(F.lit(1), F.length("n")), lambda i: F.substring("n", F.lit(1), i))))
    d = videos.join(f, ["folder", "stem"], "left")
    one = lambda k: F.min(F.when(F.col("kind") == k, F.col("path")))
    last = lambda k: F.max(F.when(F.col("kind") == k, F.col("path")))
    g = d.groupBy("video").agg(last("filtered_csv").alias("filtered_csv"), one("csv").alias("csv"), last("filtered_h5").alias("filtered_h5"),
                               one("h5").alias("h5"), last("meta").alias("meta"))
    return g.withColumn("best_csv", F.coalesce("filtered_csv", "csv"))


def read_truth_json(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Ground-truth prints; the limb is optional. The trial is the file stem."""
    d = spark.read.schema(GROUND_TRUTH).option("multiLine", "true").json(path)
    return d.select(stem(F.col("_metadata.file_path")).alias("trial_id"), *GROUND_TRUTH.fieldNames())


def truth_from_sheet(rows: DataFrame, fps: float = 60.0, unit: str = "px", drop_invalid: bool = True, px_per_mm: float = 1.92,
                     order: Sequence[str] = ("row",)) -> DataFrame:
    """Ground truth from time-series rows ``trial_id, row, limb, touchdown_s, stride_cm, position`` (position is text).

    Rows without a positive touchdown time and stride are dropped; ``print_id`` numbers the rows that are kept.
    """
    xy = fm.parse_xy(F.col("position"))
    place = (lambda c: xy[c]) if unit == "px" else (lambda c: fm.cm_to_px(xy[c], px_per_mm))
    d = rows.where("touchdown_s > 0 and stride_cm > 0") if drop_invalid else rows
    d = ordered.number_rows(d, ["trial_id"], list(order), F.floor(F.col(order[0]) / ordered.CHUNK), name="print_id")
    return d.select("trial_id", "print_id", fm.time_to_frame(F.col("touchdown_s"), fps).alias("frame_idx"), place("x").alias("cx_px"),
                    place("y").alias("cy_px"), F.trim("limb").alias("paw_id"))


def read_truth_sheet(spark: SparkSession, path: str | Sequence[str], **kw) -> DataFrame:
    """:func:`truth_from_sheet` on CSV copies of the commercial time-series sheet."""
    d = spark.read.option("header", "true").csv(path)
    find = lambda part: next(c for c in d.columns if part in c)
    rows = d.select(stem(F.col("_metadata.file_path")).alias("trial_id"), F.monotonically_increasing_id().alias("row"),
                    F.col(f"`{next(c for c in d.columns if c.strip() == SHEET_LIMB)}`").alias("limb"),
                    F.col(f"`{find(SHEET_TOUCHDOWN)}`").try_cast("double").alias("touchdown_s"),
                    F.coalesce(F.col(f"`{find(SHEET_STRIDE)}`").try_cast("double"), F.lit(0.0)).alias("stride_cm"),
                    F.col(f"`{find(SHEET_POSITION)}`").alias("position"))
    return truth_from_sheet(rows, **kw)


def read_pressure_sheet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Per-frame pressure sheets (CSV copies) to ``trial_id, frame, limb, measure, value``."""
    d = spark.read.option("header", "true").csv(path)
    frame, *cols = d.columns
    rows = []
    for c in cols:
        name = c.strip()
        limb = next((x for x in LIMBS if name.startswith(x)), None)
        kind = PRESSURE_KINDS.get(name[len(limb):].strip("_ ")) if limb else None
        if kind:
            rows.append(F.struct(F.lit(limb).alias("limb"), F.lit(kind).alias("measure"), F.col(f"`{c}`").try_cast("double").alias("value")))
    return d.select(stem(F.col("_metadata.file_path")).alias("trial_id"), F.col(f"`{frame}`").try_cast("int").alias("frame"),
                    F.explode(F.array(*rows)).alias("r")).select("trial_id", "frame", "r.*")


def read_body_boxes(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Space-separated body boxes with ``#`` comments: frame, tight box, expanded box, area."""
    d = _lines(spark, path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    cells = F.split(F.trim("value"), r"\s+")
    names = [n for n in BODY_ROI.fieldNames() if n != "trial_id"]
    return d.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("trial_id"), *[cells[i].cast("int").alias(n) for i, n in enumerate(names)])


# Event keys with aliases, first present wins.
_EVENT = ("event string, stage string, epoch int, frame int, current int, total_epochs int, total_frames int, total int, loss double, "
          "config_path string, output_dir string, metrics map<string,string>, message string, exit_code int")


def tracker_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Events among the log lines of a tracker: lines that start with ``{`` and parse. Works on batches and streams.

    ``fraction`` is progress over the total; only numeric metrics are kept.
    """
    j = F.from_json(F.trim(value), _EVENT, {"mode": "PERMISSIVE"})
    d = lines.where(F.trim(value).startswith("{")).withColumn("_e", j).where("_e.event is not null")
    e = lambda n: F.col(f"_e.{n}")
    now = F.coalesce(e("epoch"), e("frame"), e("current"), F.lit(0))
    total = F.coalesce(e("total_epochs"), e("total_frames"), e("total"), F.lit(1))
    numbers = F.map_filter(F.transform_values(e("metrics"), lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())
    rest = [c for c in lines.columns if c != value]
    return d.select(*rest, e("event").alias("event"), F.coalesce(e("stage"), F.lit("")).alias("stage"), now.alias("current"), total.alias("total"),
                    (now / F.greatest(total, F.lit(1))).alias("fraction"), e("loss").alias("loss"), e("config_path").alias("config_path"),
                    e("output_dir").alias("output_dir"), numbers.alias("metrics"), e("message").alias("message"), e("exit_code").alias("exit_code"))
