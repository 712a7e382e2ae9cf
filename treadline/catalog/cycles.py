"""Contact cycles on lineitem: one track per part, frames in order of (order, line)."""
from __future__ import annotations

from pyspark.sql import functions as F

from treadline.catalog import views as v
from treadline.catalog.registry import query
from treadline.operators import cycles, matching, ordered, tracking
from treadline.plans import analyze

DET = v.TRACKS + """,
det AS (SELECT trial_id, track_id, frame, area_px, mean_intensity, dx * 10.0::DOUBLE + area_px AS cx, dy * 10.0::DOUBLE + mean_intensity AS cy,
   dx AS x1, dy AS y1, dx + area_px % 7 + 1 AS x2, dy + area_px % 5 + 1 AS y2 FROM tracks)"""
KEYS = ["trial_id", "track_id"]


def det(spark, sf_dir):
    t = v.tracks(spark, sf_dir)
    return t.select("trial_id", "track_id", "frame", "area_px", "mean_intensity",
                    (F.col("dx") * 10.0 + F.col("area_px")).alias("cx"), (F.col("dy") * 10.0 + F.col("mean_intensity")).alias("cy"),
                    F.col("dx").alias("x1"), F.col("dy").alias("y1"), (F.col("dx") + F.col("area_px") % 7 + 1).alias("x2"),
                    (F.col("dy") + F.col("area_px") % 5 + 1).alias("y2"))


CYC = DET + """,
mx AS (SELECT *, max(mean_intensity) OVER (PARTITION BY trial_id, track_id) AS top FROM det),
cyc AS (SELECT trial_id, track_id, count(*) AS n, min(frame) AS td, max(frame) AS lo,
   arg_max(frame, area_px * 100000::BIGINT - frame) AS pa, arg_max(frame, CAST(mean_intensity AS BIGINT) * 100000 - frame) AS pi,
   coalesce(max(CASE WHEN mean_intensity >= 6 THEN frame END), min(frame)) AS tl, count(*) FILTER (mean_intensity >= 0.8::DOUBLE * top) AS wb,
   max(area_px) AS ma, max(mean_intensity) AS pp, arg_max(cx, area_px * 100000::BIGINT - frame) AS pcx, arg_max(cy, area_px * 100000::BIGINT - frame) AS pcy,
   arg_max(y2 - y1, area_px * 100000::BIGINT - frame) AS len, arg_max(x2 - x1, area_px * 100000::BIGINT - frame) AS wid,
   arg_max(mean_intensity, area_px * 100000::BIGINT - frame) AS mp, arg_min(mean_intensity, frame) AS ti, arg_max(mean_intensity, frame) AS li
  FROM mx GROUP BY trial_id, track_id HAVING count(*) >= 2)"""


def _cycle_sql(stop, peak):
    return f"""WITH {CYC}
SELECT trial_id, track_id, CAST(n AS INTEGER) AS n_frames, td AS touchdown_frame, lo AS liftoff_frame, tl AS true_liftoff_frame, pa AS peak_area_frame,
 pi AS peak_intensity_frame, ({stop} - td) / 60.0::DOUBLE AS duration_s, ({peak} - td) / 60.0::DOUBLE AS loading_duration_s,
 wb / 60.0::DOUBLE AS weight_bearing_duration_s, ({stop} - {peak}) / 60.0::DOUBLE AS unloading_duration_s, ma AS max_area_px,
 ma / (1.92::DOUBLE * 1.92::DOUBLE) AS max_area_mm2, pcx / 1.92::DOUBLE AS peak_centroid_x_mm, pcy / 1.92::DOUBLE AS peak_centroid_y_mm,
 len / 1.92::DOUBLE AS print_length_mm, wid / 1.92::DOUBLE AS print_width_mm, mp AS mean_pressure_at_peak, pp AS peak_pressure,
 mp * (ma / (1.92::DOUBLE * 1.92::DOUBLE)) AS stand_index, mp / (ma / (1.92::DOUBLE * 1.92::DOUBLE)) AS pressure_area_ratio,
 ti AS touchdown_intensity, li AS liftoff_intensity, li < 3 AS is_clean_liftoff FROM cyc"""


@query("contact_cycles", _cycle_sql("tl", "pi"))
def _(spark, sf_dir):
    return cycles.build_cycles(det(spark, sf_dir), ["trial_id"], size=v.SIZE)


@query("contact_cycles_area", _cycle_sql("lo", "pa"))
def _(spark, sf_dir):
    return cycles.build_cycles(det(spark, sf_dir), ["trial_id"], loading_to="area", size=v.SIZE)


@query("cycle_numbers", f"""WITH {CYC}
SELECT trial_id, track_id, td AS touchdown_frame, CAST(row_number() OVER (PARTITION BY trial_id ORDER BY td, track_id) AS INTEGER) AS cycle_id FROM cyc""")
def _(spark, sf_dir):
    c = cycles.build_cycles(det(spark, sf_dir), ["trial_id"], size=v.SIZE).select("trial_id", "track_id", "touchdown_frame")
    return cycles.number_cycles(c, ["trial_id"], size=v.SIZE)


@query("cycle_frame_records", f"""WITH {DET}
SELECT trial_id, track_id, frame, frame / 60.0::DOUBLE AS time_s, area_px / (1.92::DOUBLE * 1.92::DOUBLE) AS area_mm2, cx / 1.92::DOUBLE AS centroid_x_mm,
 cy / 1.92::DOUBLE AS centroid_y_mm FROM det""")
def _(spark, sf_dir):
    return cycles.frame_records(det(spark, sf_dir)).select(
        "trial_id", "track_id", "frame", "time_s", "area_mm2", "centroid_x_mm", "centroid_y_mm")


@query("pressure_centre_path", f"""WITH {DET},
l AS (SELECT *, sqrt((cx - lag(cx) OVER w) * (cx - lag(cx) OVER w) + (cy - lag(cy) OVER w) * (cy - lag(cy) OVER w)) AS d FROM det
  WINDOW w AS (PARTITION BY trial_id, track_id ORDER BY frame))
SELECT trial_id, track_id, round(coalesce(sum(d / 1.92::DOUBLE), 0.0), 6) AS cop_path_length_mm,
 round(sqrt(pow(arg_max(cx, frame) - arg_min(cx, frame), 2) + pow(arg_max(cy, frame) - arg_min(cy, frame), 2)) / 1.92::DOUBLE, 6) AS cop_displacement_mm
FROM l GROUP BY trial_id, track_id""")
def _(spark, sf_dir):
    d = cycles.pressure_centre_path(det(spark, sf_dir), ["trial_id"], size=v.SIZE)
    return d.select("trial_id", "track_id", F.round("cop_path_length_mm", 6).alias("cop_path_length_mm"),
                    F.round("cop_displacement_mm", 6).alias("cop_displacement_mm"))


@query("trim_range", f"""WITH {DET}
SELECT t.trial_id, coalesce(min(frame), 0) AS first_frame, coalesce(max(frame), -1) AS last_frame
FROM (SELECT DISTINCT p_partkey % 11 AS trial_id FROM part) t LEFT JOIN det USING (trial_id) GROUP BY t.trial_id""")
def _(spark, sf_dir):
    # Ten trials have tracks, the eleventh has none.
    trials = v.table(spark, sf_dir, "part").select((F.col("p_partkey") % 11).alias("trial_id"))
    return cycles.trim_range(det(spark, sf_dir), trials, ["trial_id"])


@query("print_curves", f"""WITH {DET}
SELECT trial_id, track_id, 0 AS part, list(frame ORDER BY frame) AS frames, list(mean_intensity ORDER BY frame) AS pressure_curve,
 list(area_px ORDER BY frame) AS area_curve FROM det GROUP BY trial_id, track_id""")
def _(spark, sf_dir):
    return cycles.print_curves(det(spark, sf_dir), ["trial_id"])


# Each detection covers a small block of pixels placed by its box.
MASK = DET + """,
mask AS (SELECT trial_id, track_id, frame, x1 + i % (x2 - x1) AS x, y1 + i // (x2 - x1) AS y, mean_intensity - i AS delta
  FROM det, unnest(range(0, (x2 - x1) * (y2 - y1))) AS u(i))"""


def mask(spark, sf_dir, d=None):
    # Dealt by track before the boxes become pixels, so that unions per track need no shuffle of pixel rows.
    d = (det(spark, sf_dir) if d is None else d).repartition(*KEYS).withColumn("i", F.expr("explode(sequence(0, (x2 - x1) * (y2 - y1) - 1))"))
    return d.select("trial_id", "track_id", "frame", F.expr("x1 + i % (x2 - x1)").alias("x"),
                    F.expr("y1 + cast(floor(i / (x2 - x1)) as int)").alias("y"), (F.col("mean_intensity") - F.col("i")).alias("delta"))


@query("track_geometry_comparison", f"""WITH {MASK},
u AS (SELECT trial_id, track_id, count(DISTINCT (x, y)) AS union_area_px, max(x) - min(x) + 1 AS union_width, max(y) - min(y) + 1 AS union_height
      FROM mask GROUP BY trial_id, track_id),
p AS (SELECT trial_id, track_id, max(area_px) AS peak_area_px, arg_max(x2 - x1, area_px * 100000::BIGINT - frame) AS peak_width,
      arg_max(y2 - y1, area_px * 100000::BIGINT - frame) AS peak_height FROM det GROUP BY trial_id, track_id)
SELECT trial_id, track_id, peak_area_px, CAST(peak_width AS INTEGER) AS peak_width, CAST(peak_height AS INTEGER) AS peak_height, union_area_px,
 CAST(union_width AS INTEGER) AS union_width, CAST(union_height AS INTEGER) AS union_height FROM p JOIN u USING (trial_id, track_id)""")
def _(spark, sf_dir):
    return cycles.geometry_comparison(det(spark, sf_dir), mask(spark, sf_dir), ["trial_id"])


@query("union_projection", f"""WITH {MASK}
SELECT trial_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, max(greatest(delta, 0)) AS max_intensity, count(DISTINCT track_id) AS n_tracks
FROM mask GROUP BY trial_id, x, y""")
def _(spark, sf_dir):
    from treadline.operators import pixels
    return pixels.union_projection(mask(spark, sf_dir), ["trial_id"], "track_id", "delta")


@query("track_pixels", f"""WITH {MASK} SELECT DISTINCT trial_id, track_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM mask""")
def _(spark, sf_dir):
    from treadline.operators import pixels
    return pixels.track_pixels(mask(spark, sf_dir), ["trial_id"], "track_id")


@query("peak_composite", f"""WITH {MASK},
p AS (SELECT trial_id, track_id, arg_max(frame, area_px * 100000::BIGINT - frame) AS pf FROM det GROUP BY trial_id, track_id)
SELECT trial_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, sum(delta) / count(*) AS mean_score, count(DISTINCT track_id) AS n_tracks
FROM mask JOIN p USING (trial_id, track_id) WHERE frame = pf GROUP BY trial_id, x, y""")
def _(spark, sf_dir):
    from treadline.operators import pixels
    d = det(spark, sf_dir)
    peaks = d.groupBy(*KEYS).agg(F.max_by("frame", F.struct("area_px", -F.col("frame"))).alias("peak_area_frame"))
    # Only the detections of the peak frames become pixels.
    top = d.join(peaks.select(*KEYS, F.col("peak_area_frame").alias("frame")), [*KEYS, "frame"], "left_semi")
    return pixels.peak_composite(mask(spark, sf_dir, top), peaks, ["trial_id"], "track_id", "delta")


@query("detection_statistics", f"""WITH {MASK}
SELECT trial_id, track_id, frame, CAST(count(*) AS INTEGER) AS area_px, CAST(min(x) AS INTEGER) AS x1, CAST(min(y) AS INTEGER) AS y1,
 CAST(max(x) AS INTEGER) AS x2, CAST(max(y) AS INTEGER) AS y2, sum(x) / count(*)::DOUBLE AS cx, sum(y) / count(*)::DOUBLE AS cy,
 sum(delta) / count(*) AS mean_intensity, max(delta) AS peak_intensity, round(avg(18 * pow(greatest(delta - 8, 0), 0.75)), 6) AS mean_pressure,
 round(max(18 * pow(greatest(delta - 8, 0), 0.75)), 6) AS peak_pressure, min(x) <= 1 OR min(y) <= 1 OR max(x) >= 15 OR max(y) >= 11 AS touches_edge
FROM mask GROUP BY trial_id, track_id, frame HAVING count(*) >= 5""")
def _(spark, sf_dir):
    from treadline.operators import pixels
    d = pixels.detection_statistics(mask(spark, sf_dir), ["trial_id", "track_id", "frame"], "delta", 16, 12)
    return d.withColumns({"mean_pressure": F.round("mean_pressure", 6), "peak_pressure": F.round("peak_pressure", 6)})


@query("masked_intensity", f"""WITH {MASK}
SELECT trial_id, track_id, frame, count(*) FILTER (delta % 2 = 0) AS area_px,
 coalesce(sum(CASE WHEN delta % 2 = 0 THEN greatest(delta, 0) END) / count(*) FILTER (delta % 2 = 0), 0.0) AS mean_intensity,
 CASE WHEN count(*) FILTER (delta % 2 = 0) > 0 THEN max(greatest(delta, 0)) ELSE 0.0 END AS peak_intensity
FROM mask GROUP BY trial_id, track_id, frame""")
def _(spark, sf_dir):
    from treadline.operators import pixels
    d = mask(spark, sf_dir).withColumn("in_mask", F.col("delta") % 2 == 0)
    return pixels.masked_intensity(d, ["trial_id", "track_id", "frame"], "delta")


# Ground truth and predictions: quantity 10 or less is truth, more is prediction; frames by ship week.
EVAL = """
ev AS (SELECT l_suppkey % 25 AS trial_id, CAST(datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS frame,
   l_extendedprice / 100 AS cx, l_discount * 1000 AS cy, l_quantity AS q,
   row_number() OVER (PARTITION BY l_suppkey % 25 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS rid,
   CASE CAST(l_quantity AS INTEGER) % 4 WHEN 0 THEN 'LF' WHEN 1 THEN 'RF' WHEN 2 THEN 'LH' ELSE 'RH' END AS paw FROM lineitem),
gt AS (SELECT trial_id, rid AS print_id, frame AS frame_idx, cx AS cx_px, cy AS cy_px, paw AS paw_id FROM ev WHERE q <= 10),
pred AS (SELECT trial_id, rid AS pred_id, frame AS frame_idx, cx, cy, paw AS paw_id FROM ev WHERE q > 10)"""


def numbered(li):
    """Row ids per trial in order of (order, line, part, supplier)."""
    return ordered.number_rows(li, ["trial_id"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                               F.floor(F.col("l_orderkey") / 65536), name="rid")


def eval_rows(spark, sf_dir, ids=True):
    """Truth and predictions; without ``ids`` rows are not numbered, and the ids are null."""
    li = v.table(spark, sf_dir, "lineitem")
    li = li.select((F.col("l_suppkey") % 25).alias("trial_id"), F.datediff("l_shipdate", F.lit("1992-01-01")).alias("frame"),
                   (F.col("l_extendedprice") / 100).alias("cx"), (F.col("l_discount") * 1000).alias("cy"), F.col("l_quantity").alias("q"),
                   F.element_at(F.array(*[F.lit(x) for x in ("LF", "RF", "LH", "RH")]), F.col("l_quantity").cast("int") % 4 + 1).alias("paw"),
                   "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    li = numbered(li) if ids else li.withColumn("rid", F.lit(None).cast("int"))
    gt = li.where("q <= 10").select("trial_id", F.col("rid").cast("long").alias("print_id"), F.col("frame").alias("frame_idx"),
                                    F.col("cx").alias("cx_px"), F.col("cy").alias("cy_px"), F.col("paw").alias("paw_id"))
    pred = li.where("q > 10").select("trial_id", F.col("rid").cast("long").alias("pred_id"), F.col("frame").alias("frame_idx"),
                                     "cx", "cy", F.col("paw").alias("paw_id"))
    return gt, pred


@query("truth_recall", f"""WITH {EVAL},
h AS (SELECT g.trial_id, g.print_id, bool_or(p.pred_id IS NOT NULL) AS hit FROM gt g LEFT JOIN pred p ON g.trial_id = p.trial_id AND g.frame_idx = p.frame_idx
   AND sqrt((g.cx_px - p.cx) * (g.cx_px - p.cx) + (g.cy_px - p.cy) * (g.cy_px - p.cy)) <= 30 GROUP BY g.trial_id, g.print_id)
SELECT t.trial_id, coalesce(count(*) FILTER (hit) / nullif(count(hit), 0)::DOUBLE, 1.0) AS recall FROM (SELECT DISTINCT trial_id FROM pred) t
LEFT JOIN h USING (trial_id) GROUP BY t.trial_id""")
def _(spark, sf_dir):
    gt, pred = eval_rows(spark, sf_dir, ids=False)
    flags = matching.recalled(gt.select("trial_id", F.col("frame_idx").alias("frame"), F.col("cx_px").alias("x"), F.col("cy_px").alias("y")),
                              pred.select("trial_id", F.col("frame_idx").alias("frame"), "cx", "cy"), 30.0)
    return matching.recall(flags, pred, ["trial_id"])


@query("largest_blob_near_truth", f"""WITH {EVAL},
b AS (SELECT trial_id, frame, CAST(max(q) AS INTEGER) AS area FROM ev WHERE q > 10 GROUP BY trial_id, frame),
j AS (SELECT g.trial_id, g.print_id, g.frame_idx, b.frame, b.area FROM gt g LEFT JOIN b ON b.trial_id = g.trial_id AND b.frame BETWEEN g.frame_idx - 3 AND g.frame_idx + 3)
SELECT trial_id, print_id, frame_idx, CASE WHEN count(area) = 0 THEN 'missed' ELSE 'matched' END AS status,
 arg_max(frame, area * 100000::BIGINT - frame) AS match_frame, max(area) AS area_px FROM j GROUP BY trial_id, print_id, frame_idx""")
def _(spark, sf_dir):
    gt, _p = eval_rows(spark, sf_dir)
    li = v.table(spark, sf_dir, "lineitem").where("l_quantity > 10")
    blobs = li.select((F.col("l_suppkey") % 25).alias("trial_id"), F.datediff("l_shipdate", F.lit("1992-01-01")).alias("frame"),
                      F.col("l_quantity").cast("int").alias("area_px"))
    return matching.largest_near(gt, blobs, ["trial_id"])


@query("nearest_track_to_truth", f"""WITH {EVAL},
b AS (SELECT l_suppkey % 25 AS trial_id, l_partkey AS track_id, CAST(datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS frame,
   CAST(l_quantity AS INTEGER) AS area FROM lineitem WHERE l_quantity > 10),
c AS (SELECT g.trial_id, g.print_id, g.frame_idx, b.track_id, min(abs(b.frame - g.frame_idx)) AS gap FROM gt g JOIN b ON b.trial_id = g.trial_id
   AND b.frame BETWEEN g.frame_idx - 5 AND g.frame_idx + 5 GROUP BY ALL),
best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY trial_id, print_id ORDER BY gap, track_id) = 1),
top AS (SELECT trial_id, track_id, arg_max(frame, area * 100000::BIGINT - frame) AS tf, max(area) AS ta FROM b GROUP BY trial_id, track_id),
here AS (SELECT trial_id, track_id, frame, max(area) AS ha FROM b GROUP BY trial_id, track_id, frame)
SELECT best.trial_id, print_id, frame_idx, best.track_id, gap AS frame_gap, CASE WHEN ha IS NULL THEN tf ELSE frame_idx END AS blob_frame,
 coalesce(ha, ta) AS area_px FROM best JOIN top USING (trial_id, track_id)
 LEFT JOIN here ON here.trial_id = best.trial_id AND here.track_id = best.track_id AND here.frame = frame_idx""")
def _(spark, sf_dir):
    gt, _p = eval_rows(spark, sf_dir)
    li = v.table(spark, sf_dir, "lineitem").where("l_quantity > 10")
    blobs = li.select((F.col("l_suppkey") % 25).alias("trial_id"), F.col("l_partkey").alias("track_id"),
                      F.datediff("l_shipdate", F.lit("1992-01-01")).alias("frame"), F.col("l_quantity").cast("int").alias("area_px"))
    return matching.nearest_track(gt, blobs, ["trial_id"])


@query("prediction_matches")
def _(spark, sf_dir):
    gt, pred = eval_rows(spark, sf_dir)
    return matching.match_predictions(pred.drop("paw_id"), gt, ["trial_id"])


@query("detector_evaluation")
def _(spark, sf_dir):
    gt, pred = eval_rows(spark, sf_dir)
    m = matching.match_predictions(pred, gt, ["trial_id"], same_limb=True)
    return matching.evaluate(m, pred, gt, ["trial_id"])


@query("detector_evaluation_time_only")
def _(spark, sf_dir):
    gt, pred = eval_rows(spark, sf_dir)
    m = matching.match_predictions(pred, gt, ["trial_id"], spatial=False, frame_tolerance=2)
    return matching.evaluate(m, pred, gt, ["trial_id"])


@query("closest_area_blob", f"""WITH {EVAL},
b AS (SELECT trial_id, frame, rid, q, CAST(q AS INTEGER) AS area FROM ev WHERE q > 10),
j AS (SELECT g.trial_id, g.frame_idx, g.print_id, b.rid, area / greatest(10 + g.print_id % 20, 1)::DOUBLE AS r FROM gt g JOIN b ON b.trial_id = g.trial_id AND b.frame = g.frame_idx),
k AS (SELECT *, abs(ln(r)) AS d FROM j WHERE r > 0.3 AND r < 4)
SELECT trial_id, frame_idx AS frame, print_id, rid AS label, round(d, 9) AS log_ratio FROM k QUALIFY row_number() OVER (PARTITION BY trial_id, print_id ORDER BY round(d, 12), rid) = 1""")
def _(spark, sf_dir):
    gt, _p = eval_rows(spark, sf_dir)
    truth = gt.select("trial_id", F.col("frame_idx").alias("frame"), "print_id", (F.lit(10) + F.col("print_id") % 20).alias("gt_area"))
    li = v.table(spark, sf_dir, "lineitem").withColumn("trial_id", F.col("l_suppkey") % 25)
    li = numbered(li).where("l_quantity > 10")
    blobs = li.select("trial_id", F.datediff("l_shipdate", F.lit("1992-01-01")).alias("frame"),
                      F.col("rid").cast("long").alias("label"), F.col("l_quantity").cast("int").alias("area_px"))
    d = matching.closest_area(truth, blobs, ["trial_id", "frame"])
    return d.withColumn("log_ratio", F.round("log_ratio", 9))


@query("track_predictions", f"""WITH {DET}
SELECT trial_id, track_id, arg_max(frame, area_px * 100000::BIGINT - frame) AS frame_idx, median(cx) AS cx, median(cy) AS cy, count(*) AS n_strong
FROM det GROUP BY trial_id, track_id""")
def _(spark, sf_dir):
    return tracking.track_predictions(det(spark, sf_dir), ["trial_id"])


@query("iou_tracks")
def _(spark, sf_dir):
    d = det(spark, sf_dir).withColumn("det_id", F.col("track_id").cast("int"))
    m = d.withColumn("mask", F.expr("transform(sequence(0, (x2 - x1) * (y2 - y1) - 1), i -> cast((y1 + floor(i / (x2 - x1))) * 1920 + x1 + i % (x2 - x1) as int))"))
    # Half of the frames of a part are kept apart, so that tracks do end.
    m = m.withColumn("frame", (F.col("frame") / 2 + F.floor(F.col("frame") / 16) * 6).cast("int")).withColumn("trial_id", F.col("track_id") % 97)
    return tracking.link_by_iou(m, ["trial_id"], size=v.SIZE)


# Masks of a part lie apart from those of others, so a track is a stretch of a part without more than 3 empty frames.
PLAN = DET + """,
moved AS (SELECT * REPLACE (frame + frame // 16 * 6 AS frame) FROM det WHERE area_px >= 5),
gated AS (SELECT * FROM moved WHERE frame % 2 = 1 OR NOT (x2 <= 2 OR x1 >= 40 OR y2 <= 2 OR y1 >= 40)),
cut AS (SELECT *, CASE WHEN frame - lag(frame) OVER w <= 3 THEN 0 ELSE 1 END AS new FROM gated WINDOW w AS (PARTITION BY trial_id, track_id ORDER BY frame)),
piece AS (SELECT *, sum(new) OVER (PARTITION BY trial_id, track_id ORDER BY frame) AS p FROM cut),
linked AS (SELECT *, min(frame) OVER (PARTITION BY trial_id, track_id, p) AS f0 FROM piece),
named AS (SELECT *, dense_rank() OVER (PARTITION BY trial_id ORDER BY f0, track_id) - 1 AS t,
  sqrt(pow(cx - lag(cx) OVER w, 2) + pow(cy - lag(cy) OVER w, 2)) AS d FROM linked WINDOW w AS (PARTITION BY trial_id, track_id, p ORDER BY frame)),
cyc AS (SELECT trial_id, t, count(*) AS n, min(frame) AS td, max(frame) AS lo, max(area_px) AS ma, max(mean_intensity) AS pp,
  arg_max(frame, area_px * 100000::BIGINT - frame) AS pa, coalesce(sum(d), 0) / 1.92::DOUBLE AS path FROM named GROUP BY trial_id, t HAVING count(*) >= 2)"""


@query("detection_cycles", f"""WITH {PLAN}
SELECT trial_id, CAST(t AS INTEGER) AS track_id, CAST(row_number() OVER (PARTITION BY trial_id ORDER BY td, t) AS INTEGER) AS cycle_id, CAST(n AS INTEGER) AS n_frames,
 td AS touchdown_frame, lo AS liftoff_frame, pa AS peak_area_frame, ma AS max_area_px, pp AS peak_pressure, round(path, 6) AS cop_path_length_mm, n AS n_records FROM cyc""")
def _(spark, sf_dir):
    d = det(spark, sf_dir).withColumns({"frame": F.expr("cast(frame + floor(frame / 16) * 6 as int)"), "det_id": F.col("track_id").cast("int"),
                                        "mask": F.expr("transform(sequence(0, 3), i -> cast(track_id * 4 + i as int))")}).drop("track_id")
    roi = d.where("frame % 2 = 0").select("trial_id", "frame", *[F.lit(n).alias(c) for c, n in (("ex1", 2), ("ey1", 2), ("ex2", 40), ("ey2", 40))]).distinct()
    out = analyze.cycles_from_detections(d, roi, 60.0, 1.92, size=v.SIZE)
    records = out["cycle_frame"].groupBy("trial_id", "track_id").agg(F.count(F.lit(1)).alias("n_records"))
    c = out["cycle"].join(records, KEYS)
    return c.select("trial_id", "track_id", "cycle_id", "n_frames", "touchdown_frame", "liftoff_frame", "peak_area_frame", "max_area_px", "peak_pressure",
                    F.round("cop_path_length_mm", 6).alias("cop_path_length_mm"), "n_records")


@query("centroid_tracks")
def _(spark, sf_dir):
    d = det(spark, sf_dir).select((F.col("track_id") % 97).alias("trial_id"), F.col("track_id").cast("int").alias("det_id"),
                                  (F.col("frame") / 2 + F.floor(F.col("frame") / 16) * 6).cast("int").alias("frame"), "cx", "cy", "area_px")
    strong = tracking.link_by_centroid(d.where("area_px >= 20"), ["trial_id"], size=v.SIZE)
    weak = tracking.attach_weak(strong, d.where("area_px < 20"), ["trial_id"])
    return tracking.two_level_summary(strong, weak, ["trial_id"])


@query("merged_tracks")
def _(spark, sf_dir):
    d = det(spark, sf_dir).select((F.col("track_id") % 97).alias("trial_id"), F.col("track_id"), F.floor(F.col("frame") / 8).alias("piece"),
                                  (F.col("frame") / 2).cast("int").alias("frame"), "cx", "cy", "area_px")
    blobs = d.select("trial_id", (F.col("track_id") * 1000 + F.col("piece")).alias("track_id"), "frame", "cx", "cy", "area_px",
                     (F.col("area_px") > 5).alias("is_strong"))
    return tracking.merge_tracks(blobs, ["trial_id"], max_distance=60.0)
