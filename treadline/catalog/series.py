"""Filters, moving statistics, pixel tables and camera timing on the events table."""
from __future__ import annotations

from pyspark.sql import functions as F

from treadline.catalog import views as v
from treadline.catalog.registry import query
from treadline.functions import geometry as geo
from treadline.operators import contact, matching, ordered, pixels, series, sync

W = "OVER (PARTITION BY trial_id ORDER BY frame"


@query("median_filter", f"""WITH {v.SAMPLES}
SELECT trial_id, frame, median(x) {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS x FROM samples""")
def _(spark, sf_dir):
    return series.median_filter(v.samples(spark, sf_dir), v.TRIAL, ["x"], 5, size=v.SIZE).select("trial_id", "frame", "x")


@query("jump_rejection", f"""WITH {v.SAMPLES},
j AS (SELECT trial_id, frame, CASE WHEN abs(x - lag(x) {W})) > 4000 THEN NULL ELSE x END AS x FROM samples),
n AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN frame END) {W}) AS pf, min(CASE WHEN x IS NOT NULL THEN frame END) {W}
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nf FROM j)
SELECT n.trial_id, n.frame, CASE WHEN n.x IS NOT NULL THEN n.x WHEN pf IS NOT NULL AND nf IS NOT NULL
  THEN p.x + (q.x - p.x) * (n.frame - pf) / (nf - pf) ELSE coalesce(p.x, q.x) END AS x FROM n
LEFT JOIN j p ON p.trial_id = n.trial_id AND p.frame = pf LEFT JOIN j q ON q.trial_id = n.trial_id AND q.frame = nf""")
def _(spark, sf_dir):
    return series.reject_jumps(v.samples(spark, sf_dir), v.TRIAL, ["x"], 4000.0, size=v.SIZE).select("trial_id", "frame", "x")


@query("laplacian_smoothing", f"""WITH {v.SAMPLES},
a AS (SELECT trial_id, frame, coalesce(x + 0.25::DOUBLE * (lag(x) {W}) - 2 * x + lead(x) {W})), x) AS x FROM samples),
b AS (SELECT trial_id, frame, coalesce(x + 0.25::DOUBLE * (lag(x) {W}) - 2 * x + lead(x) {W})), x) AS x FROM a)
SELECT * FROM b""")
def _(spark, sf_dir):
    d = v.samples(spark, sf_dir).select("trial_id", "frame", "x")
    return series.smooth(d, v.TRIAL, ["x"], 0.25, passes=2, size=v.SIZE)


PIXEL = v.SAMPLES + """,
px AS (SELECT k % 10 AS x, k // 10 AS y, CAST(row_number() OVER (PARTITION BY k ORDER BY ts, event_id) - 1 AS INTEGER) AS frame,
  CAST(x AS BIGINT) % 256 AS g, CAST(x AS BIGINT) % 199 AS r, CAST(x AS BIGINT) % 101 AS b, trial_id FROM samples)"""
PX = "OVER (PARTITION BY x, y ORDER BY frame"


def pixel_series(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").select(
        "ts", "event_id", F.col("user_id").alias("trial_id"), F.round(F.col("value") * 100).cast("long").alias("val"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    e = ordered.number_rows(e, ["k"], ["ts", "event_id"], F.date_trunc("minute", F.col("ts")))
    return e.select((F.col("k") % 10).alias("x"), F.floor(F.col("k") / 10).cast("int").alias("y"), "frame",
                    (F.col("val") % 256).alias("g"), (F.col("val") % 199).alias("r"), (F.col("val") % 101).alias("b"), "trial_id")


@query("rolling_background", f"""WITH {PIXEL},
m AS (SELECT x, y, frame, g, CASE WHEN frame >= 1 AND (frame < 30 OR (frame + 1) % 5 = 0) THEN median(g) {PX} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS m FROM px)
SELECT x, y, frame, last_value(m IGNORE NULLS) {PX} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS background FROM m""")
def _(spark, sf_dir):
    d = series.rolling_background(pixel_series(spark, sf_dir), ["x", "y"], "g", size=max(v.SIZE, 64))
    return d.select("x", "y", "frame", "background")


@query("channel_background", f"""WITH {PIXEL},
m AS (SELECT x, y, frame, {', '.join(f"CASE WHEN frame >= 4 THEN CAST(floor(median({c}) {PX} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) AS INTEGER) END AS bg_{c}, {c}" for c in 'bgr')} FROM px)
SELECT x, y, frame, bg_b, bg_g, bg_r, CASE WHEN bg_b IS NOT NULL THEN greatest(abs(b - bg_b), abs(g - bg_g), abs(r - bg_r)) > 90 END AS foreground FROM m""")
def _(spark, sf_dir):
    d = series.channel_background(pixel_series(spark, sf_dir), ["x", "y"], ["b", "g", "r"], offset=90, size=max(v.SIZE, 32))
    return d.select("x", "y", "frame", "bg_b", "bg_g", "bg_r", "foreground")


BG = PIXEL + """,
bg AS (SELECT x, y, median(g) AS bg_g, median(r) AS bg_r FROM px GROUP BY x, y),
fg AS (SELECT px.*, bg_g, bg_r FROM px JOIN bg USING (x, y))"""


def with_background(spark, sf_dir):
    p = pixel_series(spark, sf_dir)
    return pixels.against_background(p, pixels.median_background(p, ["x", "y"], ["g", "r"]), ["x", "y"])


@query("median_background", f"WITH {BG} SELECT * FROM bg")
def _(spark, sf_dir):
    return pixels.median_background(pixel_series(spark, sf_dir), ["x", "y"], ["g", "r"])


@query("warmup_background", f"WITH {PIXEL} SELECT x, y, median(g) AS bg_g FROM px WHERE frame <= 30 GROUP BY x, y")
def _(spark, sf_dir):
    return pixels.median_background(pixel_series(spark, sf_dir), ["x", "y"], ["g"], first_frames=30)


@query("contact_and_body_pixels", f"""WITH {BG}
SELECT x, y, frame, g - bg_g > 12 AS contact, bg_r - r > 40 AS body, bg_g - g >= 5 AS dark, bg_r - r > 40 AND g > 12 AS strict FROM fg""")
def _(spark, sf_dir):
    return with_background(spark, sf_dir).select(
        "x", "y", "frame", pixels.contact_pixels().alias("contact"), pixels.body_pixels().alias("body"),
        pixels.dark_pixels().alias("dark"), pixels.strict_contact_pixels().alias("strict"))


def blob_sql(keys: str, extra: str = "") -> str:
    """``blobs`` of the pixels ``c``: every pixel takes the first pixel, in scan order, that it is connected to; labels count those."""
    same = " AND ".join(f"c.{k} = r.{k}" for k in keys.split(", "))
    own = ", ".join(f"c.{k}" for k in keys.split(", "))
    return f"""r AS (SELECT {keys}, x, y, y * 1000 + x AS root FROM c
  UNION SELECT {own}, c.x, c.y, r.root FROM r JOIN c ON {same} AND abs(c.x - r.x) <= 1 AND abs(c.y - r.y) <= 1 AND r.root < c.y * 1000 + c.x),
first AS (SELECT {keys}, x, y, min(root) AS root FROM r GROUP BY ALL),
blobs AS (SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY root) AS INTEGER) AS label, CAST(count(*) AS INTEGER) AS area_px,
  min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2, avg(x) AS cx, avg(y) AS cy{extra} FROM first JOIN c USING ({keys}, x, y) GROUP BY {keys}, root)"""


@query("blob_statistics", f"""WITH RECURSIVE {BG},
c AS (SELECT trial_id, CAST(frame // 4 AS INTEGER) AS frame, x, y, max(g) AS g FROM fg WHERE g - bg_g > 12 GROUP BY ALL),
{blob_sql("trial_id, frame", ", max(g) AS max_g")}
SELECT * FROM blobs""")
def _(spark, sf_dir):
    p = with_background(spark, sf_dir).where(pixels.contact_pixels()).withColumn("frame", F.floor(F.col("frame") / 4).cast("int"))
    # Four frames are put on each other, so a pixel has several values.
    p = p.groupBy("trial_id", "frame", "x", "y").agg(F.max("g").alias("g"))
    return pixels.blob_statistics(pixels.label_blobs(p), measures={"max_g": F.max("g")})


@query("grouped_feet", f"""WITH RECURSIVE {BG},
c AS (SELECT frame, x, y FROM fg WHERE g - bg_g > 80),
{blob_sql("frame")},
f AS (SELECT frame, label, label AS foot FROM blobs UNION SELECT b.frame, b.label, f.foot FROM f JOIN blobs a ON a.frame = f.frame AND a.label = f.label
  JOIN blobs b ON b.frame = a.frame AND f.foot < b.label AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) <= 2.5),
m AS (SELECT frame, min(foot) AS foot_id, label FROM f GROUP BY ALL), g AS (SELECT * FROM m JOIN blobs USING (frame, label)),
i AS (SELECT frame, foot_id, avg(v) AS intensity_mean, max(v) AS intensity_max, min(v) AS intensity_min, CAST(sum(v) AS DOUBLE) AS intensity_total FROM
  (SELECT DISTINCT g.frame, foot_id, px.x, px.y, px.g AS v FROM g JOIN px ON px.frame = g.frame AND px.x >= x1 AND px.x < x2 AND px.y >= y1 AND px.y < y2) GROUP BY ALL)
SELECT frame, foot_id, CAST(sum(area_px) AS INTEGER) AS area_px, CAST(sum(area_px) AS DOUBLE) AS area_mm2, sum(cx * area_px) / sum(area_px) AS cx, sum(cy * area_px) / sum(area_px) AS cy,
  min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n_blobs, sum(area_px) >= 3 AS is_in_stance,
  any_value(intensity_mean) AS intensity_mean, any_value(intensity_max) AS intensity_max, any_value(intensity_min) AS intensity_min, any_value(intensity_total) AS intensity_total
FROM g JOIN i USING (frame, foot_id) GROUP BY frame, foot_id""")
def _(spark, sf_dir):
    p = with_background(spark, sf_dir).where(pixels.contact_pixels(80.0))
    blobs = pixels.blob_statistics(pixels.label_blobs(p.select("frame", "x", "y", "g"), ("frame",)), ("frame",))
    return matching.merge_blobs(matching.group_blobs(blobs, 2.5, ("frame",)), ("frame",), stance_area=3, pixels=pixel_series(spark, sf_dir))


@query("near_body_pixels", f"""WITH {PIXEL}, f AS (SELECT DISTINCT frame, x, y, trial_id, g, r FROM px),
b AS (SELECT DISTINCT frame, x, y FROM f WHERE r < 30), c AS (SELECT frame, x, y, trial_id FROM f WHERE g > 200)
SELECT CAST(frame AS INTEGER) AS frame, x, y, trial_id FROM c WHERE EXISTS (SELECT 1 FROM b WHERE b.frame = c.frame AND (b.x - c.x) * (b.x - c.x) + (b.y - c.y) * (b.y - c.y) <= 4)""")
def _(spark, sf_dir):
    p = pixel_series(spark, sf_dir)
    return pixels.near_pixels(p.where("g > 200").select("frame", "x", "y", "trial_id"), p.where("r < 30"), 2, ["frame"])


@query("accumulated_pressure", f"""WITH {PIXEL} SELECT trial_id, x, y, max(CASE WHEN g >= 40 THEN g ELSE 0 END) AS max_value FROM px GROUP BY trial_id, x, y""")
def _(spark, sf_dir):
    return pixels.max_projection(pixel_series(spark, sf_dir), ["trial_id"], "g", floor=40)


@query("scaled_pressure", f"""WITH {PIXEL}, a AS (SELECT trial_id, x, y, max(g) AS v FROM px GROUP BY trial_id, x, y),
m AS (SELECT trial_id, max(v) AS t, min(CASE WHEN v > 0 THEN v END) AS lo, max(CASE WHEN v > 0 THEN v END) AS hi FROM a GROUP BY trial_id)
SELECT trial_id, x, y, v AS max_value, CAST(CASE WHEN t > 0 THEN floor(v / t::DOUBLE * 255) ELSE 0 END AS INTEGER) AS scaled FROM a JOIN m USING (trial_id)""")
def _(spark, sf_dir):
    return pixels.scale_to_bytes(pixels.max_projection(pixel_series(spark, sf_dir), ["trial_id"], "g"), ["trial_id"], "max_value")


@query("normalised_pressure", f"""WITH {PIXEL}, a AS (SELECT trial_id, x, y, max(g) AS v FROM px GROUP BY trial_id, x, y),
m AS (SELECT trial_id, min(v) AS lo, max(v) AS hi FROM a WHERE v > 0 GROUP BY trial_id)
SELECT trial_id, x, y, v AS max_value, (v - lo) / (CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE hi - lo END) AS scaled FROM a JOIN m USING (trial_id) WHERE v > 0""")
def _(spark, sf_dir):
    return pixels.min_max_scale(pixels.max_projection(pixel_series(spark, sf_dir), ["trial_id"], "g"), ["trial_id"], "max_value")


@query("percentile_threshold", f"""WITH {PIXEL}, c AS (SELECT trial_id, quantile_cont(g, 0.95) AS threshold FROM px GROUP BY trial_id)
SELECT trial_id, frame, x, y, g, round(threshold, 6) AS threshold FROM px JOIN c USING (trial_id) WHERE g > threshold""")
def _(spark, sf_dir):
    d = pixels.percentile_threshold(pixel_series(spark, sf_dir), ["trial_id"], "g")
    return d.select("trial_id", "frame", "x", "y", "g", F.round("threshold", 6).alias("threshold"))


BOX = PIXEL + """,
bx AS (SELECT trial_id, row_number() OVER (PARTITION BY trial_id ORDER BY frame, x, y, g) AS box, x - 1 AS x1, y - 1 AS y1, x + r % 4 AS x2, y + b % 4 AS y2 FROM px WHERE g > 150)"""


def boxes(spark, sf_dir):
    p = pixel_series(spark, sf_dir).where("g > 150")
    p = ordered.number_rows(p, ["trial_id"], ["frame", "x", "y", "g"], F.floor(F.col("frame") / 64), name="box", start=1)
    return p.select("trial_id", F.col("box").cast("long").alias("box"), (F.col("x") - 1).alias("x1"), (F.col("y") - 1).alias("y1"),
                    (F.col("x") + F.col("r") % 4).alias("x2"), (F.col("y") + F.col("b") % 4).alias("y2"))


@query("box_intensity", f"""WITH {BOX}
SELECT bx.trial_id, box, sum(CASE WHEN g < 20 THEN 0 ELSE g END) / count(*)::DOUBLE AS intensity_mean, max(CASE WHEN g < 20 THEN 0 ELSE g END)::DOUBLE AS intensity_max,
 sum(CASE WHEN g < 20 THEN 0 ELSE g END)::DOUBLE AS intensity_total, count(*) AS n_pixels
FROM bx JOIN px ON px.trial_id = bx.trial_id AND px.x >= x1 AND px.x < x2 AND px.y >= y1 AND px.y < y2 GROUP BY bx.trial_id, box""")
def _(spark, sf_dir):
    return pixels.box_intensity(pixel_series(spark, sf_dir), boxes(spark, sf_dir), ["trial_id"], "box", "g", floor=20)


@query("body_gate", f"""WITH {PIXEL}, d AS (SELECT trial_id, frame, x, y, g, x AS x1, y AS y1, x + 3 AS x2, y + 3 AS y2 FROM px),
roi AS (SELECT trial_id, frame, min(r % 10) AS ex1, min(b % 10) AS ey1, max(r % 10) + 4 AS ex2, max(b % 10) + 4 AS ey2 FROM px WHERE r > 60 GROUP BY trial_id, frame)
SELECT d.trial_id, d.frame, x, y, g FROM d LEFT JOIN roi ON roi.trial_id = d.trial_id AND roi.frame = d.frame
WHERE ex1 IS NULL OR NOT (x2 <= ex1 OR x1 >= ex2 OR y2 <= ey1 OR y1 >= ey2)""")
def _(spark, sf_dir):
    p = pixel_series(spark, sf_dir)
    d = p.select("trial_id", "frame", "x", "y", "g", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 3).alias("x2"), (F.col("y") + 3).alias("y2"))
    roi = p.where("r > 60").groupBy("trial_id", "frame").agg(
        F.min(F.col("r") % 10).alias("ex1"), F.min(F.col("b") % 10).alias("ey1"), (F.max(F.col("r") % 10) + 4).alias("ex2"), (F.max(F.col("b") % 10) + 4).alias("ey2"))
    return pixels.gate_by_body(d, roi).select("trial_id", "frame", "x", "y", "g")


@query("mask_agreement", f"""WITH {PIXEL},
a AS (SELECT trial_id, x, y, max(g) / 256.0::DOUBLE AS v FROM px WHERE g > 120 GROUP BY trial_id, x, y), b AS (SELECT trial_id, x, y, max(g) / 256.0::DOUBLE AS v FROM px WHERE r > 60 GROUP BY trial_id, x, y)
SELECT coalesce(a.trial_id, b.trial_id) AS trial_id, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) / count(*)::DOUBLE AS iou,
  avg(abs(coalesce(a.v, 0) - coalesce(b.v, 0))) AS mae FROM a FULL JOIN b ON a.trial_id = b.trial_id AND a.x = b.x AND a.y = b.y GROUP BY 1""")
def _(spark, sf_dir):
    p = pixel_series(spark, sf_dir).withColumn("v", F.col("g") / 256.0)
    return pixels.mask_agreement(p.where("g > 120"), p.where("r > 60"), ["trial_id"], "v")


@query("largest_blob", f"""WITH {PIXEL}, b AS (SELECT trial_id, frame // 8 AS frame, row_number() OVER (PARTITION BY trial_id, frame // 8 ORDER BY frame, x, y, g) AS label, g AS area_px FROM px)
SELECT trial_id, CAST(frame AS INTEGER) AS frame, label, area_px FROM b WHERE area_px >= 30 QUALIFY row_number() OVER (PARTITION BY trial_id, frame ORDER BY area_px DESC, label) = 1""")
def _(spark, sf_dir):
    p = pixel_series(spark, sf_dir).withColumn("f8", F.floor(F.col("frame") / 8).cast("int"))
    b = ordered.number_rows(p, ["trial_id", "f8"], ["frame", "x", "y", "g"], F.col("frame"), name="label", start=1)
    b = b.select("trial_id", F.col("f8").alias("frame"), F.col("label").cast("long").alias("label"), F.col("g").alias("area_px"))
    return pixels.largest_blob(b, min_area=30)


@query("wide_pressure_rows", f"""WITH {v.LONG}
SELECT trial_id, frame, {', '.join(f"max(CASE WHEN limb = '{n}' THEN cx END) AS {n}_x, max(CASE WHEN limb = '{n}' THEN area_px END) AS {n}_area_px" for n in ('LF', 'RF', 'LH', 'RH'))}
FROM contact GROUP BY trial_id, frame""")
def _(spark, sf_dir):
    return pixels.pressure_rows(v.contact_long(spark, sf_dir), v.TRIAL, {"cx": "x", "area_px": "area_px"})


@query("cumulative_area", f"WITH {v.SAMPLES} SELECT trial_id, frame, sum(x) {W}) AS area_so_far FROM samples")
def _(spark, sf_dir):
    d = ordered.running_sum(v.samples(spark, sf_dir), v.TRIAL, {"area_so_far": F.col("x")}, size=v.SIZE)
    return d.select("trial_id", "frame", "area_so_far")


@query("frame_rate", f"""WITH {v.SAMPLES}, s AS (SELECT trial_id, frame, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM samples),
w AS (SELECT trial_id, frame, t, first_value(t) {W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS f, count(*) {W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS n FROM s)
SELECT trial_id, frame, round(CASE WHEN n >= 2 AND t > f THEN (n - 1) / (t - f) END, 9) AS fps FROM w""")
def _(spark, sf_dir):
    d = series.frame_rate(v.samples(spark, sf_dir, "ts"), v.TRIAL, F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0, size=max(v.SIZE, 32))
    return d.select("trial_id", "frame", F.round("fps", 9).alias("fps"))


@query("centred_windows", f"""WITH {v.SAMPLES}, n AS (SELECT *, count(*) OVER (PARTITION BY trial_id) AS n FROM samples),
i AS (SELECT trial_id, frame, greatest(0, least(frame - 4, n - 8)) + o AS f FROM n, range(8) AS u(o))
SELECT i.trial_id, CAST(i.frame AS INTEGER) AS frame, list(s.x ORDER BY i.f) AS "window" FROM i JOIN samples s ON s.trial_id = i.trial_id AND s.frame = i.f GROUP BY i.trial_id, i.frame""")
def _(spark, sf_dir):
    return series.centred_windows(v.samples(spark, sf_dir), v.TRIAL, "x", size=v.SIZE)


@query("stride_histogram", f"""WITH {v.SAMPLES}, e AS (SELECT trial_id, min(x) AS lo, max(x) AS hi FROM samples WHERE x <> 0 GROUP BY trial_id)
SELECT trial_id, CAST(least(coalesce(floor((x - lo) / nullif((hi - lo) / 15, 0)), 0), 14) AS INTEGER) + 1 AS bin, count(*) AS n FROM samples JOIN e USING (trial_id) WHERE x <> 0 GROUP BY 1, 2""")
def _(spark, sf_dir):
    return series.histogram(v.samples(spark, sf_dir), v.TRIAL, "x")


AXIS = v.SAMPLES + """,
m AS (SELECT trial_id, count(*) AS n, avg(x / 128.0::DOUBLE) AS mx, avg(k) AS my, covar_samp(x / 128.0::DOUBLE, k) AS cxy, var_samp(x / 128.0::DOUBLE) AS cxx, var_samp(k) AS cyy FROM samples GROUP BY trial_id),
a AS (SELECT *, 0.5 * atan2(2 * cxy, cxx - cyy) AS t FROM m),
pr AS (SELECT s.trial_id, max(mx) AS mx, max(my) AS my, max(t) AS t, min((x / 128.0::DOUBLE - mx) * cos(t) + (k - my) * sin(t)) AS lo, max((x / 128.0::DOUBLE - mx) * cos(t) + (k - my) * sin(t)) AS hi
  FROM samples s JOIN a USING (trial_id) GROUP BY s.trial_id),
ax AS (SELECT trial_id, mx + (lo - 0.1 * (hi - lo)) * cos(t) AS p1x, my + (lo - 0.1 * (hi - lo)) * sin(t) AS p1y, mx + (hi + 0.1 * (hi - lo)) * cos(t) AS p2x,
  my + (hi + 0.1 * (hi - lo)) * sin(t) AS p2y FROM pr)"""


def points(spark, sf_dir):
    return v.samples(spark, sf_dir).select("trial_id", "frame", (F.col("x") / 128.0).alias("x"), F.col("k").cast("double").alias("y"))


@query("body_axis", f"WITH {AXIS} SELECT trial_id, {', '.join(f'round({c}, 6) AS {c}' for c in ('p1x', 'p1y', 'p2x', 'p2y'))} FROM ax")
def _(spark, sf_dir):
    d = series.body_axis(points(spark, sf_dir), v.TRIAL, 1920.0, 384.0, size=v.SIZE)
    return d.select("trial_id", *[F.round(c, 6).alias(c) for c in ("p1x", "p1y", "p2x", "p2y")])


@query("moving_body_axis", f"""WITH {v.SAMPLES}, w AS (SELECT trial_id, frame, count(*) OVER q AS n, covar_samp(x / 128.0::DOUBLE, k) OVER q AS cxy, var_samp(x / 128.0::DOUBLE) OVER q AS cxx, var_samp(k) OVER q AS cyy
  FROM samples WINDOW q AS (PARTITION BY trial_id ORDER BY frame ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT trial_id, frame, round(CASE WHEN n >= 6 THEN degrees(0.5 * atan2(2 * cxy, cxx - cyy)) END, 6) AS axis_deg FROM w""")
def _(spark, sf_dir):
    d = series.moving_axis(points(spark, sf_dir), v.TRIAL, size=max(v.SIZE, 32))
    return d.select("trial_id", "frame", F.round("axis_deg", 6).alias("axis_deg"))


@query("quadrant_pick", f"""WITH {AXIS}, d AS (SELECT s.trial_id, s.frame // 8 AS f8, s.frame, x / 128.0::DOUBLE AS px, k::DOUBLE AS py, p1x, p1y, p2x - p1x AS ax, p2y - p1y AS ay FROM samples s JOIN ax USING (trial_id)),
q AS (SELECT *, sqrt(ax * ax + ay * ay) AS n, ((px - p1x) * ax + (py - p1y) * ay) / sqrt(ax * ax + ay * ay) AS par, (ax * (py - p1y) - ay * (px - p1x)) / sqrt(ax * ax + ay * ay) AS perp FROM d),
l AS (SELECT *, (CASE WHEN perp > 0 THEN 'R' ELSE 'L' END) || (CASE WHEN par > n / 2 THEN 'F' ELSE 'H' END) AS limb, abs(par - n / 2) AS off FROM q)
SELECT trial_id, CAST(f8 AS INTEGER) AS frame, limb, CAST(frame AS INTEGER) AS det_id, round(off, 6) AS offset_px FROM l QUALIFY row_number() OVER (PARTITION BY trial_id, f8, limb ORDER BY round(off, 9), frame) = 1""")
def _(spark, sf_dir):
    p = points(spark, sf_dir)
    axis = series.body_axis(p, v.TRIAL, 1920.0, 384.0, size=v.SIZE)
    feet = p.select("trial_id", F.floor(F.col("frame") / 8).cast("int").alias("frame"), F.col("frame").alias("det_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    d = matching.quadrant_pick(feet, axis, v.TRIAL, ["trial_id", "frame"])
    return d.withColumn("offset_px", F.round("offset_px", 6))


LIMB_SQL = v.SAMPLES + """,
det AS (SELECT trial_id, frame // 8 AS f8, frame AS det_id, x / 128.0::DOUBLE AS cx, k::DOUBLE AS cy FROM samples),
lm AS (SELECT DISTINCT trial_id, frame // 8 AS f8 FROM samples), l4 AS (SELECT trial_id, f8, i AS lo, ['LF', 'RF', 'LH', 'RH'][i + 1] AS limb, 20.0 + 10 * i + f8 AS x, 10.0 + 25 * i AS y FROM lm, range(4) u(i)),
pr AS (SELECT d.trial_id, d.f8, det_id, lo, limb, CAST(floor(sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y))) AS INTEGER) AS d FROM det d JOIN l4 USING (trial_id, f8)),
r1 AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY trial_id, f8 ORDER BY d, det_id, lo) = 1),
p2 AS (SELECT p.* FROM pr p JOIN r1 USING (trial_id, f8) WHERE p.det_id <> r1.det_id AND p.lo <> r1.lo), r2 AS (SELECT * FROM p2 QUALIFY row_number() OVER (PARTITION BY trial_id, f8 ORDER BY d, det_id, lo) = 1),
p3 AS (SELECT p.* FROM p2 p JOIN r2 USING (trial_id, f8) WHERE p.det_id <> r2.det_id AND p.lo <> r2.lo), r3 AS (SELECT * FROM p3 QUALIFY row_number() OVER (PARTITION BY trial_id, f8 ORDER BY d, det_id, lo) = 1),
p4 AS (SELECT p.* FROM p3 p JOIN r3 USING (trial_id, f8) WHERE p.det_id <> r3.det_id AND p.lo <> r3.lo), r4 AS (SELECT * FROM p4 QUALIFY row_number() OVER (PARTITION BY trial_id, f8 ORDER BY d, det_id, lo) = 1)
SELECT trial_id, CAST(f8 AS INTEGER) AS frame, CAST(det_id AS INTEGER) AS det_id, limb, d AS distance_px FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4)"""


@query("limb_assignment", f"WITH {LIMB_SQL}")
def _(spark, sf_dir):
    s = v.samples(spark, sf_dir).withColumn("f8", F.floor(F.col("frame") / 8).cast("int"))
    det = s.select("trial_id", F.col("f8").alias("frame"), F.col("frame").alias("det_id"), (F.col("x") / 128.0).alias("cx"), F.col("k").cast("double").alias("cy"))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("limb"), F.lit(i).alias("limb_ord")) for i, n in enumerate(("LF", "RF", "LH", "RH"))]))
    limbs = s.select("trial_id", F.col("f8").alias("frame")).distinct().withColumn("l", rows).select(
        "trial_id", "frame", "l.limb", "l.limb_ord", (F.lit(20.0) + 10 * F.col("l.limb_ord") + F.col("frame")).alias("x"), (F.lit(10.0) + 25 * F.col("l.limb_ord")).alias("y"))
    return matching.assign_limbs(det, limbs)


@query("carried_identity")
def _(spark, sf_dir):
    from treadline.operators import tracking
    c = v.contact_long(spark, sf_dir).where("in_stance = 1")
    rank = F.array_position(F.array(*[F.lit(x) for x in ("LF", "RF", "LH", "RH")]), F.col("limb")).cast("int")
    feet = c.select("trial_id", "frame", "limb", rank.alias("limb_ord"), (F.col("intensity") / 100).alias("cx"), "cy")
    return tracking.carry_identity(feet, ["trial_id"])


ROLES = """
rl AS (SELECT event_id // 5 AS frame_number, event_type AS role, epoch_us(ts) * 1000 AS t FROM events),
one AS (SELECT frame_number, role, max(t) AS t FROM rl GROUP BY ALL),
md AS (SELECT frame_number, l[(n - 1) // 2 + 1] + l[n // 2 + 1] AS m2, n FROM (SELECT frame_number, list(t ORDER BY t) AS l, count(*) AS n FROM one GROUP BY frame_number))"""


def roles(spark, sf_dir):
    return v.table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 5).alias("frame_number"), F.col("event_type").alias("role"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"))


@query("camera_sets", f"""WITH {ROLES}
SELECT frame_number, CAST(n AS BIGINT) AS n_roles, round(max(abs(2 * t - m2)) / 2000000.0::DOUBLE, 6) AS worst_ms FROM one JOIN md USING (frame_number) WHERE n >= 3 GROUP BY frame_number, n""")
def _(spark, sf_dir):
    d = sync.role_sets(roles(spark, sf_dir), n_roles=3)
    return d.select("frame_number", "n_roles", F.round("worst_ms", 6).alias("worst_ms"))


@query("camera_sync_report", f"""WITH {ROLES}, s AS (SELECT frame_number, max(abs(2 * t - m2)) / 2000000.0::DOUBLE AS worst_ms FROM one JOIN md USING (frame_number) WHERE n >= 3 GROUP BY frame_number)
SELECT count(*) AS n_sets, round(max(worst_ms), 6) AS worst_ms, arg_max(frame_number, worst_ms) AS worst_frame, coalesce(max(worst_ms) <= 1.0, false) AS in_sync,
 (SELECT string_agg(role || ' ' || CAST(CAST(floor(abs(2 * t - m2) / 2) AS BIGINT) AS VARCHAR), ', ' ORDER BY role) FROM one JOIN md USING (frame_number)
  WHERE frame_number = (SELECT frame_number FROM s ORDER BY worst_ms DESC, frame_number LIMIT 1)) AS worst_roles_ns FROM s""")
def _(spark, sf_dir):
    d = sync.sync_report(sync.role_sets(roles(spark, sf_dir), n_roles=3))
    of = F.array_sort(F.transform(F.map_entries("worst_deltas_ms"), lambda e: F.concat_ws(" ", e["key"], F.floor(e["value"] * 1e6).cast("string"))))
    return d.select("n_sets", F.round("worst_ms", 6).alias("worst_ms"), "worst_frame", "in_sync", F.array_join(of, ", ").alias("worst_roles_ns"))


@query("pulse_gaps", f"""WITH {v.SAMPLES}, g AS (SELECT trial_id, frame, epoch_us(ts) AS t, lag(epoch_us(ts)) {W}) AS p FROM samples)
SELECT trial_id, frame, (t - p) / 1000000.0::DOUBLE AS gap_s FROM g WHERE t - p > 2 * 36000::BIGINT * 1000000""")
def _(spark, sf_dir):
    d = sync.pulse_gaps(v.samples(spark, sf_dir, "ts"), v.TRIAL, "ts", hz=1 / 36000.0, size=v.SIZE)
    return d.select("trial_id", "frame", "gap_s")


@query("detector_summary", f"""WITH {v.SAMPLES}, f AS (SELECT trial_id, frame // 4 AS f, count(*) FILTER (k >= 50) AS c FROM samples GROUP BY 1, 2),
a AS (SELECT trial_id, sum(c)::BIGINT AS n_blobs, sum(c) / count(*)::DOUBLE AS mean_per_frame, max(c) AS max_per_frame, count(*) FILTER (c > 3) AS crowded_frames, count(*) FILTER (c = 0) AS empty_frames FROM f GROUP BY trial_id),
b AS (SELECT trial_id, sum(k) / count(*)::DOUBLE AS mean_area, median(k) AS median_area FROM samples WHERE k >= 50 GROUP BY trial_id)
SELECT * FROM a LEFT JOIN b USING (trial_id)""")
def _(spark, sf_dir):
    s = v.samples(spark, sf_dir).withColumn("frame", F.floor(F.col("frame") / 4))
    from treadline.operators import evaluation
    blobs = s.where("k >= 50").select("trial_id", "frame", F.col("k").alias("area_px"))
    return evaluation.detector_summary(blobs, s.select("trial_id", "frame").distinct(), v.TRIAL, crowded=3)
