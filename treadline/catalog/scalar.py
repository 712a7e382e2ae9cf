"""Scalar functions, multi-view geometry, leaderboards and end-to-end plans on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from treadline.catalog import views as v
from treadline.catalog.contacts import AGG_SQL, BASICS4, STEPS
from treadline.catalog.registry import query
from treadline.functions import geometry as geo
from treadline.functions import metrics as fm
from treadline.operators import evaluation, gait, multiview, steps, support
from treadline.plans import analyze
from treadline.session import materialise

# The points of a vector as a closed outline: even elements are x, odd ones y, and after the last point comes the first.
ELEMENTS = ("x", "y", "x2", "y2", "x3", "y3", "x4", "y4")
POSE = f"""
pt AS (SELECT vec_id, label, i, {', '.join(f'embedding[(2 * i + {o}) % len(embedding) + 1]::DOUBLE AS {n}' for o, n in enumerate(ELEMENTS))}
  FROM embeddings, unnest(range(len(embedding) // 2)) AS u(i))"""


def pose(spark, sf_dir):
    n = F.size("embedding")
    e = v.table(spark, sf_dir, "embeddings").withColumn("i", F.explode(F.when(n >= 2, F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1))))
    at = lambda o: F.get("embedding", (2 * F.col("i") + o) % n).cast("double")
    return e.select("vec_id", "label", F.col("i").cast("long").alias("i"), *[at(o).alias(n) for o, n in enumerate(ELEMENTS)])


C = F.col


def pts():
    return [C(n) for n in ELEMENTS]


@query("point_geometry", f"""WITH {POSE}
SELECT vec_id, i, (x + x2) / 2 AS mid_x, (y + y2) / 2 AS mid_y, round(sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)), 9) AS dist,
 round(CASE WHEN x2 = x THEN 'inf'::DOUBLE ELSE (y2 - y) / (x2 - x) END, 6) AS slope,
 round(CASE WHEN (y2 - y) / (x2 - x) >= 0 THEN degrees(atan((y2 - y) / (x2 - x))) ELSE 180 + degrees(atan((y2 - y) / (x2 - x))) END, 6) AS angle, 384.0::DOUBLE - y AS flipped FROM pt""")
def _(spark, sf_dir):
    x, y, x2, y2 = pts()[:4]
    m = geo.slope(x, y, x2, y2)
    return pose(spark, sf_dir).select("vec_id", "i", geo.midpoint(x, x2).alias("mid_x"), geo.midpoint(y, y2).alias("mid_y"),
                                      F.round(geo.distance(x, y, x2, y2), 9).alias("dist"), F.round(m, 6).alias("slope"),
                                      F.round(geo.angle_from_slope(m), 6).alias("angle"), geo.flip_y(y, 384).alias("flipped"))


@query("axis_geometry", f"""WITH {POSE}, a AS (SELECT *, abs(atan2(y - y2, x - x2) - atan2(y4 - y3, x4 - x3)) AS d FROM pt)
SELECT vec_id, i, round(degrees(CASE WHEN d > pi() THEN 2 * pi() - d ELSE d END), 6) AS angle,
 round(abs((x3 - x2) * (y - y2) - (y3 - y2) * (x - x2)) / (CASE WHEN sqrt((x3 - x2) * (x3 - x2) + (y3 - y2) * (y3 - y2)) = 0 THEN 1 ELSE sqrt((x3 - x2) * (x3 - x2) + (y3 - y2) * (y3 - y2)) END), 6) AS dist,
 round(degrees(atan2((x - x2) * (y4 - y3) - (y - y2) * (x4 - x3), (x - x2) * (x4 - x3) + (y - y2) * (y4 - y3))), 6) AS step_angle FROM a""")
def _(spark, sf_dir):
    x, y, x2, y2, x3, y3, x4, y4 = pts()
    return pose(spark, sf_dir).select(
        "vec_id", "i", F.round(geo.axis_angle(*pts()), 6).alias("angle"), F.round(geo.point_line_distance(x, y, x2, y2, x3, y3), 6).alias("dist"),
        F.round(geo.signed_angle(x - x2, y - y2, x4 - x3, y4 - y3), 6).alias("step_angle"))


@query("body_axis_angle", f"WITH {POSE} SELECT vec_id, round(avg(degrees(atan2(y - y2, x - x2))), 6) AS body_axis_angle_deg FROM pt GROUP BY vec_id")
def _(spark, sf_dir):
    d = gait.mean_angle(pose(spark, sf_dir), ["vec_id"], C("y") - C("y2"), C("x") - C("x2"))
    return d.withColumn("body_axis_angle_deg", F.round("body_axis_angle_deg", 6))


@query("stance_angles", f"""WITH {POSE} SELECT vec_id, round(coalesce(avg(CASE WHEN i % 3 = 0 THEN degrees(atan2(y, x)) END), 0.0), 6) AS angle_mean_deg FROM pt GROUP BY vec_id""")
def _(spark, sf_dir):
    p = pose(spark, sf_dir).withColumn("in_stance", (C("i") % 3 == 0).cast("int"))
    d = gait.stance_angle(p, ["vec_id"], F.degrees(F.atan2(C("y"), C("x"))))
    return d.withColumn("angle_mean_deg", F.round("angle_mean_deg", 6))


@query("pair_widths", f"WITH {POSE} SELECT vec_id, round(avg(abs(x - x2) * 0.25), 9) AS width FROM pt GROUP BY vec_id")
def _(spark, sf_dir):
    return gait.pair_widths(pose(spark, sf_dir), ["vec_id"], C("x"), C("x2"), 0.25).withColumn("width", F.round("width", 9))


@query("likelihood_mask", """SELECT event_id, CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) / 100.0::DOUBLE >= 0.1 THEN value END AS x FROM events""")
def _(spark, sf_dir):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int") / 100.0
    return v.table(spark, sf_dir, "events").select("event_id", geo.confident(C("value"), k).alias("x"))


@query("phase_ratios", """WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS a, l_discount * 100 AS b, l_tax * 1000 AS c, l_extendedprice AS d FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, a + b AS cycle, CASE WHEN a + b > 0 THEN 100 * a / (a + b) ELSE 0 END AS pct_stance, CASE WHEN a + b > 0 THEN 100 * b / (a + b) ELSE 0 END AS pct_swing,
 CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0 END AS duty, CASE WHEN a > 0 THEN b / a ELSE 0 END AS ratio, 2 * a * 60 AS cadence, CASE WHEN greatest(a, b) <= 0 THEN 0 ELSE 100 * least(a, b) / greatest(a, b) END AS si,
 CASE WHEN b > 0 THEN d / b ELSE 0 END AS swing_speed, CASE WHEN a = 0 AND b = 0 THEN 1 WHEN a = 0 OR b = 0 THEN 'inf'::DOUBLE ELSE greatest(a / b, 1 / (a / b)) END AS asym,
 CASE WHEN a + b > 0 THEN abs(a - b) / (a + b) ELSE 0 END AS int_asym, CASE WHEN a + b = 0 OR c + d = 0 THEN 0 ELSE ((1 - abs(a - b) / (a + b)) + (1 - abs(c - d) / (c + d))) / 2 END AS symmetry FROM s""")
def _(spark, sf_dir):
    s = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", C("l_quantity").alias("a"),
                                                  (C("l_discount") * 100).alias("b"), (C("l_tax") * 1000).alias("c"), C("l_extendedprice").alias("d"))
    a, b, c, d = (C(n) for n in "abcd")
    return s.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", fm.cycle_ms(a, b).alias("cycle"), fm.stance_pct(a, b).alias("pct_stance"),
                    fm.swing_pct(a, b).alias("pct_swing"), fm.duty_cycle(a, b).alias("duty"), fm.swing_to_stance(a, b).alias("ratio"), fm.cadence(a).alias("cadence"),
                    fm.symmetry_index(a, b).alias("si"), fm.swing_speed(d, b).alias("swing_speed"), fm.ratio_asymmetry(a, b).alias("asym"),
                    fm.intensity_asymmetry(a, b).alias("int_asym"), fm.gait_symmetry(a, b, c, d).alias("symmetry"))


@query("unit_conversions", r"""WITH s AS (SELECT event_id, value AS t, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
SELECT event_id, greatest(1, CAST(round_even(t * 60, 0) AS INTEGER) + 1) AS frame, 5.0::DOUBLE + t * (1.92::DOUBLE * 10.0::DOUBLE) AS px, k / 1.92::DOUBLE AS mm, k / (1.92::DOUBLE * 1.92::DOUBLE) AS mm2,
 k / (1.92::DOUBLE * 1.92::DOUBLE) / 100.0::DOUBLE AS cm2, k / 60.0::DOUBLE AS s, CASE WHEN k > 0 THEN t / k ELSE 0.0 END AS dur, round(18 * pow(greatest(t - 8, 0), 0.75), 6) AS pressure,
 10.0::DOUBLE * k + 2.0::DOUBLE * (k % 7) - 3.0::DOUBLE * (k % 5) - 0.5::DOUBLE * (k % 3) AS score, greatest(0, k - 8) AS x1, least(64, k + 3 + 8) AS x2, (k + 3) / greatest(least(k + 3, k % 6), 1)::DOUBLE <= 5 AS compact FROM s""")
def _(spark, sf_dir):
    s = v.table(spark, sf_dir, "events").select("event_id", C("value").alias("t"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    t, k = C("t"), C("k")
    box = geo.expand_box(k, k, k + 3, k + 3, 8, 64, 64)
    return s.select("event_id", fm.time_to_frame(t, 60).alias("frame"), fm.cm_to_px(t, 1.92, 5.0).alias("px"), fm.px_to_mm(k, 1.92).alias("mm"),
                    fm.px2_to_mm2(k, 1.92).alias("mm2"), fm.px2_to_cm2(k, 1.92).alias("cm2"), fm.frames_to_seconds(k, 60.0).alias("s"),
                    fm.duration_s(t, k).alias("dur"), F.round(fm.pressure(t), 6).alias("pressure"),
                    fm.detector_score(k, k % 7, k % 5, k % 3).alias("score"), box["x1"].alias("x1"), box["x2"].alias("x2"),
                    (geo.aspect_ratio(k + 3, k % 6) <= 5).alias("compact"))


@query("coordinate_text", r"""WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'none' WHEN l_linenumber % 2 = 0 THEN '(' || CAST(l_partkey AS VARCHAR) || ', -' || CAST(l_suppkey AS VARCHAR) || ')'
  ELSE CAST(l_partkey AS VARCHAR) || '.5 ' || CAST(l_suppkey AS VARCHAR) END AS t FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(TRY_CAST(regexp_extract(t, '[\(\s]*(-?\d+(?:\.\d+)?)[\s,]+(-?\d+(?:\.\d+)?)[\s\)]*', 1) AS DOUBLE), 0.0) AS x,
 coalesce(TRY_CAST(regexp_extract(t, '[\(\s]*(-?\d+(?:\.\d+)?)[\s,]+(-?\d+(?:\.\d+)?)[\s\)]*', 2) AS DOUBLE), 0.0) AS y FROM s""")
def _(spark, sf_dir):
    li = v.table(spark, sf_dir, "lineitem")
    p, s = C("l_partkey").cast("string"), C("l_suppkey").cast("string")
    t = F.when(C("l_linenumber") == 7, "none").when(C("l_linenumber") % 2 == 0, F.concat(F.lit("("), p, F.lit(", -"), s, F.lit(")"))).otherwise(F.concat(p, F.lit(".5 "), s))
    xy = fm.parse_xy(t)
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", xy["x"].alias("x"), xy["y"].alias("y"))


@query("colour_scores", """WITH s AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS n FROM events), c AS (SELECT event_id, n % 256 AS r, n % 199 AS g, n % 101 AS b FROM s)
SELECT event_id, 2.0::DOUBLE * g - r - b AS green_excess, round(greatest(0, 300 - sqrt((r - 20) * (r - 20) + (g - 200) * (g - 200) + (b - 20) * (b - 20))), 6) AS colour_score FROM c""")
def _(spark, sf_dir):
    n = F.round(C("value") * 100).cast("long")
    e = v.table(spark, sf_dir, "events").select("event_id", (n % 256).alias("r"), (n % 199).alias("g"), (n % 101).alias("b"))
    return e.select("event_id", fm.green_excess(C("r"), C("g"), C("b")).alias("green_excess"),
                    F.round(fm.colour_distance_score(C("r"), C("g"), C("b"), (20.0, 200.0, 20.0)), 6).alias("colour_score"))


# A rig of four calibrated cameras (focal length 800, centre 320/240) around the scene.
RIG = (("cam0", (0.0, 0.0, 0.0), (0.0, 0.0, 5.0)), ("cam1", (0.0, 0.3, 0.0), (-0.4, 0.1, 5.2)),
       ("cam2", (0.25, 0.0, 0.1), (0.2, -0.3, 5.5)), ("cam3", (-0.2, -0.3, 0.05), (0.3, 0.2, 4.8)))


def rig(spark):
    k = [800.0, 0.0, 320.0, 0.0, 800.0, 240.0, 0.0, 0.0, 1.0]
    d = spark.createDataFrame([(n, k, list(r), list(t)) for n, r, t in RIG], "camera string, k array<double>, rvec array<double>, tvec array<double>")
    return multiview.rig_from_pose(d)


def points3d(spark, sf_dir):
    return pose(spark, sf_dir).select("vec_id", "i", C("x"), C("y"), C("x2").alias("z"))


def observations(spark, sf_dir):
    """Projections of the points, with a few gross outliers in one camera."""
    d = multiview.project_points(points3d(spark, sf_dir), rig(spark))
    off = F.when((C("camera") == "cam2") & ((C("vec_id") + C("i")) % 5 == 0), 40.0).otherwise(0.0)
    return d.select("vec_id", "i", "camera", (C("u") + off).alias("u"), "v")


# Rotation about an axis, written out: v cos t + (k x v) sin t + k (k . v) (1 - cos t).
CAMERAS = f"""
rg(camera, rx, ry, rz, tx, ty, tz) AS (VALUES {', '.join(str((n, *r, *t)) for n, r, t in RIG)}),
rk AS (SELECT camera, th, tx::DOUBLE AS tx, ty::DOUBLE AS ty, tz::DOUBLE AS tz, coalesce(rx / nullif(th, 0), 0) AS kx, coalesce(ry / nullif(th, 0), 0) AS ky, coalesce(rz / nullif(th, 0), 0) AS kz
  FROM (SELECT *, sqrt(rx * rx + ry * ry + rz * rz)::DOUBLE AS th FROM rg)),
kd AS (SELECT vec_id, i, x, y, x2 AS z, rk.*, (kx * x + ky * y + kz * x2) * (1 - cos(th)) AS m FROM pt, rk),
cc AS (SELECT vec_id, i, camera, x * cos(th) + (ky * z - kz * y) * sin(th) + kx * m + tx AS xc, y * cos(th) + (kz * x - kx * z) * sin(th) + ky * m + ty AS yc,
  z * cos(th) + (kx * y - ky * x) * sin(th) + kz * m + tz AS zc FROM kd)"""


@query("camera_projection", f"""WITH {POSE}, {CAMERAS} SELECT vec_id, i, camera, round(800 * xc / zc + 320, 6) AS u, round(800 * yc / zc + 240, 6) AS v FROM cc""")
def _(spark, sf_dir):
    d = multiview.project_points(points3d(spark, sf_dir), rig(spark))
    return d.select("vec_id", "i", "camera", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


@query("triangulation", f"WITH {POSE} SELECT vec_id, i, round(x, 6) AS x, round(y, 6) AS y, round(x2, 6) AS z FROM pt")
def _(spark, sf_dir):
    views = multiview.gather_views(observations(spark, sf_dir), rig(spark), ["vec_id", "i"])
    d = multiview.triangulate(views, ["vec_id", "i"])
    return d.select("vec_id", "i", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("triangulation_missing_view", f"WITH {POSE} SELECT vec_id, i, round(x, 6) AS x, round(y, 6) AS y, round(x2, 6) AS z FROM pt WHERE (vec_id + i) % 10 <> 3")
def _(spark, sf_dir):
    seen = observations(spark, sf_dir).where("camera <> 'cam3' OR (vec_id + i) % 10 <> 3")
    d = multiview.triangulate(multiview.gather_views(seen, rig(spark), ["vec_id", "i"]), ["vec_id", "i"])
    return d.select("vec_id", "i", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("linear_triangulation")
def _(spark, sf_dir):
    views = multiview.gather_views(observations(spark, sf_dir), rig(spark), ["vec_id", "i"])
    return multiview.triangulate(views, ["vec_id", "i"], robust=False)


@query("linear_triangulation_exact", f"WITH {POSE} SELECT vec_id, i, round(x, 6) AS x, round(y, 6) AS y, round(x2, 6) AS z FROM pt")
def _(spark, sf_dir):
    views = multiview.gather_views(multiview.project_points(points3d(spark, sf_dir), rig(spark)), rig(spark), ["vec_id", "i"])
    d = multiview.triangulate(views, ["vec_id", "i"], robust=False)
    return d.select("vec_id", "i", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("view_error_rms", f"""WITH {POSE} SELECT i, CASE WHEN camera = 'cam2' THEN round(sqrt(sum(CASE WHEN (vec_id + i) % 5 = 0 THEN 1600.0 ELSE 0.0 END) / count(*)), 4) ELSE 0.0 END AS rms_px, camera
FROM pt, (VALUES ('cam0'), ('cam1'), ('cam2'), ('cam3')) c(camera) GROUP BY i, camera""")
def _(spark, sf_dir):
    e = multiview.view_errors(points3d(spark, sf_dir), observations(spark, sf_dir), rig(spark), ["vec_id", "i"])
    return multiview.joint_rms(e, ["i", "camera"]).withColumn("rms_px", F.round("rms_px", 4))


SKELETON = (("j0", "j1"), ("j1", "j2"), ("j2", "j3"), ("j1", "j4"), ("j4", "j5"), ("j5", "j6"))


@query("joint_angles", f"""WITH {POSE}, p AS (SELECT vec_id, i // 7 AS f, i % 7 AS j, x, y, x2 AS z FROM pt),
e(par, child, gp) AS (VALUES (0, 1, NULL), (1, 2, 0), (2, 3, 1), (1, 4, 0), (4, 5, 1), (5, 6, 4)),
fr AS (SELECT DISTINCT vec_id, f FROM p),
w AS (SELECT fr.vec_id, fr.f, e.child, b.x - a.x AS x1, b.y - a.y AS y1, b.z - a.z AS z1, CASE WHEN e.gp IS NULL THEN b.x - a.x ELSE g.x - b.x END AS x2, CASE WHEN e.gp IS NULL THEN b.y - a.y ELSE g.y - b.y END AS y2,
  CASE WHEN e.gp IS NULL THEN b.z - a.z ELSE g.z - b.z END AS z2 FROM fr, e LEFT JOIN p a ON a.j = e.child AND a.vec_id = fr.vec_id AND a.f = fr.f LEFT JOIN p b ON b.j = e.par AND b.vec_id = fr.vec_id AND b.f = fr.f
  LEFT JOIN p g ON g.j = e.gp AND g.vec_id = fr.vec_id AND g.f = fr.f),
c AS (SELECT *, (x1 * x2 + y1 * y2 + z1 * z2) / (sqrt(x1 * x1 + y1 * y1 + z1 * z1) * sqrt(x2 * x2 + y2 * y2 + z2 * z2)) AS cs FROM w)
SELECT vec_id, f AS frame, 'j' || child AS joint, CASE WHEN cs IS NOT NULL THEN round(degrees(acos(greatest(-1, least(1, cs)))), 4) END AS angle_deg FROM c""")
def _(spark, sf_dir):
    p = points3d(spark, sf_dir).select("vec_id", F.floor(C("i") / 7).alias("frame"), F.concat(F.lit("j"), (C("i") % 7).cast("string")).alias("joint"), "x", "y", "z")
    d = multiview.joint_angles(p, SKELETON, ["vec_id", "frame"])
    return d.withColumn("angle_deg", F.round("angle_deg", 4))


@query("refined_points")
def _(spark, sf_dir):
    name = F.concat(F.lit("j"), (C("i") % 7).cast("string"))
    keys = [C("vec_id").alias("trial_id"), F.floor(C("i") / 7).alias("frame"), name.alias("joint")]
    obs = observations(spark, sf_dir).select(*keys, "camera", "u", "v")
    views = multiview.gather_views(obs, rig(spark), ["trial_id", "frame", "joint"])
    start = multiview.triangulate(views, ["trial_id", "frame", "joint"], keep=["views"])
    return multiview.refine(start, None, [("j0", "j1", 0.2), ("j1", "j2", 0.2)], rounds=10)


@query("print_linkage", f"""WITH {POSE}, p AS (SELECT vec_id, i // 7 AS f, i % 7 AS j, 800 * x / (x2 + 5) + 320 AS u, 800 * y / (x2 + 5) + 240 AS v FROM pt),
r AS (SELECT vec_id AS trial_id, f AS print_id, 300.0 + f * 10 AS cx, 240.0 AS cy FROM (SELECT DISTINCT vec_id, f FROM p))
SELECT trial_id, print_id, 'j' || j AS joint, round(sqrt((cx - u) * (cx - u) + (cy - v) * (cy - v)), 6) AS distance_px FROM r JOIN p ON p.vec_id = trial_id AND p.f = print_id
QUALIFY row_number() OVER (PARTITION BY trial_id, print_id ORDER BY round(sqrt((cx - u) * (cx - u) + (cy - v) * (cy - v)), 9), j) = 1""")
def _(spark, sf_dir):
    p = points3d(spark, sf_dir).select(C("vec_id").alias("trial_id"), F.floor(C("i") / 7).alias("frame"), F.concat(F.lit("j"), (C("i") % 7).cast("string")).alias("joint"), "x", "y", "z")
    prints = p.select("trial_id", "frame").distinct().select("trial_id", C("frame").alias("print_id"), C("frame").alias("peak_area_frame"), (300.0 + C("frame") * 10).alias("cx"), F.lit(240.0).alias("cy"))
    d = multiview.link_to_prints(p, prints, rig(spark), "cam0")
    return d.withColumn("distance_px", F.round("distance_px", 6))


BOARD = """s AS (SELECT p_brand AS strong, p_size % 4 AS weak, p_partkey % 20 AS trial_id, sum(CAST(round(p_retailprice * 100) AS BIGINT))::DOUBLE AS score FROM part GROUP BY ALL)"""


def scores(spark, sf_dir):
    return v.table(spark, sf_dir, "part").groupBy(C("p_brand").alias("strong"), (C("p_size") % 4).alias("weak"), (C("p_partkey") % 20).alias("trial_id")).agg(
        F.sum(F.round(C("p_retailprice") * 100).cast("long")).cast("double").alias("score"))


@query("config_leaderboard", f"""WITH {BOARD} SELECT strong, weak, avg(score) AS mean_score, min(score) AS min_score, max(score) AS max_score, round(stddev_pop(score), 4) AS sd_score, count(*) AS n_trials
FROM s GROUP BY strong, weak ORDER BY mean_score DESC, strong, weak LIMIT 10""")
def _(spark, sf_dir):
    return evaluation.leaderboard(scores(spark, sf_dir), ["strong", "weak"], "score").withColumn("sd_score", F.round("sd_score", 4))


@query("score_grid", f"WITH {BOARD} SELECT strong, {', '.join(f'avg(score) FILTER (weak = {i}) AS w{i}' for i in range(4))} FROM s GROUP BY strong")
def _(spark, sf_dir):
    d = evaluation.score_grid(scores(spark, sf_dir), "strong", "weak", range(4), "score")
    return d.select("strong", *[C(str(i)).alias(f"w{i}") for i in range(4)])


@query("mask_score_summary", """WITH p AS (SELECT l_suppkey, CASE WHEN l_linenumber <> 3 THEN l_discount * 10 END AS iou, CASE WHEN l_linenumber <> 3 THEN l_tax END AS mae FROM lineitem)
SELECT l_suppkey, median(coalesce(iou, 0)) AS median_iou, median(coalesce(mae, 0.5)) AS median_mae, median(coalesce(iou, 0)) - 0.5 * median(coalesce(mae, 0.5)) AS score, count(*) AS n_prints FROM p GROUP BY l_suppkey""")
def _(spark, sf_dir):
    p = v.table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(C("l_linenumber") != 3, C("l_discount") * 10).alias("iou"), F.when(C("l_linenumber") != 3, C("l_tax")).alias("mae"))
    return evaluation.mask_scores(p, ["l_suppkey"])


@query("pair_asymmetry", """WITH s AS (SELECT l_suppkey, CASE l_linenumber % 4 WHEN 1 THEN 'LF' WHEN 2 THEN 'RF' WHEN 3 THEN 'LH' ELSE 'RH' END AS limb, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
w AS (SELECT l_suppkey, max(q) FILTER (limb = 'LF') AS a, max(q) FILTER (limb = 'RF') AS b, max(q) FILTER (limb = 'LH') AS c, max(q) FILTER (limb = 'RH') AS d FROM s GROUP BY l_suppkey)
SELECT l_suppkey, 'fore' AS pair, greatest(a / b, 1 / (a / b)) AS asymmetry FROM w WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT l_suppkey, 'hind', greatest(c / d, 1 / (c / d)) FROM w WHERE c IS NOT NULL AND d IS NOT NULL""")
def _(spark, sf_dir):
    limb = F.element_at(F.array(*[F.lit(x) for x in ("LF", "RF", "LH", "RH")]), (C("l_linenumber") - 1) % 4 + 1)
    s = v.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", limb.alias("limb")).agg(F.sum("l_quantity").alias("value"))
    return evaluation.pair_asymmetry(s, [("fore", "LF", "RF"), ("hind", "LH", "RH")], ["l_suppkey"])


@query("cohort_summary", """SELECT c_mktsegment, c_nationkey, round(avg(c_acctbal), 6) AS mean, round(coalesce(stddev_samp(c_acctbal) / sqrt(count(c_acctbal)), 0), 6) AS sem, count(c_acctbal) AS n FROM customer GROUP BY ALL""")
def _(spark, sf_dir):
    d = evaluation.cohort_summary(v.table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], "c_acctbal")
    return d.withColumns({"mean": F.round("mean", 6), "sem": F.round("sem", 6)})


@query("contact_metric_rows", f"""WITH {STEPS}, {AGG_SQL}, u AS (UNPIVOT (SELECT trial_id, limb, {', '.join(f'{c}::DOUBLE AS {c}' for c in steps.LIMB_METRICS)} FROM ag) ON {', '.join(steps.LIMB_METRICS)} INTO NAME metric VALUE value)
SELECT trial_id, limb, metric, round(value, CASE WHEN metric LIKE '%cm2' THEN 9 ELSE 6 END) AS value FROM u""")
def _(spark, sf_dir):
    d = steps.limb_aggregates(steps.bouts(v.contact_long(spark, sf_dir), v.LIMB, 128.0, size=v.SIZE), v.LIMB, 128.0)
    m = analyze.long_metrics(d, v.LIMB)
    return m.withColumn("value", F.when(C("metric").endswith("cm2"), F.round("value", 9)).otherwise(F.round("value", 6)))


@query("contact_suite")
def _(spark, sf_dir):
    return analyze.contact_suite(v.contact_long(spark, sf_dir), 128.0, size=v.SIZE, reuse=True)


@query("gait_suite")
def _(spark, sf_dir):
    # Limbs and body are two views of the same frames, which are numbered and summed once.
    w = materialise(v.contact_wide(spark, sf_dir))
    d = v.contact_long(spark, sf_dir, w).select("trial_id", "limb", "frame", "in_stance", C("cx").alias("x"), C("cy").alias("y"), "intensity", "area_px")
    body = w.select("trial_id", "frame", C("cx").alias("com_x"))
    return analyze.metric_suite(d, 128.0, body=body, size=v.SIZE, reuse=True)


@query("gait_suite_averages", f"""WITH {BASICS4}, r AS (SELECT *, stance_ms + swing_ms AS c FROM b4)
SELECT trial_id, round(avg(stance_ms), 6) AS avg_stance_ms, round(avg(swing_ms), 6) AS avg_swing_ms, round(avg(c), 6) AS avg_cycle_ms,
 round(coalesce(avg(CASE WHEN stride_hz > 0 THEN stride_hz END), 0), 6) AS avg_stride_frequency_hz, round(2 * 60 * coalesce(avg(CASE WHEN stride_hz > 0 THEN stride_hz END), 0), 6) AS cadence_steps_per_min FROM r GROUP BY trial_id""")
def _(spark, sf_dir):
    m = analyze.metric_suite(v.contact_long(spark, sf_dir).select("trial_id", "limb", "frame", "in_stance"), 128.0, size=v.SIZE, reuse=True)
    names = ["avg_stance_ms", "avg_swing_ms", "avg_cycle_ms", "avg_stride_frequency_hz", "cadence_steps_per_min"]
    d = m.where(C("metric").isin(names)).groupBy("trial_id").pivot("metric", names).agg(F.first("value"))
    return d.select("trial_id", *[F.round(n, 6).alias(n) for n in names])


@query("keypoint_analysis")
def _(spark, sf_dir):
    from treadline.schemas import AXIS_PARTS, LIMB_ROWS
    names = [p for r in LIMB_ROWS for p in r[4:6]] + list(AXIS_PARTS)
    s = v.samples(spark, sf_dir)
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("bodypart"), F.lit(float(i)).alias("o")) for i, n in enumerate(names)]))
    kp = s.withColumn("p", parts).select("trial_id", "frame", "p.bodypart", F.when(C("k") >= 10, C("x") / 100 + C("p.o") * C("k") % 7).alias("x"), (C("k") + C("p.o")).alias("y"))
    return analyze.analyze(kp, 100.0, size=v.SIZE)["limbs"]
