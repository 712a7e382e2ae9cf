"""Plans that read their rows through one shuffle, and the results of the plans that were rebuilt for it."""
import random

import pytest
from pyspark.sql import functions as F

from treadline.operators import contact, gait, multiview, ordered
from treadline.plans import analyze
from treadline.schemas import AXIS_PARTS, LIMB_ROWS

LIMB = ["trial_id", "limb"]


def row_shuffles(spark, df, marker):
    """Shuffles of the plan that carry the column ``marker``, those that are read a second time counted once."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1")):
            spark.conf.set(k, v)
        plan = df.select("*")._jdf.queryExecution().executedPlan()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    found, open_ = 0, [plan]
    while open_:
        p = open_.pop()
        name = p.nodeName()
        if name == "Exchange":
            found += marker in p.output().toString()
        if name != "ReusedExchange":
            open_ += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_free_run_contact_and_neighbours_shuffle_rows_once(spark, tmp_path):
    df = spark.range(100).select(F.lit("a").alias("trial_id"), F.lit("LF").alias("limb"), F.col("id").cast("int").alias("frame"),
                                 F.sin("id").alias("x"), F.cos("id").alias("y"), F.col("id").alias("mark"))
    df.write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    assert row_shuffles(spark, contact.displacement_contact(df, LIMB), "mark") == 1
    assert row_shuffles(spark, ordered.neighbours(df, LIMB, "frame", {"n": ("x", 1), "p": ("x", -2)}), "mark") == 1


@pytest.mark.parametrize("batch", ["7", "10000"])
@pytest.mark.parametrize("size", [2, 16, ordered.CHUNK])
def test_gap_filling_over_many_chunks_and_batches(spark, size, batch):
    rnd, rows, want = random.Random(3), [], {}
    for t, n, p in (("a", 150, 0.9), ("b", 1, 0.0), ("c", 40, 0.3), ("d", 20, 1.0)):
        vals = [None if rnd.random() < p else rnd.uniform(-5, 5) for _ in range(n)]
        rows += [(t, i, f"n{i}", v, 1.0) for i, v in enumerate(vals)]
        known = [i for i, v in enumerate(vals) if v is not None]
        for i, v in enumerate(vals):
            a, b = max((k for k in known if k <= i), default=None), min((k for k in known if k >= i), default=None)
            if v is None:
                v = (vals[a] + (vals[b] - vals[a]) * (i - a) / (b - a) if None not in (a, b) else
                     vals[a] if a is not None else vals[b] if b is not None else 0.0)
            want[t, i, f"n{i}"] = (v, 1.0)
    df = spark.createDataFrame(rows, "trial_id string, frame int, note string, x double, whole double")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = contact.fill_gaps(df, ["trial_id"], ["x", "whole"], size=size).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert {(r.trial_id, r.frame, r.note): (r.x, r.whole) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("fix", [True, False])
def test_limbs_of_the_analysis_follow_from_its_contact(spark, fix):
    rnd, rows = random.Random(8), []
    parts = [p for r in LIMB_ROWS for p in r[4:6]] + list(AXIS_PARTS)
    for t, n in (("a", 90), ("b", 30)):
        for f in range(n):
            rows += [(t, f, p, None if rnd.random() < 0.1 else i + f + 4 * rnd.random(), i + rnd.random()) for i, p in enumerate(parts)]
    kp = spark.createDataFrame(rows, "trial_id string, frame int, bodypart string, x double, y double")
    key = lambda r: (r.trial_id, r.limb)
    seen = []
    for size in (8, ordered.CHUNK):
        res = analyze.analyze(kp, 100.0, autocorrect=fix, size=size)
        limbs = {key(r): r for r in res["limbs"].collect()}
        basics = gait.gait_basics(res["contact"], LIMB, 100.0)
        lengths = gait.stride_summary(gait.stride_lengths(res["contact"], LIMB, 100.0), LIMB)
        for r in basics.join(lengths, LIMB, "left").na.fill(0).collect():
            for c in r.asDict():
                assert limbs[key(r)][c] == (pytest.approx(r[c]) if isinstance(r[c], float) else r[c]), c
        assert all(r.angle_mean_deg > 0 and r.stance_width_mean > 0 for r in limbs.values()) and len(limbs) == 8
        seen.append({k: [pytest.approx(x) if isinstance(x, float) else x for x in r] for k, r in limbs.items()})
    assert limbs.keys() == seen[0].keys() and all(list(r) == seen[0][k] for k, r in limbs.items())


def test_views_are_not_spread_by_camera_and_refine_from_their_own_column(spark, tmp_path):
    rig = spark.createDataFrame([(f"c{i}", [800.0, 0.0, 320.0, 40.0 * i, 0.0, 800.0, 240.0, 5.0 * i * i, 0.0, 0.0, 1.0, 5.0]) for i in range(3)],
                                "camera string, p array<double>")
    pts = spark.createDataFrame([("a", f, j, 0.1 * f, 0.2 * k, 0.5) for f in range(4) for k, j in enumerate(("p", "q"))],
                                "trial_id string, frame int, joint string, x double, y double, z double")
    keys = ["trial_id", "frame", "joint"]
    obs = multiview.project_points(pts, rig).select(*keys, "camera", (F.col("u") + F.col("frame")).alias("u"), "v")
    obs.unionByName(obs.limit(1).withColumn("camera", F.lit("unknown"))).write.parquet(str(tmp_path / "o"))
    obs = spark.read.parquet(str(tmp_path / "o"))
    views = multiview.gather_views(obs, rig, keys)
    assert "hashpartitioning(camera" not in views._jdf.queryExecution().executedPlan().toString()
    more = rig.unionByName(spark.range(300).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("camera"), F.array(*[F.lit(1.0)] * 12).alias("p")))
    order = lambda d: sorted(map(tuple, d.collect()), key=lambda r: r[:3])
    assert order(multiview.gather_views(obs, more, keys)) == order(views) and views.count() == 8
    start = multiview.triangulate(views, keys, keep=["views"])
    plain = multiview.triangulate(views, keys)
    assert order(start.drop("views")) == order(plain)
    bones = [("p", "q", 0.2)]
    assert order(multiview.refine(start, None, bones)) == order(multiview.refine(plain, views, bones))


def test_gait_suite_numbers_its_frames_once(spark, monkeypatch):
    from treadline.catalog import load, views
    calls, samples = [], views.samples
    monkeypatch.setattr(views, "samples", lambda *a: calls.append(a) or samples(*a))
    load().QUERIES["gait_suite"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
