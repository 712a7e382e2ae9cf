"""Sources, sinks, the table store, and streams against their batch operators."""
import gzip
import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from treadline.operators import contact, ordered
from treadline.plans import analyze
from treadline.schemas import AXIS_PARTS, LIMB_ROWS, limb_dimension
from treadline.sources import readers, sinks, store
from treadline.streaming import live

PARTS = [p for r in LIMB_ROWS for p in r[4:6]] + list(AXIS_PARTS)


def pose_csv(path, n=60, low=()):
    head = [",".join(["scorer"] + ["net_y"] * 36), ",".join(["bodyparts"] + [p for p in PARTS for _ in range(3)]),
            ",".join(["coords"] + ["x", "y", "likelihood"] * 12)]
    rows = []
    for f in range(n):
        cells = [str(f)]
        for i, p in enumerate(PARTS):
            x = 0.5 * f + 10 * i + (6 * (f % 20 >= 10) * (f % 20 - 10))
            cells += [str(x), str(100 + i), "0.01" if (f, p) in low else "0.9"]
        rows.append(",".join(cells))
    with open(path, "w") as h:
        h.write("\n".join(head + rows) + "\n")


def test_pose_and_analysis(spark, tmp_path):
    pose_csv(tmp_path / "m1.csv", low={(3, "Nose"), (4, "LeftForeToe")})
    pose_csv(tmp_path / "m2.csv")
    with open(tmp_path / "m2.csv", "a") as h:
        h.write("broken,1,2\n")
    k = readers.read_pose(spark, str(tmp_path / "*.csv"), height=400.0)
    assert k.groupBy("trial_id").count().orderBy("trial_id").collect() == [("m1", 720), ("m2", 720)]
    r = k.where("trial_id = 'm1' and frame = 3 and bodypart = 'Nose'").first()
    assert r.x is None and r.y is None and r.likelihood == 0.01
    r = k.where("trial_id = 'm1' and frame = 2 and bodypart = 'Nose'").first()
    assert r.x == 0.5 * 2 + 10 * 8 and r.y == 400 - 108
    assert [x.value for x in readers.pose_errors(spark, str(tmp_path / "*.csv")).collect()] == ["broken,1,2"]
    assert readers.limb_keypoints(k).where("trial_id = 'm2'").count() == 240
    for mode in ("free", "treadmill"):
        res = analyze.analyze(k, 100.0, mode=mode, belt_speed=None if mode == "free" else 100.0, size=16)
        limbs = res["limbs"].collect()
        assert len(limbs) == 8 and all(x.n_strides >= 0 for x in limbs)
        assert res["contact"].count() == 2 * 4 * 60
        sinks.write_csv(sinks.summary_table(res["limbs"], limb_dimension(spark)), str(tmp_path / f"out_{mode}"))
        back = spark.read.option("header", "true").csv(str(tmp_path / f"out_{mode}"))
        assert back.count() == 8 and "paw_angle_mean_deg" in back.columns
    with pytest.raises(ValueError):
        (tmp_path / "empty.txt").write_text("nothing\n")
        readers.read_pose(spark, str(tmp_path / "empty.txt"))


def test_mixed_layouts(spark, tmp_path):
    for name, parts in (("a", ["P", "Q"]), ("b", ["Q"])):
        with open(tmp_path / f"{name}.csv", "w") as h:
            h.write("scorer," + ",".join(["s"] * 3 * len(parts)) + "\n" + "bodyparts," + ",".join(p for p in parts for _ in range(3)) + "\n")
            h.write("coords," + ",".join(["x", "y", "likelihood"] * len(parts)) + "\n" + "0," + ",".join(f"{i},{i},0.9" for i, _ in enumerate(parts)) + "\n")
    got = sorted((r.trial_id, r.bodypart, r.x) for r in readers.read_pose(spark, str(tmp_path)).collect())
    assert got == [("a", "P", 0.0), ("a", "Q", 1.0), ("b", "Q", 0.0)]


def test_file_catalogues(spark, tmp_path):
    for p in ("m1/t1/bottom.mp4", "m1/t1/left.mp4", "m1/t1/right.mp4", "m1/t1/top.mp4", "m1/t2/bottom.mp4", "m1/t3/notes.txt", "v/mouse.MP4",
              "v/mouseDLC_1.csv", "v/mouseDLC_1_filtered.csv", "v/mouseDLC_1_meta.json"):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text("xyz")
    files = readers.list_files(spark, str(tmp_path))
    s = {r.session_ts: r for r in readers.list_sessions(files).collect()}
    assert set(s) == {"t1", "t2"} and s["t1"].is_complete and s["t1"].total_size_bytes == 12
    assert s["t2"].roles_missing == ["left", "right", "top"]
    assert readers.list_videos(files).count() == 6
    o = readers.pose_outputs(files).where("video like '%mouse.MP4'").first()
    assert o.best_csv.endswith("mouseDLC_1_filtered.csv") and o.csv.endswith("mouseDLC_1.csv") and o.meta.endswith("_meta.json")


def test_truth_sources(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"print_id": 0, "frame_idx": 31, "cx_px": 200, "cy_px": 150}, {"print_id": 1, "frame_idx": 35, "cx_px": 250, "cy_px": 150, "paw_id": "LF"}]))
    g = readers.read_truth_json(spark, str(tmp_path / "g.json"))
    assert [(r.trial_id, r.print_id, r.paw_id) for r in g.orderBy("print_id").collect()] == [("g", 0, None), ("g", 1, "LF")]
    sinks.write_truth_json(g, str(tmp_path / "truth"))
    assert spark.read.json(str(tmp_path / "truth")).count() == 2
    (tmp_path / "sheet.csv").write_text("脚印,图像,首次着地时间(s),步幅(cm),步伐位置坐标\nLF,a,0.5,3.1,\"(133, 436)\"\nRF,b,0,3,\"(1, 2)\"\nRH,c,1.0,2,\"140, 430\"\n")
    t = readers.read_truth_sheet(spark, str(tmp_path / "sheet.csv")).orderBy("print_id").collect()
    assert [(r.print_id, r.frame_idx, r.cx_px, r.cy_px, r.paw_id) for r in t] == [(0, 31, 133.0, 436.0, "LF"), (1, 61, 140.0, 430.0, "RH")]
    (tmp_path / "press.csv").write_text("帧数,LF总,LF最大,LF最小,LF平均,RH平均\n1,10,4,1,2.5,7\n")
    p = {(r.limb, r.measure): r.value for r in readers.read_pressure_sheet(spark, str(tmp_path / "press.csv")).collect()}
    assert p == {("LF", "total"): 10, ("LF", "max"): 4, ("LF", "min"): 1, ("LF", "mean"): 2.5, ("RH", "mean"): 7}
    os.makedirs(tmp_path / "mouse_9")
    (tmp_path / "mouse_9/roi.txt").write_text("# frame tx1 ...\n1  128 150 459 274  78 100 509 324  23174\n")
    b = readers.read_body_boxes(spark, str(tmp_path / "mouse_9/roi.txt")).first()
    assert (b.trial_id, b.frame, b.tx1, b.ey2, b.area_px) == ("mouse_9", 1, 128, 324, 23174)


def test_exports(spark, tmp_path):
    from treadline.catalog import cycles as c
    d = c.det(spark, "/root/testdata/sf0.001").where("track_id <= 20")
    from treadline.operators import cycles
    cyc = cycles.number_cycles(cycles.build_cycles(d, ["trial_id"]).join(cycles.pressure_centre_path(d, ["trial_id"]), ["trial_id", "track_id"]), ["trial_id"])
    frames = cycles.frame_records(d).join(cyc.select("trial_id", "track_id", "cycle_id"), ["trial_id", "track_id"])
    sinks.write_trial(cyc, frames, str(tmp_path / "x"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "x/cycles_summary"))
    assert back.columns[:-1] == list(sinks.CYCLE_COLUMNS) and back.count() == cyc.count()
    doc = spark.read.json(str(tmp_path / "x/trial_data"))
    assert doc.select(F.sum(F.size("frames"))).first()[0] == frames.count()
    trials = cyc.select("trial_id").distinct().select("trial_id", F.lit("m-01 b").alias("animal_id"), F.lit("mouse").alias("species"),
                                                      F.lit("me").alias("operator"), F.lit("2024-05-06T10:00:00").alias("experiment_date"))
    lm = cyc.select("trial_id", F.lit("LF").alias("limb"), "duration_s")
    sinks.write_subjects(trials, frames.select("trial_id", "frame", "cx"), lm, cyc.select("trial_id", "cycle_id"), str(tmp_path / "b"))
    folder = tmp_path / "b/pose/subject=sub-m01b/session=ses-20240506"
    part = next(p for p in os.listdir(folder) if p.endswith(".gz"))
    assert gzip.open(folder / part, "rt").readline().strip().split("\t") == ["trial_id", "frame", "cx"]
    sinks.write_animal({"cycles": sinks.cycle_table(cyc)}, trials, str(tmp_path / "a"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "a/cycles")).count() == cyc.count()


def test_store_version_and_pruning(spark, tmp_path):
    d = spark.range(50).select(F.concat(F.lit("t"), (F.col("id") % 5).cast("string")).alias("trial_id"), F.col("id").alias("cycle_id"), F.lit(1).alias("v"))
    store.write_store({"cycle": d}, str(tmp_path), buckets=4)
    assert store.read_table(spark, str(tmp_path), "cycle", buckets=4).count() == 50
    one = store.read_table(spark, str(tmp_path), "cycle", trials=["t3"], buckets=4)
    assert {r.trial_id for r in one.collect()} == {"t3"} and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()
    old = spark.read.parquet(str(tmp_path / "cycle")).withColumn("schema_version", F.lit("1.4"))
    old.write.partitionBy("bucket").parquet(str(tmp_path / "old/cycle"))
    with pytest.raises(Exception, match="another major version"):
        store.read_table(spark, str(tmp_path / "old"), "cycle", buckets=4).collect()


def stream_of(spark, tmp_path, df, name):
    df.write.parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def drain(query):
    query.awaitTermination()
    return query


def test_stream_equals_batch(spark, tmp_path):
    sig = "1" * 30 + "0" * 12 + "1" * 4 + "0" * 3 + "1" * 25 + "0" * 60 + "1"
    df = spark.createDataFrame([(t, i, int(c)) for t in ("a", "b") for i, c in enumerate(sig)], "trial_id string, frame int, in_stance int")
    s = live.stream_traversals(stream_of(spark, tmp_path, df, "frames"), F.col("in_stance") == 1, min_frames=10, empty_frames=10)
    drain(s.writeStream.format("memory").queryName("runs").trigger(availableNow=True).start())
    want = contact.traversals(df, ["trial_id"], F.col("in_stance") == 1, min_frames=10, empty_frames=10).where("not flushed")
    got = sorted(tuple(r) for r in spark.table("runs").collect())
    assert got == sorted(tuple(r) for r in want.select("trial_id", "start", "end").collect()) and len(got) == 4


def test_open_traversal_is_closed_on_stored_frames(spark, tmp_path):
    sig = "1" * 30 + "0" * 40 + "1" * 25
    df = spark.createDataFrame([(t, i, int(c)) for t in ("a", "b") for i, c in enumerate(sig)], "trial_id string, frame int, in_stance int")
    active = F.col("in_stance") == 1
    s = live.stream_traversals(stream_of(spark, tmp_path, df, "frames"), active, min_frames=10, empty_frames=10)
    q = drain(s.writeStream.format("memory").queryName("closed").trigger(availableNow=True).start())
    late = live.LateRows(q)
    assert late.update() == 0 and late.update() == 0
    closed = spark.table("closed")
    rest = live.open_traversals(df, closed, active, min_frames=10, empty_frames=10)
    assert sorted(tuple(r) for r in closed.collect()) == [("a", 1, 30), ("b", 1, 30)]
    assert sorted(tuple(r) for r in rest.collect()) == [("a", 71, 95), ("b", 71, 95)]


def test_camera_set_across_a_window_edge(spark, tmp_path):
    # Number 1 straddles an hour and sends cam0 twice; number 2 lacks a role; number 3 is still open at the end.
    rows = [("cam0", 1, 3598), ("cam0", 1, 3599), ("cam1", 1, 3600), ("cam2", 1, 3603), ("cam0", 2, 4000), ("cam0", 2, 4001), ("cam1", 2, 4000),
            ("cam0", 3, 9000), ("cam1", 3, 9001), ("cam2", 3, 9001)]
    df = spark.createDataFrame(rows, "role string, frame_number long, s long").select(
        "role", "frame_number", F.timestamp_seconds("s").alias("ts"), (F.col("s") * 1000000000).alias("timestamp_ns"))
    s = live.stream_camera_sets(stream_of(spark, tmp_path, df, "cams"), "1 minute", n_roles=3)
    drain(s.writeStream.format("memory").queryName("sets").trigger(availableNow=True).start())
    closed = spark.table("sets")
    assert [tuple(r) for r in closed.collect()] == [(1, 3, 3000.0)]
    assert [tuple(r) for r in live.open_camera_sets(df, closed, n_roles=3).collect()] == [(3, 3, 1000.0)]


def test_metrics_per_traversal(spark, tmp_path):
    sig = "1" * 30 + "0" * 20 + "1" * 25 + "0" * 40 + "1"
    df = spark.createDataFrame([("a", i, int(c)) for i, c in enumerate(sig)], "trial_id string, frame int, in_stance int")
    s = live.stream_traversals(stream_of(spark, tmp_path, df, "frames"), F.col("in_stance") == 1, min_frames=10, empty_frames=10)
    out = []
    q = live.metrics_per_traversal(s, str(tmp_path / "frames"), lambda d, _: out.extend(tuple(r) for r in d.collect()),
                                   lambda rows: rows.groupBy("trial_id").agg(F.count("*").alias("n"), F.min("frame").alias("f")), str(tmp_path / "log"), {"availableNow": True})
    drain(q)
    assert sorted(out) == [("a#1", 30, 0), ("a#51", 25, 0)]


def test_stream_events_and_liveness(spark, tmp_path):
    lines = spark.createDataFrame([('{"event": "progress", "epoch": 2, "total_epochs": 8, "loss": 0.5}',), ("plain text",), ("{broken",),
                                   ('{"event": "error", "message": "boom", "exit_code": 3}',)], "value string")
    lines.coalesce(1).write.text(str(tmp_path / "log"))
    s = live.stream_events(spark.readStream.text(str(tmp_path / "log")))
    drain(s.writeStream.format("memory").queryName("ev").trigger(availableNow=True).start())
    got = {r.event: r for r in spark.table("ev").collect()}
    assert set(got) == {"progress", "error"} and got["progress"].fraction == 0.25 and got["error"].message == "boom" and got["error"].exit_code == 3
    pulses = spark.createDataFrame([("p", i) for i in range(5)], "source string, i int").select("source", F.timestamp_seconds("i").alias("ts"))
    # A processing-time timeout keeps the query alive, so it is polled and stopped rather than awaited.
    lv = live.stream_liveness(stream_of(spark, tmp_path, pulses, "pulses"), hz=10.0)
    q = lv.writeStream.format("memory").queryName("alive").outputMode("update").start()
    try:
        stop = time.time() + 40
        while time.time() < stop and not spark.table("alive").where("not alive").count():
            time.sleep(0.5)
    finally:
        q.stop()
    got = spark.table("alive").collect()
    assert {r["count"] for r in got} == {5} and {r.alive for r in got} == {True, False}


def test_rank_median(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 1, 9, 2)] + [("b", 3.0), ("c", None)], "k string, v double")
    got = sorted(tuple(r) for r in ordered.median(df, ["k"], "v", F.floor(F.col("v") / 3), "m").collect())
    assert got == [("a", 3.5), ("b", 3.0)]


def test_rank_quantile_of_a_frequent_value(spark):
    import numpy as np
    rows = [("hot", 7.0)] * 500 + [("hot", float(v)) for v in range(40)] + [("few", v / 3) for v in range(11)]
    df = spark.createDataFrame(rows, "k string, v double")
    for share in (0.0, 0.05, 0.5, 0.95, 1.0):
        got = dict(ordered.quantile(df, ["k"], "v", F.floor("v"), "q", share).collect())
        for k in ("hot", "few"):
            assert abs(got[k] - np.quantile([v for n, v in rows if n == k], share)) < 1e-9


def test_paths_over_chunks_equal_one_pass(spark):
    from treadline.operators import cycles
    rows = [("t", k, f, float((f * 7 + k) % 11), None if f == 9 and k else float((f * f) % 5)) for k in range(2) for f in (0, 3, 4, 9, 17, 18, 40)]
    df = spark.createDataFrame(rows, "trial_id string, track_id int, frame int, cx double, cy double")
    d = cycles.pressure_centre_path(df, ["trial_id"], size=4)
    got = {r.track_id: (r.cop_path_length_mm, r.cop_displacement_mm) for r in d.collect()}
    for k in range(2):
        at = [r[3:] for r in rows if r[1] == k]
        steps = [((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in zip(at, at[1:]) if None not in (*a, *b)]
        ends = ((at[-1][0] - at[0][0]) ** 2 + (at[-1][1] - at[0][1]) ** 2) ** 0.5
        assert got[k] == pytest.approx((sum(steps) / 1.92, ends / 1.92))
    # The rows meet once, by chunk, and no list of neighbours is made.
    assert "collect_list" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_prints_meet_the_nearest_track_once(spark):
    from treadline.operators import matching
    truth = [("t", i, i * 3 % 40) for i in range(30)]
    blobs = [("t", i % 9, (i * 7 + i * i) % 60, i * 5 % 13) for i in range(40)]
    t = spark.createDataFrame(truth, "trial_id string, print_id long, frame_idx int")
    b = spark.createDataFrame(blobs, "trial_id string, track_id long, frame int, area_px int")
    want = set()
    for _, i, f in truth:
        near = [(abs(g - f), k) for _, k, g, _ in blobs if abs(g - f) <= 2]
        if near:
            gap, k = min(near)
            own = [(a, -g) for _, j, g, a in blobs if j == k]
            here = [a for a, g in own if -g == f]
            want.add((i, k, gap, f if here else -max(own)[1], max(here) if here else max(own)[0]))
    d = matching.nearest_track(t, b, ["trial_id"], tolerance=2)
    assert {(r.print_id, r.track_id, r.frame_gap, r.blob_frame, r.area_px) for r in d.collect()} == want
    # No row per print and frame in reach: prints are not aggregated over offers.
    lines = [x for x in d._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert not any("print_id" in x and "min(" in x for x in lines)


def test_recall_joins_places_once(spark):
    from treadline.operators import matching
    truth = [("t", f, float(i * 13 % 97), float(i * 31 % 89)) for f in range(3) for i in range(40)] + [("t", 7, 5.0, 5.0), ("t", 0, None, 1.0)]
    det = [("t", f, float(i * 29 % 101), float(i * 17 % 53)) for f in range(3) for i in range(12)] + [("t", 0, -10.0, 0.0), ("t", 1, None, 3.0)]
    a = spark.createDataFrame(truth, "trial_id string, frame int, x double, y double")
    b = spark.createDataFrame(det, "trial_id string, frame int, cx double, cy double")
    got = sorted(((r.frame, r.x or -1.0, r.y, r.hit) for r in matching.recalled(a, b, 10.0).collect()))
    near = lambda t, d: t[1] == d[1] and None not in (t[2], d[2]) and ((t[2] - d[2]) ** 2 + (t[3] - d[3]) ** 2) ** 0.5 <= 10.0
    assert got == sorted((t[1], t[2] or -1.0, t[3], any(near(t, d) for d in det)) for t in truth) and {r[3] for r in got} == {True, False}
    # One join by cells, on the distinct places of the truth, and none for the rows that are missed.
    plan = matching.recalled(a, b, 10.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 1 and "LeftAnti" not in plan


def test_medians_of_tracks_read_stored_blobs(spark):
    from treadline.operators import tracking
    rows = [("t", i % 3, i, i * 7 % 5, float(i * 3 % 8), float(i * 5 % 7)) for i in range(30)]
    df = spark.createDataFrame(rows, "trial_id string, track_id int, frame int, area_px int, cx double, cy double")
    d = tracking.track_predictions(df, ["trial_id"])
    for r in d.collect():
        own = [x for x in rows if x[1] == r.track_id]
        assert (r.cx, r.cy, r.n_strong) == (np.median([x[4] for x in own]), np.median([x[5] for x in own]), len(own))
        assert r.frame_idx == min(own, key=lambda x: (-x[3], x[2]))[2]
    assert "LogicalRDD" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_cycle_documents_number_detections_once(spark):
    import __spark_entry__
    d = __spark_entry__.queries()["cycle_documents"](spark, "/root/testdata/sf0.001")
    assert "row_number" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert d.count() > 0


def test_only_peak_frames_become_pixels(spark):
    import __spark_entry__
    d = __spark_entry__.queries()["peak_composite"](spark, "/root/testdata/sf0.001")
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Generate explode"):]
