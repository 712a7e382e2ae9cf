"""Trackers, matchers, labelling and geometry against plain brute force on small random inputs."""
import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from treadline.operators import matching, multiview, ordered, pixels, tracking

T = ["trial_id"]


def brute_iou(dets, iou_min, gap, memory):
    live, owner, n = [], {}, 0
    for f in sorted({d[0] for d in dets}):
        live = [t for t in live if f - t["last"] <= gap]
        here = [(i, set(m)) for (g, i, m) in dets if g == f]
        cand = []
        for ti, t in enumerate(live):
            ref = set().union(*t["masks"][-memory:])
            for di, (_, m) in enumerate(here):
                u = len(ref | m)
                cand.append((float(np.float32(len(ref & m) / u)), ti, di))
        used_t, used_d = set(), set()
        for s, ti, di in sorted(cand, reverse=True):
            if s < iou_min:
                break
            if ti in used_t or di in used_d:
                continue
            used_t.add(ti), used_d.add(di)
            live[ti]["masks"].append(here[di][1])
            live[ti]["last"] = f
            owner[(f, here[di][0])] = live[ti]["id"]
        for di, (i, m) in enumerate(here):
            if di not in used_d:
                live.append({"id": n, "masks": [m], "last": f})
                owner[(f, i)] = n
                n += 1
    return owner


def test_candidates_of_a_busy_frame_are_sparse():
    """20,000 tracks and detections of which each meets one or none: a dense table would be 3 GB."""
    n = 20_000
    masks = [np.arange(3 * i, 3 * i + 2) for i in range(n)]
    rng = np.random.default_rng(1)
    ref = np.column_stack([np.arange(n) * 10.0 - 99_000, rng.integers(0, 2, n) * 1000.0])
    tracemalloc.start()
    ti, di, both = tracking._overlaps(masks, masks[::-1])
    t, d, far = tracking._within(ref, ref[::-1] + 3, 5.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (ti + di == n - 1).all() and len(ti) == n and set(both) == {2}
    assert (t + d == n - 1).all() and len(t) == n and np.allclose(far, math.hypot(3, 3))
    assert peak < 100e6


def test_near_points_match_all_pairs():
    rng = np.random.default_rng(2)
    for radius in (0.0, 1.0, 2.5, 50.0):
        ref, xy = (rng.integers(-9, 9, (k, 2)).astype(float) for k in (70, 90))
        ref[3], xy[5, 1] = np.nan, np.nan
        d = np.hypot(ref[:, :1] - xy[:, 0], ref[:, 1:] - xy[:, 1])
        want = np.nonzero(d <= radius)
        t, at, far = tracking._within(ref, xy, radius)
        assert t.tolist() == want[0].tolist() and at.tolist() == want[1].tolist() and far.tolist() == d[want].tolist()
        assert not len(tracking._within(ref, xy[:0], radius)[0])


@pytest.mark.parametrize("pairs", [1, 30, 1 << 20])
def test_nearest_rows_of_a_crowd(pairs):
    """Crowded and sparse places, equal distances, sizes that don't fit: the nearest in gap, distance and order of all pairs."""
    rng = np.random.default_rng(4)
    for n, m, wide, gaps in ((50, 80, 6, [1, 2]), (60, 40, 90, [-1, -2]), (30, 300, 40, [0])):
        ratio = (0.5, 2.0) if gaps != [0] else None
        q, c = ({"f": rng.integers(0, 6, k), "x": rng.integers(-wide, wide, k).astype(float), "y": rng.integers(0, wide, k).astype(float), "w": rng.integers(1, 20, k).astype(float)} for k in (n, m))
        to, gap, far = tracking._nearest(q, c, 12.0, gaps, ratio, pairs)
        for i in range(n):
            cand = []
            for j in range(m):
                d, g = math.hypot(q["x"][i] - c["x"][j], q["y"][i] - c["y"][j]), c["f"][j] - q["f"][i]
                late, early = (c["w"][j], q["w"][i]) if gaps[0] > 0 else (q["w"][i], c["w"][j])
                if g in gaps and d <= 12.0 and (ratio is None or 0.5 <= late / early <= 2.0):
                    cand.append((abs(g), d, j))
            assert to[i] == (min(cand)[2] if cand else -1), (i, cand)


@pytest.mark.parametrize("pairs", [1, 20, 1 << 19])
def test_busy_frames_are_linked_without_all_pairs(pairs, monkeypatch):
    """Tracks and detections that crowd in one place, many of them equal: any number of pairs held at a time gives the greedy order of all."""
    monkeypatch.setattr(tracking, "PAIRS", pairs)
    rng = np.random.default_rng(6)
    for n, m, wide in ((40, 30, 6), (25, 60, 15), (30, 30, 2)):
        refs, masks = ([np.unique(rng.integers(0, wide, 4)) for _ in range(k)] for k in (n, m))
        cand = sorted(((float(np.float32(len(np.intersect1d(r, d)) / len(np.union1d(r, d)))), t, i) for t, r in enumerate(refs) for i, d in enumerate(masks)), reverse=True)
        want, used = [None] * m, set()
        for score, t, i in cand:
            if score >= 0.3 and t not in used and want[i] is None:
                used.add(t)
                want[i] = t
        assert tracking._by_overlap(refs, masks, [False] * n, 0.3)[0] == want
        ref, xy = (rng.integers(0, wide, (k, 2)).astype(float) for k in (n, m))
        tracker = tracking._CentroidTracker(3.0, 3)
        tracker.step(0, np.arange(n), ref[:, 0], ref[:, 1])
        got = tracker.step(1, np.arange(m), xy[:, 0], xy[:, 1])
        want, used = [f"1:{i}" for i in range(m)], set()
        for d, t, i in sorted((math.hypot(*(r - p)), t, i) for t, r in enumerate(ref) for i, p in enumerate(xy)):
            if d <= 3.0 and t not in used and want[i] == f"1:{i}":
                used.add(t)
                want[i] = f"0:{t}"
        assert [own for _, own in got] == want


@pytest.mark.parametrize("size", [4, ordered.CHUNK])
def test_iou_tracks_match_brute_force(spark, size):
    rng = random.Random(5)
    trials = {}
    for t in ("a", "b"):
        dets = []
        for f in range(60):
            if f % 17 in (4, 5, 6, 7, 8):
                continue
            for i in range(rng.randint(0, 4)):
                x, y = rng.randint(0, 8), rng.randint(0, 8)
                dets.append((f, i, [(y + dy) * 100 + x + dx for dx in range(5) for dy in range(5)]))
        trials[t] = dets
    df = spark.createDataFrame([(t, *d) for t, ds in trials.items() for d in ds], "trial_id string, frame int, det_id int, mask array<int>")
    got = {(r.trial_id, r.frame, r.det_id): r.track_id for r in tracking.link_by_iou(df.repartition(3), T, size=size).collect()}
    for t, dets in trials.items():
        want = brute_iou(dets, 0.3, 3, 5)
        assert {k[1:]: v for k, v in got.items() if k[0] == t} == want


def test_iou_tracks_of_a_still_box(spark):
    box = [(y * 1920 + x) for y in range(20) for x in range(20)]
    rows = [("a", f, 0, box) for f in range(1, 6)] + [("b", 1, 0, box), ("b", 5, 0, [p + 500 for p in box])]
    df = spark.createDataFrame(rows, "trial_id string, frame int, det_id int, mask array<int>")
    d = tracking.link_by_iou(df, T, max_gap=2)
    assert d.where("trial_id = 'a'").select("track_id").distinct().count() == 1
    assert d.where("trial_id = 'b'").select("track_id").distinct().count() == 2


def brute_match(pred, gt, dist, tol):
    taken, out = set(), {}
    for p, pf, px, py in sorted(pred):
        best = None
        for g, gf, gx, gy in gt:
            d = math.hypot(gx - px, gy - py)
            if g not in taken and abs(gf - pf) <= tol and d <= dist and (best is None or d < best[0]):
                best = (d, g)
        if best:
            taken.add(best[1])
            out[p] = best[1]
    return out


def test_predictions_match_brute_force(spark):
    rng = random.Random(3)
    pred = [(i, rng.randint(0, 30), rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(120)]
    gt = [(i, rng.randint(0, 30), rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(90)]
    p = spark.createDataFrame([("a", *r) for r in pred], "trial_id string, pred_id int, frame_idx int, cx double, cy double")
    g = spark.createDataFrame([("a", *r) for r in gt], "trial_id string, print_id int, frame_idx int, cx_px double, cy_px double")
    m = matching.match_predictions(p, g, T)
    got = {r.pred_id: r.print_id for r in m.collect()}
    want = brute_match(pred, gt, 25.0, 5)
    assert got == want
    e = matching.evaluate(m, p, g, T).first()
    err = sorted(math.hypot(gt[v][2] - pred[k][2], gt[v][3] - pred[k][3]) for k, v in want.items())
    assert e.n_tp == len(want) and e.n_fp == 120 - len(want) and e.n_fn == 90 - len(want)
    assert e.median_error_px == pytest.approx(err[len(err) // 2]) and e.mean_error_px == pytest.approx(sum(err) / len(err))


@pytest.mark.parametrize("spatial", [True, False])
def test_crowded_predictions_match_brute_force_in_blocks(spark, spatial):
    """Predictions that compete over the edges of blocks of frames and tiles; equal distances go to the smaller id."""
    rng = random.Random(8)
    pred = [(i, rng.randint(0, 40), float(rng.randint(0, 60)), float(rng.randint(0, 60))) for i in range(300)]
    gt = [(i, rng.randint(0, 40), float(rng.randint(0, 60)), float(rng.randint(0, 60))) for i in range(100)]
    p = spark.createDataFrame([("a", *r) for r in pred], "trial_id string, pred_id int, frame_idx int, cx double, cy double")
    g = spark.createDataFrame([("a", *r) for r in gt], "trial_id string, print_id int, frame_idx int, cx_px double, cy_px double")
    near, taken = brute_match(pred, gt, 9.0, 2) if spatial else {}, set()
    for i, f, *_ in pred if not spatial else ():
        free = sorted((abs(f - h), k) for k, h, *_ in gt if abs(f - h) <= 2 and k not in taken)
        if free:
            taken.add(free[0][1])
            near[i] = free[0][1]
    m = matching.match_predictions(p, g, T, 9.0, 2, spatial=spatial, frames=16, block_rows=20)
    assert {r.pred_id: r.print_id for r in m.collect()} == near


def test_closest_area_takes_no_pairs_and_ties_by_label(spark):
    """16 and 25 are equally far from 20, on a log scale; the logarithms differ in the last place."""
    t = spark.createDataFrame([("a", 1, i, 20) for i in range(3)] + [("a", 1, 3, 200), ("a", 1, 4, 7), ("a", 1, 5, 0)], "trial_id string, frame int, print_id int, gt_area int")
    b = spark.createDataFrame([("a", 1, 9, 16), ("a", 1, 8, 16), ("a", 1, 5, 25), ("a", 1, 7, 26), ("a", 1, 1, 4), ("a", 2, 0, 20)], "trial_id string, frame int, label int, area_px int")
    for blobs, label in ((b, 5), (b.withColumn("label", 10 - F.col("label")), 1)):
        got = {r.print_id: (r.label, round(r.log_ratio, 9)) for r in matching.closest_area(t, blobs, ["trial_id", "frame"]).collect()}
        small = 8 if label == 5 else 1
        assert got == {**{i: (label, round(math.log(1.25), 9)) for i in range(3)}, 4: (small, round(math.log(16 / 7), 9))}
    plan = matching.closest_area(t, b, ["trial_id", "frame"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_crowded_predictions_take_no_pairs():
    """1,000 predictions at 1,000 prints: all pairs would take 30 MB."""
    ids = np.arange(1000)
    p, t = (pd.DataFrame({"_f": 0, "_x": 0.0, "_y": 0.0, n: ids}) for n in ("_rank", "_limit"))
    for solve in (lambda: matching._nearest_free(p, t, 5.0, 2, pairs=20_000), lambda: matching._soonest_free(p, t, 2)):
        tracemalloc.start()
        to, far = solve()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert to.tolist() == ids.tolist() and not far.any() and peak < 8e6


def test_evaluation_examples(spark):
    g = spark.createDataFrame([("a", 0, 31, 100.0, 100.0)], "trial_id string, print_id int, frame_idx int, cx_px double, cy_px double")
    near = spark.createDataFrame([("a", 0, 31, 105.0, 105.0)], "trial_id string, pred_id int, frame_idx int, cx double, cy double")
    far = near.withColumn("frame_idx", F.lit(50))
    r = matching.evaluate(matching.match_predictions(near, g, T, distance_px=10.0), near, g, T).first()
    assert r.n_tp == 1 and r.mean_error_px == pytest.approx(7.0711, abs=1e-4) and r.f1 == 1.0
    r = matching.evaluate(matching.match_predictions(far, g, T), far, g, T).first()
    assert (r.n_tp, r.n_fp, r.precision) == (0, 1, 0.0)
    # Matched by time alone there is no error in pixels, however far apart the frames are.
    late = near.withColumn("frame_idx", F.lit(33))
    r = matching.evaluate(matching.match_predictions(late, g, T, spatial=False), late, g, T).first()
    assert (r.n_tp, r.mean_error_px, r.median_error_px) == (1, 0.0, 0.0)


def brute_labels(px):
    left, out, n = set(px), {}, 0
    for p in sorted(px, key=lambda q: (q[1], q[0])):
        if p not in left:
            continue
        n += 1
        todo = [p]
        left.discard(p)
        while todo:
            x, y = todo.pop()
            out[(x, y)] = n
            for q in [(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if q in left:
                    left.discard(q)
                    todo.append(q)
    return out


def test_labels_match_flood_fill(spark):
    rng = random.Random(1)
    frames = {f: [(x, y) for x in range(14) for y in range(11) if rng.random() < 0.33] for f in range(25)}
    rows = [("a", f, x, y) for f, px in frames.items() for x, y in px]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # batches that cut frames
    try:
        got = pixels.label_blobs(spark.createDataFrame(rows, "trial_id string, frame int, x int, y int")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for r in got:
        by.setdefault(r.frame, {})[(r.x, r.y)] = r.label
    for f, px in frames.items():
        want = brute_labels(px)
        same = {}
        assert set(by[f]) == set(want)
        for k, w in want.items():
            assert same.setdefault(w, by[f][k]) == by[f][k]
        assert len(set(same.values())) == len(same)


def test_blob_groups_are_transitive(spark):
    rng = random.Random(2)
    pts = {f: [(i + 1, rng.uniform(0, 150), rng.uniform(0, 150)) for i in range(30)] for f in range(6)}
    df = spark.createDataFrame([("a", f, i, x, y) for f, ps in pts.items() for i, x, y in ps], "trial_id string, frame int, label int, cx double, cy double")
    got = {(r.frame, r.label): r.foot_id for r in matching.group_blobs(df, 25.0).collect()}
    for f, ps in pts.items():
        root = {i: i for i, _, _ in ps}
        for _ in ps:
            for i, x, y in ps:
                for j, u, v in ps:
                    if math.hypot(x - u, y - v) <= 25.0:
                        root[i] = root[j] = min(root[i], root[j])
        a = {}
        for i, _, _ in ps:
            assert a.setdefault(root[i], got[(f, i)]) == got[(f, i)]
        assert len(set(a.values())) == len(a)


def test_identity_carry_over(spark):
    rng = random.Random(9)
    names = ["LF", "RF", "LH", "RH"]
    frames = [[(n, rng.uniform(0, 120), rng.uniform(0, 120)) for n in names if rng.random() < 0.7] for _ in range(50)]
    last, want = {}, {}
    for f, feet in enumerate(frames):
        known = list(last)
        c = sorted((math.hypot(x - last[k][0], y - last[k][1]), i, j) for i, (_, x, y) in enumerate(feet) for j, k in enumerate(known))
        ri, rj, ok = set(), set(), {}
        for d, i, j in c:
            if i not in ri and j not in rj:
                ri.add(i), rj.add(j)
                if d <= 50.0:
                    ok[i] = known[j]
        for i, k in ok.items():
            last[k] = feet[i][1:]
        for i, (n, x, y) in enumerate(feet):
            if i not in ok:
                last[n] = (x, y)
            want[(f, n)] = ok.get(i, n)
    df = spark.createDataFrame([("a", f, n, names.index(n), x, y) for f, ft in enumerate(frames) for n, x, y in ft],
                               "trial_id string, frame int, limb string, limb_ord int, cx double, cy double")
    got = {(r.frame, r.limb): r.identity for r in tracking.carry_identity(df.repartition(5), T).collect()}
    assert got == want


def track(tid, s, e, a, z, area):
    return [("t", tid, f, a[0] + (z[0] - a[0]) * (f - s) / max(e - s, 1), a[1] + (z[1] - a[1]) * (f - s) / max(e - s, 1), area, True) for f in range(s, e + 1)]


def merged(spark, *tracks):
    df = spark.createDataFrame([r for t in tracks for r in t], "trial_id string, track_id int, frame int, cx double, cy double, area_px int, is_strong boolean")
    return {r.track_id: r.merged_id for r in tracking.merge_tracks(df, T).collect()}


def test_track_merging(spark):
    assert merged(spark, track(0, 1, 10, (50, 200), (100, 200), 100), track(1, 13, 20, (105, 205), (150, 200), 100)) == {0: 0, 1: 0}
    assert merged(spark, track(0, 1, 4, (100, 100), (100, 100), 80), track(1, 6, 8, (102, 101), (104, 102), 80), track(2, 10, 13, (106, 103), (110, 104), 80)) == {0: 0, 1: 0, 2: 0}
    assert merged(spark, track(0, 1, 10, (100, 100), (200, 100), 100), track(1, 12, 20, (900, 900), (1000, 900), 100)) == {0: 0, 1: 1}
    assert merged(spark, track(0, 1, 5, (100, 100), (100, 100), 100), track(1, 20, 25, (100, 100), (100, 100), 100)) == {0: 0, 1: 1}
    assert merged(spark, track(0, 1, 10, (100, 100), (100, 100), 500), track(1, 12, 20, (105, 100), (105, 100), 50)) == {0: 0, 1: 1}


def test_two_level_tracks(spark):
    strong = spark.createDataFrame([("a", f, 0, 200.0 + 20 * f, 150.0, 400) for f in range(1, 11)], "trial_id string, frame int, det_id int, cx double, cy double, area_px int")
    weak = spark.createDataFrame([("a", f, i, x, 150.0, 20) for f in range(1, 4) for i, x in ((5, 200.0 + 20 * f + 20), (6, 1100.0))],
                                 "trial_id string, frame int, det_id int, cx double, cy double, area_px int")
    t = tracking.link_by_centroid(strong, T)
    s = tracking.two_level_summary(t, tracking.attach_weak(t, weak, T), T).collect()
    assert len(s) == 1 and s[0].n_strong == 10 and s[0].n_weak == 3 and s[0].is_valid


def rig(spark):
    from treadline.catalog.scalar import rig as make
    return make(spark)


def test_triangulation_and_refinement(spark):
    rng = np.random.default_rng(4)
    pts = rng.uniform(-0.5, 0.5, (40, 2, 3))
    df = spark.createDataFrame([("a", f, f"j{j}", *map(float, pts[f, j])) for f in range(40) for j in range(2)], "trial_id string, frame int, joint string, x double, y double, z double")
    keys = ["trial_id", "frame", "joint"]
    obs = multiview.project_points(df, rig(spark)).select(*keys, "camera", "u", "v")
    noise = F.when((F.col("camera") == "cam1") & (F.col("frame") % 4 == 0), 60.0).otherwise(0.0)
    views = multiview.gather_views(obs.withColumn("u", F.col("u") + noise), rig(spark), keys)
    got = multiview.triangulate(views, keys).collect()
    assert len(got) == 80
    for r in got:
        assert np.allclose((r.x, r.y, r.z), pts[r.frame, int(r.joint[1])], atol=1e-6)
        assert r.confidence == pytest.approx(1 / (1 + r.reproj_err))
    # A camera that did not see the joint drops the point; an unknown camera is ignored.
    gone = obs.withColumn("v", F.when((F.col("frame") == 3) & (F.col("camera") == "cam0"), F.lit(None)).otherwise(F.col("v")))
    assert multiview.gather_views(gone, rig(spark), keys).where("frame = 3").count() == 0
    absent = obs.where("frame <> 3 OR camera <> 'cam0'")
    assert multiview.gather_views(absent, rig(spark), keys).where("frame = 3").count() == 0
    assert multiview.gather_views(absent, rig(spark), keys, complete=False).where("frame = 3").count() > 0
    start = df.withColumns({c: F.col(c) + 0.03 for c in "xyz"})
    clean = multiview.gather_views(obs, rig(spark), keys)
    bones = [("j0", "j1", float(np.linalg.norm(pts[0, 0] - pts[0, 1])))]
    out = multiview.refine(start.where("frame = 0"), clean.where("frame = 0"), bones).collect()
    for r in out:
        assert np.allclose((r.x, r.y, r.z), pts[0, int(r.joint[1])], atol=1e-5)


def test_frames_refined_together_equal_frames_refined_alone(spark):
    """Frames that lack joints, joints that a camera missed, and a joint without a position, in one batch."""
    rng = np.random.default_rng(8)
    keys = ["trial_id", "frame", "joint"]
    pts = rng.uniform(-0.5, 0.5, (12, 3, 3))
    rows = [("a" if f % 2 else None, f, f"j{j}", *map(float, pts[f, j])) for f in range(12) for j in range(3) if (f, j) != (5, 1)]
    df = spark.createDataFrame(rows, "trial_id string, frame int, joint string, x double, y double, z double").fillna("b")
    obs = multiview.project_points(df, rig(spark)).select(*keys, "camera", (F.col("u") + F.col("frame") % 3).alias("u"), "v")
    views = multiview.gather_views(obs.where("NOT (frame = 2 AND joint = 'j2' AND camera = 'cam0')"), rig(spark), keys, complete=False)
    start = df.withColumns({c: F.when(F.expr("frame <> 7 OR joint <> 'j0'"), F.col(c) + 0.02) for c in "xyz"})
    bones = [("j0", "j1", 0.4), ("j1", "j2", 0.3)]
    place = lambda rows: {(r.frame, r.joint): (r.x, r.y, r.z) for r in rows}
    got = place(multiview.refine(start, views, bones).collect())
    assert len(got) == len(rows) and got[7, "j0"] == (None, None, None)
    for f in (2, 4, 5, 7):
        alone = place(multiview.refine(start.where(F.col("frame") == f), views.where(F.col("frame") == f), bones).collect())
        for k, xyz in alone.items():
            assert xyz == got[k] or np.allclose(xyz, got[k], atol=1e-9)
    # A stationary point of the cost: a small step in any direction doesn't lower it.
    cams = {r.camera: np.reshape(r.p, (3, 4)) for r in rig(spark).collect()}
    seen = {(r.joint, r.camera): (r.u, r.v) for r in obs.where("frame = 4").collect()}

    def cost(x):
        off = sum(((q := cams[c] @ [*x[int(j[1])], 1.0])[0] / q[2] - u) ** 2 + (q[1] / q[2] - v) ** 2 for (j, c), (u, v) in seen.items())
        return off + sum((100 * (np.linalg.norm(x[m] - x[m + 1]) - t)) ** 2 for m, t in ((0, 0.4), (1, 0.3)))
    best = np.array([got[4, f"j{j}"] for j in range(3)])
    for step in 1e-4 * rng.normal(size=(30, 3, 3)):
        assert cost(best + step) > cost(best)


def test_fewer_than_two_cameras_is_an_error(spark):
    keys = ["trial_id", "frame", "joint"]
    df = spark.createDataFrame([("a", 0, "j0", 0.1, 0.1, 0.1), ("b", 0, "j0", 0.2, 0.2, 0.2)], "trial_id string, frame int, joint string, x double, y double, z double")
    obs = multiview.project_points(df, rig(spark)).select(*keys, "camera", "u", "v").where("trial_id = 'a' OR camera = 'cam0'")
    with pytest.raises(Exception, match="fewer than two cameras"):
        multiview.gather_views(obs, rig(spark), keys).collect()
    assert [r.trial_id for r in multiview.gather_views(obs, rig(spark), keys, complete=False).collect()] == ["a"]


def test_foot_intensity_counts_shared_pixels_once(spark):
    """Boxes of a foot that overlap, boxes at the edge of the image, and a foot outside of it."""
    rng = np.random.default_rng(3)
    image = {(f, x, y): int(rng.integers(0, 256)) for f in range(3) for x in range(12) for y in range(9)}
    boxes = [(0, 1, 1, 0, 0, 4, 4, 9), (0, 2, 1, 2, 2, 6, 5, 5), (0, 3, 3, 8, 6, 14, 11, 7), (1, 1, 1, 1, 1, 2, 2, 1), (2, 1, 1, 30, 30, 33, 33, 9)]
    blobs = spark.createDataFrame([(*b, (b[3] + b[5]) / 2, (b[4] + b[6]) / 2) for b in boxes],
                                  "frame int, label int, foot_id int, x1 int, y1 int, x2 int, y2 int, area_px int, cx double, cy double")
    px = spark.createDataFrame([(*k, v) for k, v in image.items()], "frame int, x int, y int, g int")
    got = {(r.frame, r.foot_id): r for r in matching.merge_blobs(blobs, ("frame",), pixels=px).collect()}
    assert set(got) == {(0, 1), (0, 3), (1, 1), (2, 1)}
    for (frame, foot), r in got.items():
        own = [b for b in boxes if (b[0], b[2]) == (frame, foot)]
        v = [g for (f, x, y), g in image.items() if f == frame and any(b[3] <= x < b[5] and b[4] <= y < b[6] for b in own)] or [0]
        assert (r.intensity_max, r.intensity_min, r.intensity_total) == (max(v), min(v), sum(v)) and r.intensity_mean == pytest.approx(np.mean(v))


def test_unions_of_pixels_shuffle_detections_only(spark):
    from treadline.catalog import load
    for name in ("track_pixels", "union_projection"):
        plan = load().QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert dealt and not any("track_id" in line and " y#" in line for line in dealt)
