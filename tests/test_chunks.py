"""Trackers in chunks of frames, on recordings without a break, next to one plain pass over all frames."""
import numpy as np
import pytest

from treadline.operators import tracking

T = ["trial_id"]


def detections(seed, frames, crowd):
    """Boxes that wander and meet; some frames repeat a mask, so that scores tie."""
    rng = np.random.default_rng(seed)
    at, rows = rng.integers(0, 40, (crowd, 2)), []
    for f in range(frames):
        at = np.clip(at + rng.integers(-3, 4, at.shape), 0, 60)
        k = 0
        for x, y in at:
            if rng.random() < 0.15:
                continue
            cells = sorted({int((y + j) * 100 + x + i) for i in range(6) for j in range(6) if rng.random() < 0.9})
            for _ in range(2 if rng.random() < 0.1 else 1):
                rows.append(("t", f, k, cells, float(x), float(y)))
                k += 1
        if not k:
            rows.append(("t", f, 0, [9999], 99.0, 99.0))
    return rows


def plain(rows, tracker, take):
    """One pass of the tracker's rules, without chunks."""
    frames, names, t = {}, {}, tracker()
    for r in rows:
        frames.setdefault(r[1], []).append(r)
    for f in sorted(frames):
        got = t.step(f, *[np.array([take(r)[c] for r in frames[f]] + [None], dtype=object)[:-1] for c in range(len(take(rows[0])))])
        for r, (_, own) in zip(frames[f], got):
            names[r[1], r[2]] = own
    return names


def rising(names):
    """Numbers by first detection."""
    order = sorted(set(names.values()), key=lambda n: tuple(map(int, n.split(":"))))
    return {k: order.index(n) for k, n in names.items()}


@pytest.mark.parametrize("seed, warm", [(1, 8), (2, 2), (3, 0)])
def test_iou_chunks(spark, seed, warm):
    rows = detections(seed, 70, 5)
    df = spark.createDataFrame([r[:4] for r in rows], "trial_id string, frame int, det_id int, mask array<int>")
    want = rising(plain(rows, lambda: tracking._IouTracker(0.3, 3, 5), lambda r: (r[2], np.array(r[3]))))
    got = {(r.frame, r.det_id): r.track_id for r in tracking.link_by_iou(df, T, frames=10, warm=warm).collect()}
    assert got == want


def test_parts_of_an_image_are_tracked_apart(spark):
    rows = detections(6, 40, 4)
    far = [(t, f, 100 + k, [c + 10_000_000 for c in cells], x, y) for t, f, k, cells, x, y in detections(7, 40, 4)]
    both = sorted(rows + far + [("t", 5, 900, [], 0.0, 0.0)], key=lambda r: r[1:3])
    df = spark.createDataFrame([(*r[:4], r[4]) for r in both], "trial_id string, frame int, det_id int, mask array<int>, x double")
    want = rising(plain([r for r in both if r[3]], lambda: tracking._IouTracker(0.3, 3, 5), lambda r: (r[2], np.array(r[3]))))
    # The crowd's masks connect its strips of 256 pixels, but not the two crowds; the strips of an empty image are no parts.
    parts = tracking.mask_parts(df.where("det_id < 900"), T, strip=256).groupBy("_part").agg({"det_id": "max"}).collect()
    assert len(parts) >= 2 and any(r[1] < 100 for r in parts) and any(r[1] >= 100 for r in parts)
    got = tracking.link_by_iou(df.where("det_id < 900"), T, frames=10, warm=8, strip=256, keep=["x"])
    assert got.columns[-2:] == ["x", "track_id"]
    assert {(r.frame, r.det_id): r.track_id for r in got.collect()} == want
    assert tracking.link_by_iou(df, T, frames=10, warm=8, strip=256).where("det_id = 900").count() == 1


@pytest.mark.parametrize("seed, warm", [(4, 6), (5, 0)])
def test_centroid_chunks(spark, seed, warm):
    rows = detections(seed, 70, 5)
    df = spark.createDataFrame([(*r[:3], *r[4:]) for r in rows], "trial_id string, frame int, det_id int, cx double, cy double")
    want = rising(plain(rows, lambda: tracking._CentroidTracker(8.0, 3), lambda r: (r[2], r[4], r[5])))
    got = {(r.frame, r.det_id): r.track_id for r in tracking.link_by_centroid(df, T, radius=8.0, frames=10, warm=warm).collect()}
    assert got == want


@pytest.mark.parametrize("seed, swap, warm", [(6, 0.0, 6), (7, 0.3, 6), (8, 0.05, 0)])
def test_identity_chunks(spark, seed, swap, warm):
    """Names are swapped at the very start or all along; a foot that jumps takes over its tentative name."""
    rng = np.random.default_rng(seed)
    home, rows = {"LF": (0.0, 0.0), "RF": (0.0, 40.0), "LH": (60.0, 0.0), "RH": (60.0, 40.0)}, []
    for f in range(50):
        feet = [(n, home[n][0] + f + rng.normal(), home[n][1] + rng.normal()) for n in home if rng.random() < 0.9]
        names = [n for n, _, _ in feet]
        if f < 3 or rng.random() < swap:
            names = [names[i] for i in rng.permutation(len(names))]
        for k, (n, (_, x, y)) in enumerate(zip(names, feet)):
            jump = 500.0 if rng.random() < 0.01 else 0.0
            rows.append(("t", f, k, n, float(x + jump), float(y)))
    df = spark.createDataFrame([(*r[:2], r[3], r[2], *r[4:]) for r in rows], "trial_id string, frame int, limb string, limb_ord int, cx double, cy double")
    want = plain(rows, lambda: tracking._IdentityTracker(50.0), lambda r: r[3:])
    got = {(r.frame, r.limb_ord): r.identity for r in tracking.carry_identity(df, T, frames=10, warm=warm).collect()}
    assert got == want


def test_only_open_chunks_run_again():
    """A guess with the same tracks in another order holds if no order decided anything."""
    new = lambda own, digest: {"slot": -1, "own": own, "digest": digest}
    first = {"_chunk": 0, "_entry": [], "_exit": [new("0:0", "a"), new("0:1", "b")], "_bound": False}
    began = [{"name": None, "digest": "b"}, {"name": None, "digest": "a"}]
    second = {"_chunk": 1, "_entry": began, "_exit": [{"slot": 0, "own": None, "digest": "c"}], "_bound": False}
    assert tracking._walk([first, second], False) == [(False, None, None, []), (False, 0, None, ["0:1", "0:0"])]
    assert tracking._walk([first, second | {"_bound": True}], False)[1] == (True, 0, [0, 1], ["0:0", "0:1"])
    assert tracking._walk([first, second | {"_entry": began[:1]}], False)[1][0]
