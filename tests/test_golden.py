"""Hand-computed cases, each at the default chunk size and at chunk sizes small enough to cut every signal."""
import math

import pytest
from pyspark.sql import functions as F

from treadline.functions import geometry as geo
from treadline.functions import metrics as fm
from treadline.operators import contact, gait, ordered, series, steps, support

LIMB = ["trial_id", "limb"]
SIZES = [3, 7, ordered.CHUNK]


def ones(n, *spans):
    return "".join("1" if any(a <= i < b for a, b in spans) else "0" for i in range(n))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("size", SIZES)
def test_segments(contact_df, size):
    df = contact_df({("a", "LF"): ones(20, (5, 15)), ("b", "LF"): ones(50, (2, 8), (20, 30), (40, 45)), ("c", "LF"): "1"})
    got = rows(contact.stance_segments(df, LIMB, size=size), "trial_id", "start", "end")
    assert got == [("a", 5, 15), ("b", 2, 8), ("b", 20, 30), ("b", 40, 45)]


@pytest.mark.parametrize("size", SIZES)
def test_steps(contact_df, size):
    df = contact_df({("a", "LF"): ones(50, (10, 20), (30, 38))}, cx="double(frame)", intensity="100d", area_px="4d")
    b = steps.bouts(df, LIMB, 100.0, size=size).cache()
    s = steps.step_metrics(b, LIMB).orderBy("start").collect()
    one, two = s
    assert one.stand_s == pytest.approx(0.10) and one.stride_length_mm == 20 and one.swing_s == pytest.approx(0.10)
    assert one.step_cycle_s == pytest.approx(0.20) and one.swing_speed_mm_s == pytest.approx(200) and one.speed_mm_s == pytest.approx(100)
    assert one.area_under_curve == pytest.approx(10) and one.braking_s == 0 and one.propulsion_s == pytest.approx(0.09)
    assert two.stand_s == pytest.approx(0.08) and two.stride_length_mm == 0 and two.swing_s == 0 and two.area_under_curve == pytest.approx(8)


def test_limb_aggregates(contact_df):
    df = contact_df({("a", "LF"): "00111000111100"}, cx="0d", intensity="100d", area_px="1d")
    a = steps.limb_aggregates(steps.bouts(df, LIMB, 100.0, size=5), LIMB, 100.0).first()
    assert a.n_steps == 2 and a.avg_stance_s == pytest.approx(0.035) and a.avg_swing_s == pytest.approx(0.03)
    assert a.step_cycle_s == pytest.approx(0.05) and a.duty_cycle_pct == pytest.approx(70.0)


def test_short_channel_is_zero(contact_df):
    df = contact_df({("a", "LF"): "11"}, cx="0d", intensity="100d", area_px="1d")
    a = steps.limb_aggregates(steps.bouts(df, LIMB, 100.0), LIMB, 100.0).first()
    assert a.n_steps == 0 and a.total_contact_s == 0


@pytest.mark.parametrize("size", SIZES)
def test_basics(contact_df, size):
    s = ("1" * 30 + "0" * 20) * 5
    df = contact_df({("a", "LF"): s, ("a", "RF"): s[-10:] + s[:-10], ("a", "LH"): "0" * 9, ("a", "RH"): "0001000"})
    got = {r.limb: r for r in gait.gait_basics(df, LIMB, 100.0, size=size).collect()}
    a = got["LF"]
    assert a.n_strides == 4 and a.stance_ms == pytest.approx(375) and a.swing_ms == pytest.approx(200) and a.stride_hz == pytest.approx(2.0)
    for limb in ("LH", "RH"):
        assert (got[limb].n_strides, got[limb].stance_ms, got[limb].stride_hz) == (0, 0.0, 0.0)


@pytest.mark.parametrize("size", SIZES)
def test_stride_anchors(contact_df, size):
    s = ("1" * 30 + "0" * 20) * 5
    df = contact_df({("a", "LF"): s, ("b", "LF"): s[-10:] + s[:-10], ("c", "LF"): "0011100"}, x="double(frame)", y="0d")
    d = gait.stride_lengths(df, LIMB, 100.0, size=size)
    assert rows(d.where("trial_id = 'a'"), "start", "end") == [(0, 50), (50, 100), (100, 150), (150, 200)]
    assert rows(d.where("trial_id = 'b'"), "start", "end") == [(10, 40), (40, 90), (90, 140), (140, 190), (190, 240)]
    assert d.where("trial_id = 'c'").count() == 0


@pytest.mark.parametrize("size", SIZES)
def test_trend_contact(spark, size):
    xs = [0, 0, 0, 0, 1, 2, 3, 3, 3, 2, 1, 0, 0, 0]
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(xs)], "trial_id string, frame int, x double")
    d = contact.trend_contact(df, ["trial_id"], size=size)
    assert [r.frame for r in d.where("in_stance = 1").orderBy("frame").collect()] == [8, 9, 10]


@pytest.mark.parametrize("size", [2, 5, ordered.CHUNK])
@pytest.mark.parametrize("signal,want", [("11111011111", "11111111111"), ("111000111000", "111000111000"), ("10", "10")])
def test_auto_correct(contact_df, size, signal, want):
    d = contact.auto_correct(contact_df({("a", "LF"): signal}), LIMB, size=size)
    assert "".join(str(r.in_stance) for r in d.orderBy("frame").collect()) == want


def test_joint_stance(contact_df):
    df = contact_df({("a", n): "1" * 100 for n in ("LF", "RF", "LH", "RH")} | {("b", n): "000" for n in ("LF", "RF", "LH", "RH")})
    got = support.joint_stance(support.to_wide(df, ["trial_id"]), ["trial_id"]).collect()
    assert len(got) == 1 and got[0].total_active_frames == 100
    assert all(v == 100.0 for k, v in got[0].asDict().items() if k.endswith("_pct"))


@pytest.mark.parametrize("size", [1, 3, ordered.CHUNK])
def test_step_sequence(contact_df, size):
    df = contact_df({("a", "RF"): "1111", ("a", "LF"): "0111", ("a", "RH"): "0011", ("a", "LH"): "0001"})
    s = support.step_sequences(support.to_wide(df, ["trial_id"]), ["trial_id"], size=size)
    r = support.sequence_shares(s, ["trial_id"]).first()
    assert r.ca == 100.0 and r.regular == 100.0


@pytest.mark.parametrize("size", [4, ordered.CHUNK])
def test_traversals(spark, size):
    sig = "1" * 8 + "0" * 4 + "1" * 6 + "0" * 4
    df = spark.createDataFrame([("a", i, c == "1") for i, c in enumerate(sig)], "trial_id string, frame int, on boolean")
    got = contact.traversals(df, ["trial_id"], F.col("on"), min_frames=3, empty_frames=3, size=size)
    assert rows(got, "start", "end", "flushed") == [(1, 8, False), (13, 18, False)]
    # Still running at the end: closed at the last frame, trailing empty frames included.
    late = contact.traversals(df, ["trial_id"], F.col("on"), min_frames=3, empty_frames=5, size=size)
    assert rows(late, "start", "end", "flushed") == [(1, 22, True)]


def test_scalars(spark):
    c = lambda v: F.lit(float(v))
    r = spark.range(1).select(
        geo.point_line_distance(c(1), c(1), c(0), c(0), c(1), c(0)).alias("d"),
        fm.gait_symmetry(c(100), c(50), c(50), c(50)).alias("s"), geo.slope(c(1), c(0), c(1), c(5)).alias("vertical"),
        geo.angle_from_slope(geo.slope(c(1), c(0), c(1), c(5))).alias("up"), geo.angle_from_slope(c(-1)).alias("down"),
        fm.time_to_frame(c(0.5 / 60), 60).alias("half"), fm.time_to_frame(c(-3), 60).alias("early"),
        fm.ratio_asymmetry(c(0), c(0)).alias("none"), fm.ratio_asymmetry(c(2), c(0)).alias("one"), fm.ratio_asymmetry(c(2), c(4)).alias("two"),
        fm.parse_xy(F.lit("(133, 436)")).alias("xy"), fm.parse_xy(F.lit("n/a")).alias("no"), fm.pressure(c(5)).alias("p"),
        fm.colour_distance_score(c(1), c(2), c(3), (1.0, 2.0, 3.0)).alias("same")).first()
    assert r.d == 1.0 and r.s == pytest.approx((2 / 3 + 1) / 2) and r.vertical == math.inf and r.up == pytest.approx(90) and r.down == pytest.approx(135)
    assert (r.half, r.early, r.none, r.one, r.two) == (1, 1, 1.0, math.inf, 2.0)
    assert tuple(r.xy) == (133.0, 436.0) and tuple(r.no) == (0.0, 0.0) and r.p == 0.0 and r.same == 300.0


def test_sem(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0)], "t string, v double")
    got = dict((r.t, r.s) for r in df.groupBy("t").agg(gait.sem(F.col("v")).alias("s")).collect())
    assert got["a"] == pytest.approx(1 / math.sqrt(3)) and got["b"] == 0.0


@pytest.mark.parametrize("size", [2, ordered.CHUNK])
def test_gap_filling(spark, size):
    vals = {"a": [None, 2.0, None, None, 5.0, None], "b": [None, None, None]}
    df = spark.createDataFrame([(t, i, v) for t, vs in vals.items() for i, v in enumerate(vs)], "trial_id string, frame int, x double")
    d = contact.fill_gaps(df, ["trial_id"], ["x"], size=size).orderBy("trial_id", "frame")
    assert [r.x for r in d.collect()] == [2.0, 2.0, 3.0, 4.0, 5.0, 5.0, 0.0, 0.0, 0.0]


def test_jump_rejection_keeps_empty_channels_missing(spark):
    vals = {"a": [0.0, 1.0, 50.0, 3.0], "b": [None, None]}
    df = spark.createDataFrame([(t, i, v) for t, vs in vals.items() for i, v in enumerate(vs)], "trial_id string, frame int, x double")
    d = series.reject_jumps(df, ["trial_id"], ["x"], 10.0, size=3).orderBy("trial_id", "frame")
    assert [r.x for r in d.collect()] == [0.0, 1.0, 1.0, 1.0, None, None]


def test_sequence_number_survives_hot_trial(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("t"), "id")
    d = ordered.number_rows(df, ["t"], ["id"], F.floor(F.col("id") / 10))
    got = {}
    for r in d.orderBy("id").collect():
        assert r.frame == got.get(r.t, 0)
        got[r.t] = r.frame + 1
