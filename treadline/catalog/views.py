"""Deterministic gait-shaped views of the driver tables, in Spark and as SQL text.

Values are scaled to whole hundredths kept as DOUBLE, so that sums are exact and do not depend on their order.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treadline.operators import ordered

TRIAL = ["trial_id"]
LIMB = ["trial_id", "limb"]
# Frames per chunk. Tests and the check tool lower it so that the short recordings of the test tables cross chunk edges.
SIZE = ordered.CHUNK


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """events as recordings: one trial per user, frames numbered by time, ``x`` in hundredths, ``k`` in 0..99."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trial_id"), "ts", "event_id",
        F.round(F.col("value") * 100).alias("x"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"), "event_type")
    e = ordered.number_rows(e, TRIAL, ["ts", "event_id"], F.date_trunc("minute", F.col("ts")))
    return e.select("trial_id", "frame", "x", "k", *extra)


SAMPLES = """
samples AS (
  SELECT user_id AS trial_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame,
         round(value * 100) AS x, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, event_type, ts, event_id
  FROM events)"""


def contact_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four contact flags per frame from the low bits of ``k``; intensity is ``x``, ``cx`` its running sum."""
    s = samples(spark, sf_dir)
    s = ordered.running_sum(s, TRIAL, {"cx": F.col("x")}, size=SIZE)
    bit = lambda i: F.shiftright("k", i).bitwiseAND(1).alias
    return s.select("trial_id", "frame", "x", "k", "cx", bit(0)("lf"), bit(1)("rf"), bit(2)("lh"), bit(3)("rh"))


WIDE = SAMPLES + """,
wide AS (
  SELECT trial_id, frame, x, k, sum(x) OVER (PARTITION BY trial_id ORDER BY frame) AS cx,
         k & 1 AS lf, (k >> 1) & 1 AS rf, (k >> 2) & 1 AS lh, (k >> 3) & 1 AS rh
  FROM samples)"""


def contact_long(spark: SparkSession, sf_dir: str, wide: DataFrame | None = None) -> DataFrame:
    """One row per (trial, limb, frame): in_stance, intensity, area, centroid shifted per limb. ``wide`` is a stored :func:`contact_wide`."""
    w = contact_wide(spark, sf_dir) if wide is None else wide
    limbs = F.explode(F.array(*[
        F.struct(F.lit(n).alias("limb"), F.col(c).cast("int").alias("in_stance"), F.lit(i).alias("ord"))
        for i, (n, c) in enumerate((("LF", "lf"), ("RF", "rf"), ("LH", "lh"), ("RH", "rh")))]))
    return (w.withColumn("l", limbs)
            .select("trial_id", "l.limb", "frame", "l.in_stance", F.col("x").alias("intensity"),
                    (F.col("k") + F.col("l.ord")).cast("double").alias("area_px"),
                    (F.col("cx") + F.col("l.ord") * 50.0).alias("cx"),
                    (F.col("k") * 3.0 + F.col("l.ord") * 7.0).alias("cy")))


LONG = WIDE + """,
contact AS (
  SELECT trial_id, limb, frame, CAST(in_stance AS INTEGER) AS in_stance, x AS intensity,
         CAST(k + ord AS DOUBLE) AS area_px, cx + ord * 50.0::DOUBLE AS cx, k * 3.0::DOUBLE + ord * 7.0::DOUBLE AS cy
  FROM (SELECT *, 'LF' AS limb, lf AS in_stance, 0 AS ord FROM wide
        UNION ALL SELECT *, 'RF', rf, 1 FROM wide
        UNION ALL SELECT *, 'LH', lh, 2 FROM wide
        UNION ALL SELECT *, 'RH', rh, 3 FROM wide))"""

# Gaps and islands over contact rows, shared by the SQL of the step operators.
BOUTS = LONG + """,
flagged AS (
  SELECT *, CASE WHEN in_stance = lag(in_stance) OVER w THEN 0 ELSE 1 END AS brk FROM contact
  WINDOW w AS (PARTITION BY trial_id, limb ORDER BY frame)),
marked AS (
  SELECT *, sum(brk) OVER (PARTITION BY trial_id, limb ORDER BY frame) AS run FROM flagged),
runs AS (
  SELECT trial_id, limb, min(frame) AS s, max(frame) + 1 AS e, min(in_stance) AS v, count(*) AS n
  FROM marked GROUP BY trial_id, limb, run),
total AS (SELECT trial_id, limb, count(*) AS n_frames FROM contact GROUP BY trial_id, limb)"""


TRACKS = """
raw AS (
  SELECT l_partkey AS track_id, l_suppkey, l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS area_px,
         round(l_extendedprice / 1000) AS mean_intensity, CAST(round(l_discount * 100) AS INTEGER) AS dx,
         CAST(round(l_tax * 100) AS INTEGER) AS dy, l_partkey % 10 AS trial_id
  FROM lineitem),
tracks AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY track_id ORDER BY l_orderkey, l_linenumber, l_suppkey, area_px,
             mean_intensity, dx, dy) * 2 AS INTEGER) AS frame
  FROM raw)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as tracked detections: one track per part, frames in order of (order, line); ten trials."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("track_id"), "l_suppkey", "l_orderkey", "l_linenumber",
        F.col("l_quantity").cast("int").alias("area_px"),
        F.round(F.col("l_extendedprice") / 1000).alias("mean_intensity"),
        F.round(F.col("l_discount") * 100).cast("int").alias("dx"),
        F.round(F.col("l_tax") * 100).cast("int").alias("dy"), (F.col("l_partkey") % 10).alias("trial_id"))
    li = ordered.number_rows(li, ["track_id"],
                             ["l_orderkey", "l_linenumber", "l_suppkey", "area_px", "mean_intensity", "dx", "dy"],
                             F.floor(F.col("l_orderkey") / 65536), start=1)
    return li.withColumn("frame", F.col("frame") * 2)
