"""Keyed stream state, appended contact and trials with faults, next to batch operators and plain Python."""
import collections
import statistics

import numpy as np
from pyspark.sql import functions as F

from treadline.operators import series
from treadline.plans import trials
from treadline.streaming import live


def replay(spark, tmp_path, df, frames):
    """Micro-batches in which frames come late, early and again; a key's rows never come in order."""
    src = str(tmp_path / "src")
    for i, cut in enumerate((F.col("frame") % 3 == 1, F.col("frame") >= frames // 2, F.lit(True))):
        df.where(cut).orderBy(F.desc("frame")).coalesce(1).write.parquet(f"{src}/{i}")
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)


def drained(spark, tmp_path, df, name):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}_log")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / name))


def test_background_and_rate_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(x, f, None if rng.random() < 0.1 or (x == 1 and f < 12) else int(rng.integers(0, 8)), float(f * 0.01 * (x + 1))) for x in range(2) for f in range(70)]
    df = spark.createDataFrame(rows, "x int, frame int, g int, seconds double")
    frames = replay(spark, tmp_path, df, 70)
    want = series.rolling_background(df, ["x"], "g", window=9, warmup=6, every=4).select("x", "frame", "background")
    got = drained(spark, tmp_path, live.stream_background(frames, ["x"], "g", window=9, warmup=6, every=4), "bg")
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, want.collect()))
    want = series.frame_rate(df, ["x"], F.col("seconds"), window=5).select("x", "frame", "fps")
    got = drained(spark, tmp_path, live.stream_frame_rate(frames, ["x"], "seconds", window=5), "fps")
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, want.collect()))


def test_sliding_ranks():
    rng, ranks, seen = np.random.default_rng(1), live.SlidingRanks(7), []
    for _ in range(200):
        x = None if rng.random() < 0.2 else int(rng.integers(0, 5))
        seen.append(x)
        ranks.push(x)
        known = [v for v in seen[-7:] if v is not None]
        assert ranks.median() == (statistics.median(known) if known else None)
        again = live.SlidingRanks(7)
        again.load(ranks.save())
        assert again.median() == ranks.median()


def test_contact_is_appended_once(spark, tmp_path):
    df = spark.createDataFrame([("t", limb, f, f % 7 < 3) for limb in ("LF", "RF") for f in range(40)], "trial_id string, limb string, frame int, in_stance boolean")
    path = str(tmp_path / "contact")
    q = live.append_contact(replay(spark, tmp_path, df, 40), path, str(tmp_path / "log"), {"availableNow": True})
    q.awaitTermination()
    got = spark.read.parquet(path)
    assert got.select("batch").distinct().count() > 1
    assert collections.Counter(map(tuple, got.select(*df.columns).collect())) == collections.Counter(map(tuple, df.collect()))


def test_a_broken_trial_does_not_stop_the_rest(spark):
    rows = [(t, f, None if t == "bad" and f in (3, 4) else float(f)) for t in ("a", "bad", "c") for f in range(5)]
    df = spark.createDataFrame(rows, "trial_id string, frame int, x double")
    # The plan fails on a missing place, as it would on the whole table.
    plan = lambda d: d.groupBy("trial_id").agg(F.sum(F.coalesce("x", F.raise_error(F.lit("no place")).cast("double"))).alias("s"))
    done, status = trials.each_trial(df, ["trial_id"], {"a place": F.col("x").isNotNull(), "frames count from 0": F.col("frame") >= 0}, plan)
    assert {r.trial_id: r.s for r in done.collect()} == {"a": 10.0, "c": 10.0}
    assert {r.trial_id: (r.status, r.message, r.n_rows) for r in status.collect()} == {"a": ("ok", None, 5), "bad": ("error", "a place: 2", 5), "c": ("ok", None, 5)}
    done, status = trials.each_trial(df.where("false"), ["trial_id"], {"a place": F.col("x").isNotNull()}, plan)
    assert done.count() == 0 and status.count() == 0
