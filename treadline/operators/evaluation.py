"""Summaries and leaderboards over detector runs and over trials."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treadline.functions import metrics as fm
from treadline.operators import ordered


def detector_summary(blobs: DataFrame, frames: DataFrame, trial: Sequence[str], crowded: int = 6, frame: str = "frame") -> DataFrame:
    """Blobs per frame (empty frames count) and blob areas per trial. ``frames`` lists every frame."""
    keys = [*trial, frame]
    c = frames.select(*keys).join(blobs.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")), keys, "left").na.fill(0, ["c"])
    n = F.col("c")
    a = c.groupBy(*trial).agg(F.sum(n).alias("n_blobs"), F.avg(n).alias("mean_per_frame"), F.max(n).alias("max_per_frame"),
                              F.count_if(n > crowded).alias("crowded_frames"), F.count_if(n == 0).alias("empty_frames"))
    b = blobs.groupBy(*trial).agg(F.avg("area_px").alias("mean_area"))
    mid = ordered.median(blobs, trial, "area_px", F.floor("area_px"), "median_area")
    return a.join(b, list(trial), "left").join(mid, list(trial), "left")


def leaderboard(scores: DataFrame, config: Sequence[str], score: str, top: int = 10) -> DataFrame:
    """Mean, extremes and deviation of a score per configuration; the best ``top`` by mean, then configuration."""
    g = scores.groupBy(*config).agg(F.avg(score).alias("mean_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"),
                                    F.coalesce(F.stddev_pop(score), F.lit(0.0)).alias("sd_score"), F.count(F.lit(1)).alias("n_trials"))
    return g.orderBy(F.desc("mean_score"), *config).limit(top)


def score_grid(scores: DataFrame, row: str, column: str, values: Sequence, score: str) -> DataFrame:
    """Mean score on a grid of two parameters; ``values`` are the columns."""
    return scores.groupBy(row).pivot(column, list(values)).agg(F.avg(score))


def mask_scores(prints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Medians of IoU and absolute error per configuration; a print without a blob counts as IoU 0, error 0.5."""
    d = prints.select(*keys, F.coalesce("iou", F.lit(0.0)).alias("iou"), F.coalesce("mae", F.lit(0.5)).alias("mae"))
    slots = {c: F.floor(F.col(c) * 1024) for c in ("iou", "mae")}
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_prints"))
    for c, slot in slots.items():
        g = g.join(ordered.median(d, keys, c, slot, f"median_{c}"), list(keys))
    return g.withColumn("score", F.col("median_iou") - 0.5 * F.col("median_mae"))


def heuristic_score(counts: DataFrame) -> DataFrame:
    return counts.withColumn("score", fm.detector_score(*[F.col(c) for c in ("n_valid", "n_assigned", "n_short", "n_unassigned")]))


def pair_asymmetry(values: DataFrame, pairs: Sequence[tuple[str, str, str]], keys: Sequence[str], limb: str = "limb",
                   value: str = "value") -> DataFrame:
    """Ratio asymmetry of named limb pairs of which both sides are present."""
    pick = lambda n: F.max(F.when(F.col(limb) == n, F.col(value)))
    limbs = sorted({x for _, a, b in pairs for x in (a, b)})
    g = values.groupBy(*keys).agg(*[pick(n).alias(f"_{n}") for n in limbs])
    rows: list[Column] = [F.when(F.col(f"_{a}").isNotNull() & F.col(f"_{b}").isNotNull(),
                          F.struct(F.lit(n).alias("pair"), fm.ratio_asymmetry(F.col(f"_{a}"), F.col(f"_{b}")).alias("asymmetry")))
                          for n, a, b in pairs]
    return g.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("r")).select(*keys, "r.*")


def cohort_summary(metrics: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Group statistics over trials: mean, standard error and count per group and metric."""
    n = F.count(value)
    return metrics.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value) / F.sqrt(n), F.lit(0.0)).alias("sem"),
                                      n.alias("n"))
