"""Image-shaped work on pixel tables: ``trial_id, frame, x, y`` plus channels. One row per pixel; nothing is decoded."""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treadline.functions import geometry as geo
from treadline.functions import metrics as fm
from treadline.operators import ordered


def median_background(pixels: DataFrame, keys: Sequence[str], channels: Sequence[str], first_frames: int | None = None,
                      frame: str = "frame") -> DataFrame:
    """Median of every pixel over all frames, or over the first ones (frames counted from 1). A pixel without any value has no row.

    Values are counted before they are ranked, so a pixel of a long recording costs as many rows as it has different values.
    """
    d = pixels if first_frames is None else pixels.where(F.col(frame) <= first_frames)
    each = [F.struct(F.lit(c).alias("_channel"), F.col(c).cast("double").alias("_value")) for c in channels]
    d = d.select(*keys, F.inline(F.array(*each)))
    m = ordered.median(d, [*keys, "_channel"], "_value", F.floor("_value"), "_median")
    return m.groupBy(*keys).agg(*[F.max(F.when(F.col("_channel") == c, F.col("_median"))).alias(f"bg_{c}") for c in channels])


def against_background(pixels: DataFrame, background: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pixels.join(background, list(keys))


def contact_pixels(threshold: float = 12.0) -> Column:
    """Green rises above the background."""
    return F.col("g") - F.col("bg_g") > threshold


def body_pixels(threshold: float = 40.0) -> Column:
    """The body blocks red light."""
    return F.col("bg_r") - F.col("r") > threshold


def dark_pixels(threshold: float = 5.0) -> Column:
    return F.col("bg_g") - F.col("g") >= threshold


def strict_contact_pixels(body: float = 40.0, paw: float = 12.0) -> Column:
    return body_pixels(body) & (F.col("g") > paw)


def batched_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn, schema: str) -> DataFrame:
    """Apply ``fn`` to pandas batches that hold whole groups only.

    Groups are spread by ``keys`` and sorted; the group a batch ends in is held back and joined to the next batch, so a
    task holds one Arrow batch and one group (a frame: bounded by the image size), not all groups of a key.
    """
    cols = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if pdf.empty:
                continue
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            tail = np.ones(len(pdf), dtype=bool)
            for c in cols:
                tail &= (pdf[c] == pdf[c].iloc[-1]).to_numpy()
            held, whole = pdf[tail], pdf[~tail]
            if len(whole):
                yield fn(whole.reset_index(drop=True))
        if held is not None:
            yield fn(held.reset_index(drop=True))

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols).sortWithinPartitions(*cols, *order).mapInPandas(run, schema)


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, from edges ``a-b``: hook to the smaller root, then shortcut."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            nxt = root[root]
            if (nxt == root).all():
                break
            root = nxt
    return root


def _label(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """8-connected labels of all frames of a batch: runs along x, joined to the overlapping runs one row below."""
    g = pdf.groupby(keys, sort=False).ngroup().to_numpy().astype(np.int64)
    x, y = pdf["x"].to_numpy().astype(np.int64), pdf["y"].to_numpy().astype(np.int64)
    o = np.lexsort((x, y, g))
    g, x, y = g[o], x[o], y[o]
    new = np.r_[True, (g[1:] != g[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)]
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(x)] - 1
    rg, ry, x0, x1 = g[first], y[first], x[first], x[last]
    span = int(x.max() - x.min()) + 4
    rows = (rg * (int(y.max() - y.min()) + 3) + (ry - y.min()))
    key0, key1 = rows * span + (x0 - x.min() + 1), rows * span + (x1 - x.min() + 1)
    lo = np.searchsorted(key1, key0 + span - 1, side="left")
    hi = np.searchsorted(key0, key1 + span + 1, side="right")
    cnt = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(first)), cnt)
    b = np.repeat(lo, cnt) + np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)
    root = _components(len(first), a, b)
    lab = root[run]
    base = pd.Series(lab).groupby(g).transform(lambda s: pd.factorize(s, sort=True)[0]).to_numpy() + 1
    out = pdf.iloc[o].reset_index(drop=True)
    out["label"] = base.astype("int32")
    return out


def label_blobs(pixels: DataFrame, keys: Sequence[str] = ("trial_id", "frame")) -> DataFrame:
    """8-connected components of the (already thresholded) pixels of each frame; labels count from 1 in scan order."""
    d = pixels.dropDuplicates([*keys, "x", "y"])
    names = list(keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema) + ", label int"
    return batched_groups(d, keys, ("y", "x"), lambda pdf: _label(pdf, names), schema)


def blob_statistics(labelled: DataFrame, keys: Sequence[str] = ("trial_id", "frame"), min_area: int = 1,
                    measures: Mapping[str, Column] | None = None) -> DataFrame:
    """Area, box (``x2``, ``y2`` exclusive), centroid and measures per blob, for blobs of at least ``min_area`` pixels."""
    g = labelled.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).cast("int").alias("area_px"), F.min("x").alias("x1"), F.min("y").alias("y1"),
        (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        *[c.alias(n) for n, c in (measures or {}).items()])
    return g.where(F.col("area_px") >= min_area)


def detection_statistics(mask_pixels: DataFrame, keys: Sequence[str], delta: str, width: int, height: int,
                         min_area: int = 5) -> DataFrame:
    """Detections from their mask pixels: area, box (inclusive), centroid, mean and peak rise, pressure, border flag."""
    d = F.col(delta)
    g = mask_pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("area_px"), F.min("x").alias("x1"), F.min("y").alias("y1"),
        F.max("x").alias("x2"), F.max("y").alias("y2"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        F.avg(d).alias("mean_intensity"), F.max(d).alias("peak_intensity"),
        F.avg(fm.pressure(d)).alias("mean_pressure"), F.max(fm.pressure(d)).alias("peak_pressure"))
    edge = geo.touches_edge(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), width, height)
    return g.where(F.col("area_px") >= min_area).withColumn("touches_edge", edge)


def masked_intensity(crop_pixels: DataFrame, keys: Sequence[str], delta: str, in_mask: str = "in_mask") -> DataFrame:
    """Mean rise over the mask, but peak rise over the whole crop; both 0 for an empty mask."""
    up = F.greatest(F.col(delta), F.lit(0.0))
    hit = F.count_if(in_mask)
    return crop_pixels.groupBy(*keys).agg(
        hit.alias("area_px"), F.coalesce(F.avg(F.when(F.col(in_mask), up)), F.lit(0.0)).alias("mean_intensity"),
        F.when(hit > 0, F.max(up)).otherwise(0.0).alias("peak_intensity"))


def largest_blob(blobs: DataFrame, keys: Sequence[str] = ("trial_id", "frame"), min_area: int = 0) -> DataFrame:
    """The largest blob of each frame, the first label on ties."""
    cols = [c for c in blobs.columns if c not in keys]
    g = blobs.where(F.col("area_px") >= min_area).groupBy(*keys).agg(
        F.max_by(F.struct(*cols), F.struct(F.col("area_px"), -F.col("label"))).alias("b"))
    return g.select(*keys, "b.*")


def gate_by_body(det: DataFrame, roi: DataFrame, keys: Sequence[str] = ("trial_id", "frame")) -> DataFrame:
    """Keep detections whose box overlaps the body box of their frame; frames without a body keep all."""
    r = roi.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("ex1", "ey1", "ex2", "ey2")])
    d = det.join(r, list(keys), "left")
    apart = ((F.col("x2") <= F.col("_ex1")) | (F.col("x1") >= F.col("_ex2"))
             | (F.col("y2") <= F.col("_ey1")) | (F.col("y1") >= F.col("_ey2")))
    return d.where(F.col("_ex1").isNull() | ~apart).drop("_ex1", "_ey1", "_ex2", "_ey2")


def near_pixels(pixels: DataFrame, body: DataFrame, radius: int, keys: Sequence[str] = ("trial_id", "frame")) -> DataFrame:
    """Pixels within ``radius`` of a body pixel of the same frame.

    Body pixels are reduced to one row per (frame, row y, run of x) and spread over the rows a pixel can reach; a pixel
    then looks at the nearest run on either side by a window over its own row, so no pixel pairs are formed.
    """
    k = [*keys, "_row"]
    # Every body pixel offers itself to the rows within the radius with the x reach left on that row.
    dy = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    b = body.select(*keys, "x", "y").distinct().withColumn("_dy", dy)
    reach = F.floor(F.sqrt(F.lit(radius * radius) - F.col("_dy") * F.col("_dy"))).cast("int")
    spans = b.select(*keys, (F.col("y") + F.col("_dy")).alias("_row"), (F.col("x") - reach).alias("_lo"),
                     (F.col("x") + reach).alias("_hi"))
    spans = spans.groupBy(*k, "_lo").agg(F.max("_hi").alias("_hi"))
    ev = spans.select(*k, F.col("_lo").alias("_x"), "_hi", F.lit(None).cast("struct<a:int>").alias("_p"))
    payload = F.struct(*[c for c in pixels.columns if c not in keys])
    px = pixels.select(*keys, F.col("y").alias("_row"), F.col("x").alias("_x"), F.lit(None).cast("int").alias("_hi"),
                       payload.alias("_p"))
    ev = ev.withColumn("_p", F.lit(None).cast(px.schema["_p"].dataType))
    w = Window.partitionBy(*k).orderBy("_x", F.col("_p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    d = px.unionByName(ev).withColumn("_far", F.max("_hi").over(w))
    return d.where(F.col("_p").isNotNull() & (F.col("_far") >= F.col("_x"))).select(*keys, "_p.*")


def union_projection(mask_pixels: DataFrame, trial: Sequence[str], track: str, delta: str) -> DataFrame:
    """Highest rise per pixel over all tracks, with the number of tracks that ever covered the pixel.

    Two levels: per (track, pixel), then per pixel; both combine map-side.
    """
    up = F.greatest(F.col(delta), F.lit(0.0))
    per = mask_pixels.groupBy(*trial, track, "x", "y").agg(F.max(up).alias("v"))
    return per.groupBy(*trial, "x", "y").agg(F.max("v").alias("max_intensity"), F.count(F.lit(1)).alias("n_tracks"))


def track_pixels(mask_pixels: DataFrame, trial: Sequence[str], track: str) -> DataFrame:
    """Union of the mask pixels of each track."""
    return mask_pixels.select(*trial, track, "x", "y").distinct()


def scale_to_bytes(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Scale to 0..255 by the maximum of each key. The maxima are one row per key and are joined back."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    d = df.join(top, list(keys))
    return d.withColumn("scaled", F.when(F.col("_top") > 0, F.floor(F.col(value) / F.col("_top") * 255)).otherwise(0)
                        .cast("int")).drop("_top")


def min_max_scale(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(v - min) / (max - min) over the positive pixels of each key; equal ends count as range 1."""
    d = df.where(F.col(value) > 0)
    ends = d.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    d = d.join(ends, list(keys))
    span = F.col("_hi") - F.col("_lo")
    return d.withColumn("scaled", (F.col(value) - F.col("_lo")) / F.when(span == 0, 1.0).otherwise(span)).drop("_lo", "_hi")


def peak_composite(scores: DataFrame, peaks: DataFrame, trial: Sequence[str], track: str, score: str) -> DataFrame:
    """Mean score per pixel over the peak frames of the tracks. ``peaks`` has ``trial, track, peak_area_frame``."""
    p = peaks.select(*trial, track, F.col("peak_area_frame").alias("frame"))
    return (scores.join(p, [*trial, track, "frame"]).groupBy(*trial, "x", "y")
            .agg(F.avg(score).alias("mean_score"), F.countDistinct(track).alias("n_tracks")))


def max_projection(pixels: DataFrame, keys: Sequence[str], value: str, floor: float | None = None) -> DataFrame:
    """Running maximum per pixel; values under ``floor`` count as 0."""
    v = F.col(value) if floor is None else F.when(F.col(value) >= floor, F.col(value)).otherwise(0)
    return pixels.groupBy(*keys, "x", "y").agg(F.max(v).alias("max_value"))


def pixels_in_boxes(pixels: DataFrame, boxes: DataFrame, keys: Sequence[str], tile: int = 64) -> DataFrame:
    """Join pixels to the boxes of their frame that contain them (``x2``, ``y2`` exclusive).

    The range condition becomes an equi-join on image tiles, which also spreads a large frame over tasks. A pixel lies in
    exactly one tile, so no pair appears twice.
    """
    t = float(tile)
    span = lambda a, b: F.sequence(F.floor(F.col(a) / t), F.floor((F.col(b) - 1) / t))
    b = (boxes.where("x2 > x1 and y2 > y1").withColumn("_tx", F.explode(span("x1", "x2")))
         .withColumn("_ty", F.explode(span("y1", "y2"))))
    p = pixels.withColumns({"_tx": F.floor(F.col("x") / t), "_ty": F.floor(F.col("y") / t)})
    d = p.join(b, [*keys, "_tx", "_ty"])
    return d.where("x >= x1 and x < x2 and y >= y1 and y < y2").drop("_tx", "_ty")


def box_intensity(pixels: DataFrame, boxes: DataFrame, keys: Sequence[str], box: str, value: str,
                  floor: float = 0.0) -> DataFrame:
    """Mean, maximum and sum of a channel inside each box, values under ``floor`` set to 0."""
    v = F.when(F.col(value) < floor, F.lit(0.0)).otherwise(F.col(value).cast("double"))
    return pixels_in_boxes(pixels, boxes, keys).groupBy(*keys, box).agg(
        F.avg(v).alias("intensity_mean"), F.max(v).alias("intensity_max"), F.sum(v).alias("intensity_total"),
        F.count(F.lit(1)).alias("n_pixels"))


def pressure_rows(df: DataFrame, trial: Sequence[str], measures: Mapping[str, str],
                  limbs: Sequence[str] = ("LF", "RF", "LH", "RH"), frame: str = "frame") -> DataFrame:
    """Wide per-frame rows: one column per limb and measure, 0 where a limb has no row."""
    return df.groupBy(*trial, frame).agg(*[
        F.coalesce(F.max(F.when(F.col("limb") == n, F.col(c))), F.lit(0.0)).cast("double").alias(f"{n}_{out}")
        for n in limbs for c, out in measures.items()])


def percentile_threshold(df: DataFrame, keys: Sequence[str], score: str, share: float = 0.95) -> DataFrame:
    """Keep the pixels above the exact percentile of the scores of their frame, or of whatever else ``keys`` name."""
    cut = ordered.quantile(df, keys, score, F.floor(score), "threshold", share)
    return df.join(cut, list(keys)).where(F.col(score) > F.col("threshold"))


def mask_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """IoU of two pixel masks and mean absolute difference over their union.

    Both masks go into one aggregation per pixel, so neither side is joined and hot keys combine map-side.
    """
    one = a.select(*keys, "x", "y", F.col(value).alias("_a"), F.lit(None).cast("double").alias("_b"))
    two = b.select(*keys, "x", "y", F.lit(None).cast("double").alias("_a"), F.col(value).alias("_b"))
    px = one.unionByName(two).groupBy(*keys, "x", "y").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    both = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    diff = F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    return px.groupBy(*keys).agg((both / F.count(F.lit(1))).alias("iou"), F.avg(diff).alias("mae"))
