"""Filters and moving statistics along a dense channel, and the body axis."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treadline.operators import contact, ordered
from treadline.operators.ordered import CHUNK


def median_filter(df: DataFrame, keys: Sequence[str], columns: Sequence[str], window: int = 5, frame: str = "frame",
                  size: int = CHUNK) -> DataFrame:
    """Moving median of an odd window, cut off at the ends of the channel."""
    h = window // 2
    cols = {f"_m_{c}": (lambda w, c=c: F.collect_list(c).over(w.rowsBetween(-h, h))) for c in columns}
    d = ordered.over_halo(df, keys, cols, frame, before=h, after=h, size=size)
    return d.withColumns({c: ordered.middle(F.col(f"_m_{c}")) for c in columns}).drop(*cols)


def reject_jumps(df: DataFrame, keys: Sequence[str], columns: Sequence[str], max_jump: float, frame: str = "frame",
                 size: int = CHUNK) -> DataFrame:
    """Frames farther than ``max_jump`` from the frame before become missing and are interpolated.

    A channel without any value stays missing.
    """
    shift = {f"_p_{c}": (lambda w, c=c: F.lag(c).over(w)) for c in columns}
    d = ordered.over_halo(df, keys, shift, frame, before=1, size=size)
    sq = sum(((F.col(c) - F.col(f"_p_{c}")) * (F.col(c) - F.col(f"_p_{c}")) for c in columns), F.lit(0.0))
    jump = F.coalesce(F.sqrt(sq) > float(max_jump), F.lit(False))
    d = d.withColumn("_jump", jump).drop(*shift)
    d = ordered.with_totals(d, keys, {"_any": ("sum", (F.col(columns[0]).isNotNull() & ~F.col("_jump")).cast("int"))},
                            frame, size)
    d = d.withColumns({c: F.when(~F.col("_jump"), F.col(c)) for c in columns}).drop("_jump")
    d = contact.fill_gaps(d, keys, columns, frame, size)
    return d.withColumns({c: F.when(F.col("_any") > 0, F.col(c)) for c in columns}).drop("_any")


def smooth(df: DataFrame, keys: Sequence[str], columns: Sequence[str], weight: float, passes: int = 1,
           frame: str = "frame", size: int = CHUNK) -> DataFrame:
    """``x += weight * (prev - 2x + next)``, end points fixed, repeated. A halo of ``passes`` frames carries all passes
    through one shuffle."""
    d = ordered.halo(df, frame, before=passes, after=passes, size=size)
    w = ordered.chunk_window(keys, frame)
    for _ in range(passes):
        d = d.withColumns({c: F.coalesce(
            F.col(c) + float(weight) * (F.lag(c).over(w) - 2 * F.col(c) + F.lead(c).over(w)), F.col(c)) for c in columns})
    return d.where(~F.col("_halo")).drop("_halo", "_chunk")


def rolling_background(df: DataFrame, keys: Sequence[str], value: str, window: int = 50, warmup: int = 30,
                       every: int = 5, frame: str = "frame", size: int = CHUNK) -> DataFrame:
    """Moving-median background of a pixel, refreshed on each of the first ``warmup`` frames and then on every
    ``every``-th; it holds in between and is missing until two frames were seen. ``frame`` counts from 0."""
    seen = F.col(frame) + 1
    due = ((seen <= warmup) | (seen % every == 0)) & (seen >= 2)

    d = ordered.halo(df, frame, before=window - 1 + every, size=size)
    w = ordered.chunk_window(keys, frame)
    d = d.withColumn("_bg", F.collect_list(value).over(w.rowsBetween(-(window - 1), 0)))
    d = d.withColumn("_bg", F.when(due, ordered.middle(F.col("_bg"))))
    d = d.withColumn("background", F.last("_bg", ignorenulls=True).over(w.rowsBetween(-(every - 1), 0)))
    return d.where(~F.col("_halo")).drop("_halo", "_chunk", "_bg")


def channel_background(df: DataFrame, keys: Sequence[str], channels: Sequence[str], window: int = 30, warmup: int = 5,
                       offset: int = 15, frame: str = "frame", size: int = CHUNK) -> DataFrame:
    """Whole-number moving median per colour channel; ``foreground`` where some channel deviates by more than
    ``offset``. Both are missing until ``warmup`` frames were seen."""
    bg = {f"bg_{c}": (lambda w, c=c: F.collect_list(c).over(w.rowsBetween(-(window - 1), 0))) for c in channels}
    d = ordered.over_halo(df, keys, bg, frame, before=window - 1, size=size)
    d = d.withColumns({c: F.when(F.col(frame) + 1 >= warmup, F.floor(ordered.middle(F.col(c))).cast("int")) for c in bg})
    dev = [F.abs(F.col(c) - F.col(f"bg_{c}")) for c in channels]
    top = F.greatest(*dev) if len(dev) > 1 else dev[0]
    ready = F.col(f"bg_{channels[0]}").isNotNull()
    return d.withColumn("foreground", F.when(ready, top > offset))


def frame_rate(df: DataFrame, keys: Sequence[str], seconds: Column, window: int = 30, frame: str = "frame",
               size: int = CHUNK) -> DataFrame:
    """Frames per second over the last ``window`` timestamps; missing for a single frame or a clock that stands."""
    d = df.withColumn("_s", seconds)
    d = ordered.over_halo(d, keys, {
        "_f": lambda w: F.first("_s").over(w.rowsBetween(-(window - 1), 0)),
        "_n": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-(window - 1), 0))}, frame, before=window - 1, size=size)
    dt = F.col("_s") - F.col("_f")
    return d.withColumn("fps", F.when((F.col("_n") >= 2) & (dt > 0), (F.col("_n") - 1) / dt)).drop("_s", "_f", "_n")


def _axis(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, syy: Column) -> dict[str, Column]:
    """Mean and principal direction of points from their moments; the direction points to +x (or +y)."""
    mx, my = sx / n, sy / n
    cxx, cxy, cyy = sxx - sx * mx, sxy - sx * my, syy - sy * my
    t = 0.5 * F.atan2(2.0 * cxy, cxx - cyy)
    return {"_mx": mx, "_my": my, "_ux": F.cos(t), "_uy": F.sin(t)}


def body_axis(points: DataFrame, keys: Sequence[str], frame_width: float, frame_height: float, x: str = "x",
              y: str = "y", order: str = "frame", pad: float = 0.1, size: int = CHUNK) -> DataFrame:
    """Principal axis of the centroids of each key, from end to end with padding; horizontal below two points."""
    one = F.lit(1.0)
    cx, cy = F.col(x), F.col(y)
    d = ordered.with_totals(points, keys, {
        "_n": ("sum", one), "_sx": ("sum", cx), "_sy": ("sum", cy), "_sxx": ("sum", cx * cx), "_sxy": ("sum", cx * cy),
        "_syy": ("sum", cy * cy)}, order, size)
    d = d.withColumns(_axis(*[F.col(c) for c in ("_n", "_sx", "_sy", "_sxx", "_sxy", "_syy")]))
    d = d.withColumn("_t", (cx - F.col("_mx")) * F.col("_ux") + (cy - F.col("_my")) * F.col("_uy"))
    g = d.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.max(c).alias(c) for c in ("_mx", "_my", "_ux", "_uy")],
                             F.min("_t").alias("_a"), F.max("_t").alias("_b"))
    span = F.col("_b") - F.col("_a")
    extra = F.when(span > 0, span * pad).otherwise(frame_width * pad)
    lo, hi = F.col("_a") - extra, F.col("_b") + extra
    few = F.col("_n") < 2
    end = lambda t, m, u: F.col(m) + t * F.col(u)
    half = frame_height / 2.0
    return g.select(
        *keys, F.when(few, frame_width * pad).otherwise(end(lo, "_mx", "_ux")).alias("p1x"),
        F.when(few, half).otherwise(end(lo, "_my", "_uy")).alias("p1y"),
        F.when(few, frame_width * (1 - pad)).otherwise(end(hi, "_mx", "_ux")).alias("p2x"),
        F.when(few, half).otherwise(end(hi, "_my", "_uy")).alias("p2y"))


def moving_axis(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", frame: str = "frame",
                window: int = 30, least: int = 6, size: int = CHUNK) -> DataFrame:
    """Body-axis angle from the last ``window`` centroids; missing until ``least`` were seen."""
    cx, cy = F.col(x), F.col(y)
    terms = {"_n": F.lit(1.0), "_sx": cx, "_sy": cy, "_sxx": cx * cx, "_sxy": cx * cy, "_syy": cy * cy}
    cols = {n: (lambda w, c=c: F.sum(c).over(w.rowsBetween(-(window - 1), 0))) for n, c in terms.items()}
    d = ordered.over_halo(points, keys, cols, frame, before=window - 1, size=size)
    a = _axis(*[F.col(c) for c in terms])
    return d.withColumn("axis_deg", F.when(F.col("_n") >= least, F.degrees(F.atan2(a["_uy"], a["_ux"])))).drop(*terms)


def centred_windows(df: DataFrame, keys: Sequence[str], value: str, length: int = 8, frame: str = "frame",
                    size: int = CHUNK) -> DataFrame:
    """A window of ``length`` values around each frame, moved inwards at the ends of the channel; channels shorter than
    the window repeat their last value."""
    r = length - 1
    d = ordered.with_totals(df, keys, {"_last": ("max", F.col(frame))}, frame, size)
    d = ordered.over_halo(d, keys, {"_near": lambda w: F.collect_list(value).over(w.rowsBetween(-r, r))}, frame,
                          before=r, after=r, size=size)
    lowest = F.greatest(F.col(frame) - r, F.lit(0))
    start = F.greatest(F.lit(0), F.least(F.col(frame) - length // 2, F.col("_last") + 1 - length))
    win = F.slice("_near", start - lowest + 1, F.lit(length))
    pad = F.array_repeat(F.element_at(win, -1), F.lit(length) - F.size(win))
    return d.select(*keys, frame, F.concat(win, pad).alias("window"))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 15) -> DataFrame:
    """Equal-width histogram of the non-zero values of each key; the top edge belongs to the last bin."""
    d = df.where(F.col(value) != 0)
    edges = d.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    # Values are counted once per distinct value first, so the join below carries no repeated rows.
    counts = d.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).join(edges, list(keys))
    width = (F.col("_hi") - F.col("_lo")) / bins
    pos = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(0))
    b = F.least(pos, F.lit(bins - 1)).cast("int") + 1
    return counts.groupBy(*keys, b.alias("bin")).agg(F.sum("_n").alias("n"))
