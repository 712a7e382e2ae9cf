"""Matching detections to limbs, to ground truth and to each other."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treadline.functions.geometry import distance
from treadline.operators import ordered
from treadline.operators.pixels import _components, batched_groups, pixels_in_boxes
from treadline.session import materialise


def assign_limbs(det: DataFrame, limbs: DataFrame, keys: Sequence[str] = ("trial_id", "frame")) -> DataFrame:
    """One-to-one greedy assignment of detections to limb positions by distance cut to whole pixels, nearest pair first,
    then detection, then limb order.

    ``det`` has ``det_id, cx, cy``; ``limbs`` has ``limb, limb_ord, x, y``. In a frame with n limbs the others can
    take at most n - 1 detections, so a limb's match is always among its n nearest: keeping only those is exact and
    bounds the list that is resolved per frame.
    """
    p = det.join(limbs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))), list(keys))
    p = p.withColumn("_d", F.floor(distance(F.col("cx"), F.col("cy"), F.col("x"), F.col("y"))).cast("int"))
    near = F.row_number().over(Window.partitionBy(*keys, "limb").orderBy("_d", "det_id"))
    p = p.withColumn("_r", near).where(F.col("_r") <= F.col("_n"))
    pairs = F.array_sort(F.collect_list(F.struct("_d", "det_id", "limb_ord", "limb")))
    g = p.groupBy(*keys).agg(pairs.alias("_pairs"))
    empty = F.slice(F.col("_pairs"), 1, 0)

    def take(acc: Column, pair: Column) -> Column:
        free = ~F.exists(acc, lambda m: (m["det_id"] == pair["det_id"]) | (m["limb_ord"] == pair["limb_ord"]))
        return F.when(free, F.concat(acc, F.array(pair))).otherwise(acc)

    m = g.withColumn("_m", F.explode(F.aggregate("_pairs", empty, take)))
    return m.select(*keys, "_m.det_id", "_m.limb", F.col("_m._d").alias("distance_px"))


def _cells(x: Column, y: Column, r: float) -> tuple[Column, Column]:
    return F.floor(x / r), F.floor(y / r)


def recalled(truth: DataFrame, det: DataFrame, radius: float, keys: Sequence[str] = ("trial_id", "frame")) -> DataFrame:
    """Truth rows (``x, y``) with a flag ``hit``: some detection of the frame lies within ``radius``.

    Rows at one place share their answer. Each place of the truth is offered to the nine cells around it, where one equi-join with the distinct
    detections leaves the places that are hit; no pairs are kept.
    """
    r = float(radius)
    place = [*keys, "x", "y"]
    tx, ty = _cells(F.col("x"), F.col("y"), r)
    near = F.explode(F.array(*[F.struct((tx + i).alias("a"), (ty + j).alias("b")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    t = truth.select(*place).distinct().withColumn("_n", near).select(*place, F.col("_n.a").alias("_tx"), F.col("_n.b").alias("_ty"))
    ux, uy = _cells(F.col("cx"), F.col("cy"), r)
    d = det.select(*keys, "cx", "cy").distinct()
    d = d.select(*[F.col(k).alias(f"_{k}") for k in keys], "cx", "cy", ux.alias("_a"), uy.alias("_b"))
    cond = (F.col("_tx") == F.col("_a")) & (F.col("_ty") == F.col("_b"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    cond = cond & (distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")) <= r)
    hits = t.join(d, cond, "left_semi").select(*place).distinct().withColumn("hit", F.lit(True))
    return truth.join(hits, place, "left").select(*truth.columns, F.coalesce("hit", F.lit(False)).alias("hit"))


def recall(flags: DataFrame, trials: DataFrame, trial: Sequence[str]) -> DataFrame:
    """Share of hits per trial; 1 for a trial without truth."""
    g = flags.groupBy(*trial).agg((F.count_if("hit") / F.count(F.lit(1))).alias("recall"))
    return trials.select(*trial).distinct().join(g, list(trial), "left").na.fill(1.0, ["recall"])


def around_frames(df: DataFrame, tolerance: int, frame: str = "frame_idx", name: str = "frame") -> DataFrame:
    """Offer each row to the frames within ``tolerance``, which turns an interval join into an equi-join."""
    return df.withColumn(name, F.explode(F.sequence(F.col(frame) - tolerance, F.col(frame) + tolerance)))


def nearest_track(truth: DataFrame, blobs: DataFrame, trial: Sequence[str], tolerance: int = 5) -> DataFrame:
    """The track with the blob nearest in time to each truth print (first track on ties), and its blob at that frame, or
    else its largest blob."""
    # Only the first track of a frame can win, and the prints of a frame share their answer: it is found per frame, and prints meet it once.
    first = blobs.groupBy(*trial, "frame").agg(F.min("track_id").alias("track_id"))
    offered = around_frames(first.withColumnRenamed("frame", "_at"), tolerance, "_at", "frame_idx")
    near = offered.groupBy(*trial, "frame_idx").agg(F.min(F.struct(F.abs(F.col("_at") - F.col("frame_idx")).alias("gap"), "track_id")).alias("b"))
    near = near.select(*trial, "frame_idx", F.col("b.gap").alias("frame_gap"), F.col("b.track_id").alias("track_id"))
    own = blobs.join(first.select(*trial, "track_id").distinct(), [*trial, "track_id"], "left_semi")
    top = own.groupBy(*trial, "track_id").agg(
        F.max_by(F.struct("frame", "area_px"), F.struct("area_px", -F.col("frame"))).alias("_top"))
    here = own.groupBy(*trial, "track_id", "frame").agg(F.max("area_px").alias("_area"))
    here = here.withColumnRenamed("frame", "frame_idx")
    near = near.join(top, [*trial, "track_id"]).join(here, [*trial, "track_id", "frame_idx"], "left")
    near = near.select(*trial, "frame_idx", "track_id", "frame_gap",
                       F.when(F.col("_area").isNotNull(), F.col("frame_idx")).otherwise(F.col("_top.frame")).alias("blob_frame"),
                       F.coalesce("_area", "_top.area_px").alias("area_px"))
    d = truth.select(*trial, "print_id", "frame_idx").distinct().join(near, [*trial, "frame_idx"])
    return d.select(*trial, "print_id", "frame_idx", "track_id", "frame_gap", "blob_frame", "area_px")


def largest_near(truth: DataFrame, blobs: DataFrame, trial: Sequence[str], reach: int = 3) -> DataFrame:
    """The largest blob within ``reach`` frames of each truth print (earliest frame on ties), or ``missed``."""
    t = around_frames(truth.select(*trial, "print_id", "frame_idx"), reach)
    b = blobs.groupBy(*trial, "frame").agg(F.max("area_px").alias("_area"))
    d = t.join(b, [*trial, "frame"], "left")
    g = d.groupBy(*trial, "print_id", "frame_idx").agg(
        F.max(F.when(F.col("_area").isNotNull(), F.struct("_area", (-F.col("frame")).alias("f")))).alias("m"))
    return g.select(*trial, "print_id", "frame_idx", F.when(F.col("m").isNull(), "missed").otherwise("matched").alias("status"),
                    (-F.col("m.f")).alias("match_frame"), F.col("m._area").alias("area_px"))


def _nearest_free(p: pd.DataFrame, t: pd.DataFrame, radius: float, tolerance: int, batch: int = 4096, pairs: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Truth row (-1 for none) and distance per prediction; both in the order of their ids, each truth open to ids up to ``_limit``.

    A batch of predictions meets only truth that is still free, by cells and frames; it ends after ``pairs`` pairs, or one prediction's."""
    side = radius * 1.001 or 1.0
    place = lambda d: [np.floor(d[c].to_numpy(float) / side).astype(np.int64) for c in ("_x", "_y")]
    (pa, pb), (ta, tb), pf, tf = place(p), place(t), p["_f"].to_numpy(np.int64), t["_f"].to_numpy(np.int64)
    a0, b0, f0 = (min(u.min(), w.min()) for u, w in ((pa, ta), (pb, tb), (pf, tf)))
    high, span = max(pb.max(), tb.max()) - b0 + 3, max(pf.max(), tf.max()) - f0 + 2 * tolerance + 1
    code = lambda a, b, f: ((a - a0 + 1) * high + b - b0 + 1) * span + f - f0 + tolerance
    tcode, limit, rank = code(ta, tb, tf), t["_limit"].to_numpy(), p["_rank"].to_numpy()
    px, py, tx, ty = (d[c].to_numpy(float) for d in (p, t) for c in ("_x", "_y"))
    free, to, far = np.ones(len(t), bool), np.full(len(p), -1), np.full(len(p), np.nan)
    start, size = 0, batch
    while start < len(p):
        part = slice(start, start + size)
        left = np.flatnonzero(free & (limit >= rank[start]))
        left = left[np.argsort(tcode[left], kind="stable")]
        at = tcode[left]
        ends = [[np.searchsorted(at, code(pa[part] + i, pb[part] + j, pf[part] + k), side="left") for k in (-tolerance, tolerance + 1)]
                for i in (-1, 0, 1) for j in (-1, 0, 1)]
        lo, hi = (np.stack(x, 1) for x in zip(*ends))
        n = max(int(np.searchsorted(np.cumsum((hi - lo).sum(1)), pairs, side="right")), 1)
        lo, count = lo[:n].ravel(), (hi - lo)[:n].ravel()
        who = np.repeat(start + np.arange(len(count)) // 9, count)
        near = left[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
        dx, dy = px[who] - tx[near], py[who] - ty[near]
        d = np.sqrt(dx * dx + dy * dy)
        keep = (d <= radius) & (limit[near] >= rank[who])
        who, near, d = who[keep], near[keep], d[keep]
        o = np.lexsort((near, d, who))
        last, taken = -1, set()
        for i, j, e in zip(who[o].tolist(), near[o].tolist(), d[o].tolist()):
            if i != last and j not in taken:
                last, to[i], far[i] = i, j, e
                taken.add(j)
        free[list(taken)] = False
        n = min(n, size)
        start, size = start + n, min(batch, 2 * n)
    return to, far


def _soonest_free(p: pd.DataFrame, t: pd.DataFrame, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by time alone: the free truth of a frame is a queue in the order of ids."""
    frames, limit = t["_f"].to_numpy(), t["_limit"].tolist()
    o = np.argsort(frames, kind="stable")
    order = o.tolist()
    cut = np.flatnonzero(np.r_[True, frames[o][1:] != frames[o][:-1]])
    queue = {int(f): [a, b] for f, a, b in zip(frames[o][cut], cut.tolist(), [*cut[1:].tolist(), len(o)])}
    to, far = np.full(len(p), -1), np.full(len(p), np.nan)
    for i, (f, rank) in enumerate(zip(p["_f"].tolist(), p["_rank"].tolist())):
        for gap in range(tolerance + 1):
            best = None
            for g in {f - gap, f + gap}:
                q = queue.get(g)
                if q is None:
                    continue
                # Truth that refuses this prediction refuses all later ones.
                while q[0] < q[1] and limit[order[q[0]]] < rank:
                    q[0] += 1
                if q[0] == q[1]:
                    del queue[g]
                elif best is None or order[q[0]] < order[best[0]]:
                    best = q
            if best is not None:
                to[i], far[i] = order[best[0]], gap
                best[0] += 1
                break
    return to, far


def match_predictions(pred: DataFrame, truth: DataFrame, trial: Sequence[str], distance_px: float = 25.0, frame_tolerance: int = 5,
                      same_limb: bool = False, spatial: bool = True, frames: int = 64, block_rows: int = 50_000) -> DataFrame:
    """Each prediction, in ``pred_id`` order, takes the nearest truth print that is still free.

    Equal to a stable matching in which every print prefers earlier predictions, so it is computed by deferred acceptance over blocks of
    ``frames`` frames (one limb, and tiles of the image where a stretch has more than ``block_rows`` prints): a block lets its predictions choose in order
    among the prints in its reach. Then every print keeps the earliest of the predictions that chose it, and blocks with a refused one choose
    again, knowing the holders, until none is refused. Rounds alternate between two divisions into blocks, so that what met at an edge is inside next time.
    A refusal is final, so predictions without a print drop out in the first round. No pair is ever a row: a round holds predictions and prints only.
    Without ``spatial`` the nearest in time is taken, and there is no error in pixels: ``error_px`` is null.
    """
    r = float(distance_px)
    cell = r * 1.001 or 1.0
    limbs = ["_limb"] if same_limb else []
    block = [*trial, "_bt", *(["_bx", "_by"] if spatial else []), *limbs]
    floor = lambda c, by: F.floor(F.col(c) / F.lit(by))

    def rows(df: DataFrame, x: str, y: str, name: str) -> DataFrame:
        d = df.dropna(subset=[*trial, "frame_idx", name, *([x, y] if spatial else [])])
        xy = [F.col(c).cast("double").alias(n) for c, n in ((x, "_x"), (y, "_y"))] if spatial else []
        limb = [F.coalesce(F.concat(F.lit("="), F.col("paw_id").cast("string")), F.lit("")).alias("_limb")] if same_limb else []
        return d.select(*trial, F.col("frame_idx").cast("long").alias("_f"), *xy, *limb, name)

    p, t = rows(pred, "cx", "cy", "pred_id"), materialise(rows(truth, "cx_px", "cy_px", "print_id"))
    tile = None
    if spatial:
        size = t.groupBy(*trial, floor("_f", frames), *limbs).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}{c}") for c in ("_x", "_y") for f in (F.min, F.max)])
        most = size.agg(F.max("n"), *[f(f"{f.__name__}{c}") for c in ("_x", "_y") for f in (F.min, F.max)]).first()
        if most[0] and most[0] > block_rows:
            tile = max(4 * cell, max(most[2] - most[1], most[4] - most[3]) / (most[0] / block_rows) ** 0.5)
        # Predictions meet the prints' cells first: most have no print near them.
        near = t.select(*trial, floor("_f", frames).alias("_bt"), *limbs, floor("_x", cell).alias("_a"), floor("_y", cell).alias("_b")).distinct()
        for c, by in (("_bt", -(-frame_tolerance // frames)), ("_a", 1), ("_b", 1)):
            near = near.withColumn(c, F.explode(F.sequence(F.col(c) - by, F.col(c) + by)))
        p = p.withColumns({"_bt": floor("_f", frames), "_a": floor("_x", cell), "_b": floor("_y", cell)})
        p = p.join(near.distinct(), [*trial, "_bt", *limbs, "_a", "_b"], "left_semi").drop("_bt", "_a", "_b")

    def blocks(df: DataFrame, half: bool, reach: bool) -> DataFrame:
        """Rows with their block; prints with every block that reaches them."""
        around = frame_tolerance if reach else 0
        cut = [("_bt", "_f", frames, frames // 2 * half, around)]
        if spatial:
            cut += [(b, c, tile, (tile or 0) / 2 * half, cell if reach else 0) for b, c in (("_bx", "_x"), ("_by", "_y"))]
        for b, c, by, shift, far in cut:
            if by is None:
                df = df.withColumn(b, F.lit(0).cast("long"))
            elif far:
                df = df.withColumn(b, F.explode(F.sequence(F.floor((F.col(c) + shift - far) / by), F.floor((F.col(c) + shift + far) / by))))
            else:
                df = df.withColumn(b, F.floor((F.col(c) + shift) / by))
        return df

    out = [*p.schema, *[f for f in t.schema if f.name == "print_id"]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", _d double"
    names = [f.name for f in out]
    held_type = p.schema["pred_id"].dataType

    def choose(group: pa.Table) -> pa.Table:
        d = group.select([c for c in ("_f", "_x", "_y") if c in group.column_names]).to_pandas()
        mine = group["pred_id"].is_valid().to_numpy()
        prints, held = group["print_id"].filter(pa.array(~mine)).to_numpy(), group["_held"].filter(pa.array(~mine))
        known = held.is_valid().to_numpy()
        ranks = np.unique(np.concatenate([group["pred_id"].drop_null().to_numpy(), held.drop_null().to_numpy()]), return_inverse=True)[1]
        limit = np.full(len(known), np.iinfo(np.int64).max)
        limit[known] = ranks[mine.sum():]
        first, order = np.argsort(ranks[:mine.sum()], kind="stable"), np.argsort(prints, kind="stable")
        ps, ts = d[mine].assign(_rank=ranks[:mine.sum()]).iloc[first], d[~mine].assign(_limit=limit).iloc[order]
        to = far = np.full(len(ps), -1)
        if len(ps) and len(ts):
            to, far = _nearest_free(ps, ts, r, frame_tolerance) if spatial else _soonest_free(ps, ts, frame_tolerance)
        got = np.flatnonzero(to >= 0)
        chosen = group.take(pa.array(np.flatnonzero(mine)[first[got]])).drop_columns(["print_id"])
        chosen = chosen.append_column("print_id", pa.array(prints[order[to[got]]], group.schema.field("print_id").type))
        return chosen.append_column("_d", pa.array(far[got], pa.float64())).select([*names, "_d"])

    def solve(p: DataFrame, t: DataFrame) -> DataFrame:
        return p.unionByName(t, allowMissingColumns=True).groupBy(*block).applyInArrow(choose, schema)

    half = False
    best = materialise(solve(blocks(p, half, False), blocks(t.withColumn("_held", F.lit(None).cast(held_type)), half, True)))
    while True:
        held = best.groupBy(*trial, "print_id").agg(F.min("pred_id").alias("_held"))
        refused = materialise(best.join(held, [*trial, "print_id"]).where(F.col("pred_id") > F.col("_held")).select(*best.columns))
        if refused.isEmpty():
            return best.select(*trial, "pred_id", "print_id", (F.col("_d") if spatial else F.lit(None).cast("double")).alias("error_px"))
        half = not half
        again = blocks(refused, half, False).select(*block).distinct()
        placed = blocks(best, half, False)
        known = blocks(t, half, True).join(again, block, "left_semi").join(held, [*trial, "print_id"], "left")
        more = solve(placed.join(again, block, "left_semi").drop("print_id", "_d"), known)
        best = materialise(placed.join(again, block, "left_anti").select(*best.columns).unionByName(more))


def evaluate(matches: DataFrame, pred: DataFrame, truth: DataFrame, trial: Sequence[str]) -> DataFrame:
    """Precision, recall, F1, mean error and upper-median error per trial (add a configuration to ``trial`` to sweep).
    Both errors are 0 where no match has an error in pixels."""
    keys = list(trial)
    np_, ng = (d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for d, n in ((pred, "n_pred"), (truth, "n_gt")))
    tp = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tp"), F.avg("error_px").alias("mean_error_px"),
                                   F.count("error_px").alias("_ne"))
    # Upper median by rank: errors are numbered within one-pixel slots, so no trial is sorted in one task.
    ranked = ordered.number_rows(matches.where("error_px is not null"), keys, ["error_px", "pred_id"], F.floor("error_px"), name="_i")
    med = (ranked.join(tp.select(*keys, "_ne"), keys).where(F.col("_i") == F.floor(F.col("_ne") / 2))
           .select(*keys, F.col("error_px").alias("median_error_px")))
    d = np_.join(ng, keys, "full").join(tp, keys, "left").join(med, keys, "left")
    d = d.na.fill(0, ["n_pred", "n_gt", "n_tp"]).na.fill(0.0, ["mean_error_px", "median_error_px"])
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = z(F.col("n_tp"), F.col("n_pred")), z(F.col("n_tp"), F.col("n_gt"))
    return d.select(*keys, "n_gt", "n_pred", "n_tp", (F.col("n_pred") - F.col("n_tp")).alias("n_fp"),
                    (F.col("n_gt") - F.col("n_tp")).alias("n_fn"), p.alias("precision"), r.alias("recall"),
                    z(2 * p * r, p + r).alias("f1"), "mean_error_px", "median_error_px")


def _group_near(pdf: pd.DataFrame, keys: list[str], radius: float) -> pd.DataFrame:
    """Transitive groups of the points of all frames of a batch. Cells are small enough that points sharing one belong
    together; only points of neighbouring cells are compared."""
    g = pdf.groupby(keys, sort=False).ngroup().to_numpy()
    side = radius / np.sqrt(2.0)
    pts = pd.DataFrame({"i": np.arange(len(pdf)), "g": g, "a": np.floor(pdf["cx"] / side).astype("int64"),
                        "b": np.floor(pdf["cy"] / side).astype("int64"), "x": pdf["cx"], "y": pdf["cy"]})
    cell = pts.groupby(["g", "a", "b"])["i"].transform("min").to_numpy()
    ea, eb = [pts["i"].to_numpy()], [cell]
    for da in range(0, 3):
        for db in range(-2, 3):
            if (da, db) <= (0, 0):
                continue
            other = pts.assign(a=pts["a"] - da, b=pts["b"] - db)
            m = pts.merge(other, on=["g", "a", "b"], suffixes=("", "_o"))
            near = np.hypot(m["x"] - m["x_o"], m["y"] - m["y_o"]) <= radius
            ea.append(m.loc[near, "i"].to_numpy())
            eb.append(m.loc[near, "i_o"].to_numpy())
    root = _components(len(pdf), np.concatenate(ea), np.concatenate(eb))
    return pdf.assign(foot_id=pdf["label"].to_numpy()[root].astype("int32"))


def group_blobs(blobs: DataFrame, radius: float = 25.0, keys: Sequence[str] = ("trial_id", "frame")) -> DataFrame:
    """``foot_id``: blobs of a frame whose centroids are linked by steps of at most ``radius`` share the smallest label."""
    names = list(keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blobs.schema) + ", foot_id int"
    return batched_groups(blobs, keys, ("label",), lambda pdf: _group_near(pdf, names, radius), schema)


def foot_intensity(blobs: DataFrame, pixels: DataFrame, keys: Sequence[str] = ("trial_id", "frame"), value: str = "g") -> DataFrame:
    """Mean, maximum, minimum and sum of a channel over the boxes of each foot's blobs, per ``foot_id``.

    A pixel in the boxes of several blobs of a foot counts once. Pixels are those of ``pixels``, one row each; feet whose boxes hold none have no row.
    """
    cols = [*keys, "foot_id"]
    inside = pixels_in_boxes(pixels.select(*keys, "x", "y", F.col(value).alias("_v")), blobs.select(*cols, "x1", "y1", "x2", "y2"), keys)
    once = inside.groupBy(*cols, "x", "y").agg(F.max("_v").alias("_v"))
    return once.groupBy(*cols).agg(F.avg("_v").alias("intensity_mean"), F.max("_v").alias("intensity_max"), F.min("_v").alias("intensity_min"),
                                   F.sum("_v").cast("double").alias("intensity_total"))


def merge_blobs(blobs: DataFrame, keys: Sequence[str] = ("trial_id", "frame"), px_per_mm: float | None = None,
                stance_area: int = 30, pixels: DataFrame | None = None, value: str = "g") -> DataFrame:
    """One row per grouped foot: union box, area-weighted centroid, area and stance flag.

    With the ``pixels`` of the frames also :func:`foot_intensity`, 0 where a foot's boxes hold no pixel.
    """
    a = F.sum("area_px")
    w = lambda c: F.sum(F.col(c) * F.col("area_px")) / a
    mm2 = (px_per_mm or 1.0) ** 2
    feet = blobs.groupBy(*keys, "foot_id").agg(
        a.cast("int").alias("area_px"), (a / float(mm2)).alias("area_mm2"), w("cx").alias("cx"), w("cy").alias("cy"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.count(F.lit(1)).alias("n_blobs"), (a >= stance_area).alias("is_in_stance"))
    if pixels is None:
        return feet
    names = [f"intensity_{n}" for n in ("mean", "max", "min", "total")]
    return feet.join(foot_intensity(blobs, pixels, keys, value), [*keys, "foot_id"], "left").fillna(0, names)


def quadrant_pick(feet: DataFrame, axis: DataFrame, keys: Sequence[str], frame_keys: Sequence[str], foot: str = "det_id",
                  x: str = "cx", y: str = "cy") -> DataFrame:
    """Limb labels from the body axis: per girdle and side the foot nearest the body's middle along the axis.

    ``axis`` has ``p1x, p1y, p2x, p2y`` per ``keys`` (a trial or a frame). A foot on the axis counts as left.
    """
    d = feet.join(axis, list(keys))
    ax, ay = F.col("p2x") - F.col("p1x"), F.col("p2y") - F.col("p1y")
    n = F.sqrt(ax * ax + ay * ay)
    dx, dy = F.col(x) - F.col("p1x"), F.col(y) - F.col("p1y")
    d = d.where(n >= 1e-6).withColumns({"_par": (dx * ax + dy * ay) / n, "_perp": (ax * dy - ay * dx) / n, "_mid": n / 2.0})
    limb = F.concat(F.when(F.col("_perp") > 0, "R").otherwise("L"), F.when(F.col("_par") > F.col("_mid"), "F").otherwise("H"))
    pick = F.min(F.struct(F.abs(F.col("_par") - F.col("_mid")).alias("off"), F.col(foot).alias("id")))
    g = d.groupBy(*frame_keys, limb.alias("limb")).agg(pick.alias("p"))
    return g.select(*frame_keys, "limb", F.col("p.id").alias(foot), F.col("p.off").alias("offset_px"))


def closest_area(truth: DataFrame, blobs: DataFrame, keys: Sequence[str], low: float = 0.3, high: float = 4.0) -> DataFrame:
    """Per truth print the blob of its frame whose area ratio is nearest to 1 on a log scale, within (low, high); the smallest label on ties.

    Only the nearest area from below and from above can win, so prints and the areas of a frame meet in one order instead of in pairs. Ratios whose
    logarithms agree to 12 places tie: those of an area and its inverse differ by rounding only.
    """
    b = blobs.where(F.col("area_px") >= 5).groupBy(*keys, F.col("area_px").alias("_a")).agg(F.min("label").alias("_label"))
    b = b.select(*keys, F.col("_a").cast("double").alias("_at"), F.struct("_a", "_label").alias("_blob"))
    t = truth.withColumn("_at", F.greatest(F.col("gt_area"), F.lit(1)).cast("double"))
    # Prints of one area share the answer, so a frame's order holds distinct areas.
    sizes = t.select(*keys, "_at").distinct().withColumn("_print", F.lit(True))
    both = b.unionByName(sizes, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at")
    # A range frame takes blobs of the same area along.
    under = F.last("_blob", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    over = F.last("_blob", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.withColumns({"_under": under, "_over": over}).where("_print")

    def offer(blob: str) -> Column:
        r = F.col(f"{blob}._a") / F.col("_at")
        d = F.abs(F.log(r))
        return F.when((r > low) & (r < high), F.struct(F.round(d, 12).alias("r"), F.col(f"{blob}._label").alias("label"), d.alias("d")))

    best = F.least(offer("_under"), offer("_over")).alias("_best")
    best = both.select(*keys, "_at", best).where("_best IS NOT NULL")
    return t.join(best, [*keys, "_at"]).select(*keys, "print_id", F.col("_best.label").alias("label"), F.col("_best.d").alias("log_ratio"))
