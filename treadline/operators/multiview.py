"""Multi-view geometry. Observations: ``keys, camera, u, v``; the rig: ``camera, p`` (12 numbers, row order).

Views of one point are gathered in one row (as many as there are cameras), so the solvers work on whole Arrow batches.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from treadline.functions import geometry as geo
from treadline.operators.pixels import batched_groups

# Fixed value: a projection closer to the camera plane than this has no image point.
MIN_DEPTH = 1e-9


def rig_from_pose(cameras: DataFrame) -> DataFrame:
    """Projection matrices from intrinsics ``k`` (9), rotation vector ``rvec`` (3) and translation ``tvec`` (3)."""
    r = geo.rotation_from_vector(*[F.col("rvec")[i] for i in range(3)])
    return cameras.withColumn("p", geo.projection_from_pose(
        [F.col("k")[i] for i in range(9)], r, [F.col("tvec")[i] for i in range(3)]))


def camera_columns(rig: DataFrame, limit: int = 256) -> Column:
    """The rig as a literal map from camera to its 12 numbers, for projecting every point into every camera. More than
    ``limit`` cameras are an error, so what is put into the plan has a proven bound; all else joins on the camera."""
    rows = rig.select("camera", "p").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a rig of more than {limit} cameras")
    return _literal_rig(rows)


def _literal_rig(rows: Sequence[Row]) -> Column:
    return F.create_map(*[c for r in rows for c in (F.lit(r["camera"]), F.array(*[F.lit(float(x)) for x in r["p"]]))])


def gather_views(obs: DataFrame, rig: DataFrame, keys: Sequence[str], complete: bool = True,
                 recording: Sequence[str] | None = None) -> DataFrame:
    """One row per point with its views in camera order; unknown cameras drop out.

    ``complete`` keeps only points that every camera of their recording saw: a missing row drops the point as a missing
    or infinite coordinate does. ``recording`` is the first of ``keys`` unless named. Points with fewer than two views are
    dropped; a recording with fewer than two cameras of the rig has no points at all, and is an error while the plan runs if
    ``complete``. The cameras of a recording are counted map-side first, so a hot recording is no hot task.
    """
    bad = F.col("u").isNull() | F.col("v").isNull() | F.isnan("u") | F.isnan("v") | (F.abs("u") == float("inf")) | (F.abs("v") == float("inf"))
    rows = rig.select("camera", "p").limit(257).collect()
    small = 0 < len({r["camera"] for r in rows}) == len(rows) <= 256 and all(r["camera"] is not None and r["p"] and None not in r["p"] for r in rows)
    # A rig of bounded size goes into the plan as in :func:`camera_columns`: a join would spread the observations by camera,
    # and every view would be shuffled with its matrix.
    d = obs.where(F.col("camera").isin([r["camera"] for r in rows])) if small else obs.join(rig.select("camera", "p"), "camera")
    view = F.struct("camera", *([] if small else ["p"]), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    g = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(~bad, view))).alias("views"))
    views = F.col("views")
    if small:
        cameras = _literal_rig(rows)
        views = F.transform("views", lambda v: F.struct(v["camera"].alias("camera"), cameras[v["camera"]].alias("p"), v["u"].alias("u"), v["v"].alias("v")))
    if not complete:
        return g.where(F.size("views") >= 2).select(*keys, views.alias("views"))
    whole = list(recording or keys[:1])
    n = d.select(*whole, "camera").distinct().groupBy(*whole).agg(F.count(F.lit(1)).alias("_n"))
    few = F.concat(F.lit("fewer than two cameras in recording "), F.to_json(F.struct(*whole)))
    count = F.when(F.col("_n") < 2, F.raise_error(few).cast("long")).otherwise(F.col("_n"))
    return g.join(n, whole).where(F.size("views") == count).select(*keys, views.alias("views"))


def _solve(p: np.ndarray, uv: np.ndarray) -> np.ndarray:
    """Linear triangulation of many points: ``p`` (n, views, 3, 4), ``uv`` (n, views, 2) -> (n, 3), NaN at infinity.

    Rows are scaled by the size of the image point; the solution is the eigenvector of the smallest eigenvalue.
    """
    s = np.maximum(np.linalg.norm(uv, axis=2), 1.0)[:, :, None]
    a = np.concatenate([(uv[:, :, 0:1] * p[:, :, 2] - p[:, :, 0]) / s, (uv[:, :, 1:2] * p[:, :, 2] - p[:, :, 1]) / s], axis=1)
    x = np.linalg.svd(a, full_matrices=True)[2][:, -1]
    w = x[:, 3]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = x[:, :3] / w[:, None]
    out[np.abs(w) < 1e-12] = np.nan
    return out


def _errors(p: np.ndarray, uv: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Pixel error per point and view; infinite where the depth vanishes."""
    h = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    q = np.einsum("nvij,nj->nvi", p, h)
    flat = np.abs(q[:, :, 2]) < MIN_DEPTH
    with np.errstate(divide="ignore", invalid="ignore"):
        e = np.hypot(q[:, :, 0] / q[:, :, 2] - uv[:, :, 0], q[:, :, 1] / q[:, :, 2] - uv[:, :, 1])
    e[flat] = np.inf
    return e


def _robust(p: np.ndarray, uv: np.ndarray, threshold: float) -> np.ndarray:
    """Best pair of views by inliers, then by median error over all views; all views together where no pair works."""
    best = _solve(p, uv)
    top = np.full(len(p), -1)
    med = np.full(len(p), np.inf)
    for a, b in combinations(range(p.shape[1]), 2):
        x = _solve(p[:, [a, b]], uv[:, [a, b]])
        e = _errors(p, uv, x)
        ok = np.isfinite(e).all(axis=1)
        n, m = (e <= threshold).sum(axis=1), np.median(e, axis=1)
        win = ok & (n > 0) & ((n > np.maximum(top, 0)) | ((n == top) & (m < med)))
        best[win], top[win], med[win] = x[win], n[win], m[win]
    return best


def triangulate(views: DataFrame, keys: Sequence[str], robust: bool = True, threshold: float = 3.0, keep: Sequence[str] = ()) -> DataFrame:
    """``x, y, z``, mean reprojection error and confidence ``1 / (1 + error)`` per point. ``keep`` are columns taken along."""
    fields = {f.name: f.dataType.simpleString() for f in views.schema}
    head, cols = ", ".join(f"`{c}` {fields[c]}" for c in keys), list(keys)
    tail, kept = "".join(f", `{c}` {fields[c]}" for c in keep), list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = batch.column("views")
            n, each = seen.value_lengths().to_numpy(zero_copy_only=False), seen.flatten()
            first = np.cumsum(n) - n
            all_p = each.field("p").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 3, 4)
            all_uv = np.stack([each.field(c).to_numpy(zero_copy_only=False) for c in "uv"], axis=1)
            out = np.full((len(n), 4), np.nan)
            for k in np.unique(n):
                at = np.flatnonzero(n == k)
                rows = first[at][:, None] + np.arange(k)
                p, uv = all_p[rows], all_uv[rows]
                x = _robust(p, uv, threshold) if robust and k > 2 else _solve(p, uv)
                out[at, :3], out[at, 3] = x, _errors(p, uv, x).mean(axis=1)
            gone = np.isnan(out[:, :3]).any(axis=1)
            solved = [pa.array(out[:, i], pa.float64(), mask=gone) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in cols], *solved, *[batch.column(c) for c in kept]],
                                             names=[*cols, "x", "y", "z", "reproj_err", *kept])

    d = views.mapInArrow(run, f"{head}, x double, y double, z double, reproj_err double{tail}")
    return d.withColumn("confidence", F.coalesce(F.try_divide(F.lit(1.0), 1.0 + F.col("reproj_err")), F.lit(0.0)))


def project_points(points: DataFrame, rig: DataFrame) -> DataFrame:
    """Image position of every point in every camera."""
    d = points.select("*", F.explode(camera_columns(rig)).alias("camera", "p"))
    uv = geo.project([F.col("p")[i] for i in range(12)], F.col("x"), F.col("y"), F.col("z"))
    return d.withColumn("_uv", uv).select(*points.columns, "camera", F.col("_uv.u").alias("u"), F.col("_uv.v").alias("v"))


def view_errors(points: DataFrame, obs: DataFrame, rig: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reprojection error per point and camera."""
    d = obs.join(points.select(*keys, "x", "y", "z"), list(keys))
    d = d.join(rig.select("camera", "p"), "camera")
    e = geo.reprojection_error([F.col("p")[i] for i in range(12)], *[F.col(c) for c in ("x", "y", "z", "u", "v")])
    return d.select(*keys, "camera", e.alias("error_px"))


def joint_rms(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Root mean square of the errors per joint."""
    return errors.groupBy(*keys).agg(F.sqrt(F.avg(F.col("error_px") * F.col("error_px"))).alias("rms_px"))


def joint_angles(points: DataFrame, skeleton: Sequence[tuple[str, str]], keys: Sequence[str], joint: str = "joint") -> DataFrame:
    """Angle at each joint between (parent - joint) and (grandparent - parent); 0 where the parent is the root.

    ``skeleton`` lists (parent, child). The joints of a frame, a fixed few, are gathered in one map. Missing or
    coincident points give no angle.
    """
    parent = {c: p for p, c in skeleton}
    pos = F.map_from_entries(F.collect_list(F.struct(F.col(joint).alias("k"), F.struct("x", "y", "z").alias("v"))))
    g = points.where("x is not null").groupBy(*keys).agg(pos.alias("m"))

    def vec(a: str, b: str) -> list[Column]:
        return [F.try_element_at("m", F.lit(b))[c] - F.try_element_at("m", F.lit(a))[c] for c in "xyz"]

    def norm(v: list[Column]) -> Column:
        return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])

    rows = []
    for child, par in parent.items():
        v1 = vec(child, par)
        v2 = vec(par, parent[par]) if par in parent else v1
        n1, n2 = norm(v1), norm(v2)
        cos = sum((a * b for a, b in zip(v1, v2)), F.lit(0.0)) / (n1 * n2)
        angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
        rows.append(F.struct(F.lit(child).alias(joint), F.when((n1 >= 1e-9) & (n2 >= 1e-9), angle).alias("angle_deg")))
    return g.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def _normal_equations(x: np.ndarray, p: np.ndarray, uv: np.ndarray, seen: np.ndarray, ends: np.ndarray, lengths: np.ndarray,
                      bone_weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix, gradient and cost of every frame: ``x`` (frames, joints, 3), ``uv`` (frames, cameras, joints, 2), ``ends`` (bones, 2)."""
    f, j = x.shape[:2]
    q = np.einsum("cij,fnj->fcni", p[:, :, :3], x) + p[None, :, None, :, 3]
    z = np.where(np.abs(q[..., 2]) < MIN_DEPTH, MIN_DEPTH, q[..., 2])
    pr = q[..., :2] / z[..., None]
    res = np.where(seen[..., None], pr - uv, 0.0)
    jac = (p[None, :, None, :2, :3] - pr[..., None] * p[None, :, None, 2:3, :3]) / z[..., None, None]
    jac = np.where(seen[..., None, None], jac, 0.0)
    a, each = np.zeros((f, j, 3, j, 3)), np.arange(j)
    a[:, each, :, each, :] = np.einsum("fcnri,fcnrk->nfik", jac, jac)
    a = a.reshape(f, 3 * j, 3 * j)
    g = np.einsum("fcnri,fcnr->fni", jac, res).reshape(f, 3 * j)
    cost = (res ** 2).sum(axis=(1, 2, 3))
    if len(ends):
        d = x[:, ends[:, 0]] - x[:, ends[:, 1]]
        long = np.maximum(np.linalg.norm(d, axis=2), 1e-12)
        r, u = bone_weight * (long - lengths), bone_weight * d / long[..., None]
        row, bone = np.zeros((f, len(ends), j, 3)), np.arange(len(ends))
        row[:, bone, ends[:, 0]] = u
        row[:, bone, ends[:, 1]] = -u
        row = row.reshape(f, len(ends), 3 * j)
        a += row.transpose(0, 2, 1) @ row
        g += np.einsum("fb,fbi->fi", r, row)
        cost += (r ** 2).sum(axis=1)
    return a, g, cost


def _refine_frames(x0: np.ndarray, p: np.ndarray, uv: np.ndarray, seen: np.ndarray, bones, bone_weight: float, rounds: int) -> np.ndarray:
    """Damped Gauss-Newton on reprojection and bone-length residuals, for all frames with the same joints and cameras at once.

    Each frame has its own damping and stops by itself; those that have stopped are not worked on any more.
    """
    ends = np.array([b[:2] for b in bones], dtype=int).reshape(-1, 2)
    lengths = np.array([b[2] for b in bones], dtype=float)
    x, lam, j = x0.copy(), np.full(len(x0), 1e-3), x0.shape[1]
    a, g, cost = _normal_equations(x, p, uv, seen, ends, lengths, bone_weight)
    on, eye = np.arange(len(x)), np.eye(3 * j)
    for _ in range(rounds):
        damped = a[on] + lam[on, None, None] * (a[on] * eye + 1e-12 * eye)
        tried = x[on] + np.linalg.solve(damped, -g[on, :, None]).reshape(-1, j, 3)
        na, ng, ncost = _normal_equations(tried, p, uv[on], seen[on], ends, lengths, bone_weight)
        better = ncost < cost[on]
        done = np.where(better, cost[on] - ncost <= 1e-12 * cost[on], lam[on] * 10 > 1e8)
        hit = on[better]
        x[hit], a[hit], g[hit], cost[hit] = tried[better], na[better], ng[better], ncost[better]
        lam[on] = np.where(better, lam[on] / 10, lam[on] * 10)
        on = on[~done]
        if not len(on):
            break
    return x


def refine(points: DataFrame, views: DataFrame | None, bones: Sequence[tuple[str, str, float]],
           frame_keys: Sequence[str] = ("trial_id", "frame"), joint: str = "joint", bone_weight: float = 100.0,
           rounds: int = 50) -> DataFrame:
    """Refine the joints of each frame together against the image points and the bone lengths.

    ``views`` is None if ``points`` has them as its own column, which saves a join. ``bones`` lists (joint, joint, length). Joints without a position stay missing, and their bones are left out.
    """
    keys = list(frame_keys)
    d = points.select(*keys, joint, "x", "y", "z", *(["views"] if views is None else []))
    d = d if views is None else d.join(views.select(*keys, joint, "views"), [*keys, joint], "left")
    links = list(bones)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name in (*keys, joint))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        good = pdf[pdf["x"].notna() & pdf["views"].notna()]
        xyz = pdf[["x", "y", "z"]].to_numpy(float, na_value=np.nan)
        alike: dict[tuple, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for at in good.groupby(keys, sort=False, dropna=False).indices.values():
            rows = good.index.to_numpy()[at]
            seen_by = [{v["camera"]: v for v in views} for views in good["views"].iloc[at]]
            rig = {c: np.asarray(v["p"], float).reshape(3, 4) for views in seen_by for c, v in views.items()}
            cams = sorted(rig)
            uv = np.array([[(views[c]["u"], views[c]["v"]) if c in views else (0.0, 0.0) for views in seen_by] for c in cams], dtype=float)
            seen = np.array([[c in views for views in seen_by] for c in cams])
            group = (tuple(good[joint].iloc[at]), tuple(cams), b"".join(rig[c].tobytes() for c in cams))
            alike.setdefault(group, []).append((rows, uv, seen))
        for (names, cams, p), frames in alike.items():
            idx = {name: n for n, name in enumerate(names)}
            here = [(idx[m], idx[n], t) for m, n, t in links if m in idx and n in idx]
            rows, uv, seen = (np.stack(part) for part in zip(*frames))
            xyz[rows] = _refine_frames(xyz[rows], np.frombuffer(p).reshape(len(cams), 3, 4), uv, seen, here, bone_weight, rounds)
        out = pdf[[*keys, joint]].copy()
        for i, c in enumerate("xyz"):
            out[c] = pd.Series(xyz[:, i], index=out.index).astype(object).where(~np.isnan(xyz[:, i]), None)
        return out

    return batched_groups(d, keys, (joint,), solve, f"{head}, x double, y double, z double")


def link_to_prints(points: DataFrame, prints: DataFrame, rig: DataFrame, camera: str, trial: Sequence[str] = ("trial_id",)) -> DataFrame:
    """Nearest projected 3D joint to each print at its peak frame: ``print_id, joint, distance_px``.

    ``prints`` has ``print_id, peak_area_frame, cx, cy``. The joints of a frame are a fixed few, so the join is bounded.
    """
    uv = project_points(points, rig.where(F.col("camera") == camera))
    pr = prints.withColumnRenamed("peak_area_frame", "frame").select(*trial, "print_id", "frame", "cx", "cy")
    d = pr.join(uv, [*trial, "frame"]).withColumn("_d", geo.distance(F.col("cx"), F.col("cy"), F.col("u"), F.col("v")))
    g = d.groupBy(*trial, "print_id").agg(F.min(F.struct("_d", "joint")).alias("b"))
    return g.select(*trial, "print_id", F.col("b.joint").alias("joint"), F.col("b._d").alias("distance_px"))
