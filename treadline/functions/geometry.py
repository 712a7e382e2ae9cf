"""Geometry as Column expressions. Every function takes and returns Columns and stays inside code generation."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def midpoint(a: Column, b: Column) -> Column:
    return (a + b) / 2.0


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def slope(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Rise over run; a vertical line has slope +infinity."""
    dx = x2 - x1
    return F.when(dx == 0, F.lit(math.inf)).otherwise(F.try_divide(y2 - y1, dx))


def angle_from_slope(m: Column) -> Column:
    """Direction of a slope in degrees, in [0, 180)."""
    deg = F.degrees(F.atan(m))
    return F.when(m >= 0, deg).otherwise(deg + 180.0)


def axis_angle(toe_x: Column, toe_y: Column, heel_x: Column, heel_y: Column,
               p1x: Column, p1y: Column, p2x: Column, p2y: Column) -> Column:
    """Angle between heel->toe and p1->p2, folded to [0, 180] degrees."""
    d = F.abs(F.atan2(toe_y - heel_y, toe_x - heel_x) - F.atan2(p2y - p1y, p2x - p1x))
    return F.degrees(F.when(d > math.pi, 2 * math.pi - d).otherwise(d))


def point_line_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to the infinite line a-b; a degenerate line counts as length 1."""
    dx, dy = bx - ax, by - ay
    length = F.sqrt(dx * dx + dy * dy)
    return F.abs(dx * (py - ay) - dy * (px - ax)) / F.when(length == 0, 1.0).otherwise(length)


def signed_angle(v1x: Column, v1y: Column, v2x: Column, v2y: Column) -> Column:
    """Angle from v1 to v2 in [-180, 180] degrees (step angle: hind->fore line against the body axis)."""
    return F.degrees(F.atan2(v1x * v2y - v1y * v2x, v1x * v2x + v1y * v2y))


def flip_y(y: Column, height: float) -> Column:
    return F.lit(float(height)) - y


def confident(value: Column, likelihood: Column, threshold: float = 0.1) -> Column:
    """Coordinates below the likelihood threshold are missing."""
    return F.when(likelihood >= threshold, value)


def expand_box(x1: Column, y1: Column, x2: Column, y2: Column, pad: int, width: int, height: int) -> Column:
    """Grow a box by ``pad`` and clamp it to the frame."""
    return F.struct(
        F.greatest(F.lit(0), x1 - pad).alias("x1"), F.greatest(F.lit(0), y1 - pad).alias("y1"),
        F.least(F.lit(width), x2 + pad).alias("x2"), F.least(F.lit(height), y2 + pad).alias("y2"))


def boxes_intersect(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Open-interval overlap of two boxes: touching edges do not count."""
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    return ~((ax2 <= bx1) | (ax1 >= bx2) | (ay2 <= by1) | (ay1 >= by2))


def touches_edge(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    """Box reaches the one-pixel border of the frame."""
    return (x1 <= 1) | (y1 <= 1) | (x2 >= width - 1) | (y2 >= height - 1)


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1))


def project(p: Sequence[Column], x: Column, y: Column, z: Column) -> Column:
    """Pinhole projection by a 3x4 matrix given as 12 columns in row order; depth is kept away from zero."""
    w = p[8] * x + p[9] * y + p[10] * z + p[11]
    w = F.when(F.abs(w) < 1e-9, 1e-9).otherwise(w)
    return F.struct(((p[0] * x + p[1] * y + p[2] * z + p[3]) / w).alias("u"),
                    ((p[4] * x + p[5] * y + p[6] * z + p[7]) / w).alias("v"))


def reprojection_error(p: Sequence[Column], x: Column, y: Column, z: Column, u: Column, v: Column) -> Column:
    """Pixel distance between an observation and the projection; +infinity where the depth vanishes."""
    w = p[8] * x + p[9] * y + p[10] * z + p[11]
    uv = project(p, x, y, z)
    return F.when(F.abs(w) < 1e-9, F.lit(math.inf)).otherwise(distance(uv["u"], uv["v"], u, v))


def rotation_from_vector(rx: Column, ry: Column, rz: Column) -> list[Column]:
    """Rotation matrix (9 columns, row order) of a rotation vector, by the axis-angle formula."""
    theta = F.sqrt(rx * rx + ry * ry + rz * rz)
    small = theta < 1e-12
    safe = F.when(small, 1.0).otherwise(theta)
    x, y, z = rx / safe, ry / safe, rz / safe
    c, s = F.cos(theta), F.sin(theta)
    t = 1 - c
    rot = [t * x * x + c, t * x * y - s * z, t * x * z + s * y,
           t * x * y + s * z, t * y * y + c, t * y * z - s * x,
           t * x * z - s * y, t * y * z + s * x, t * z * z + c]
    eye = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    return [F.when(small, e).otherwise(r) for e, r in zip(eye, rot)]


def projection_from_pose(k: Sequence[Column], r: Sequence[Column], t: Sequence[Column]) -> Column:
    """``P = K [R | t]`` as an array of 12 in row order."""
    rt = [[r[0], r[1], r[2], t[0]], [r[3], r[4], r[5], t[1]], [r[6], r[7], r[8], t[2]]]
    return F.array(*[k[3 * i] * rt[0][j] + k[3 * i + 1] * rt[1][j] + k[3 * i + 2] * rt[2][j]
                     for i in range(3) for j in range(4)])
