"""Scalar gait metrics, unit conversions and scores as Column expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.try_divide(a, b)).otherwise(0.0)


def cycle_ms(stance: Column, swing: Column) -> Column:
    return stance + swing


def stance_pct(stance: Column, swing: Column) -> Column:
    return _ratio(100.0 * stance, stance + swing)


def swing_pct(stance: Column, swing: Column) -> Column:
    return _ratio(100.0 * swing, stance + swing)


def duty_cycle(stance: Column, swing: Column) -> Column:
    return _ratio(stance, stance + swing)


def swing_to_stance(stance: Column, swing: Column) -> Column:
    return _ratio(swing, stance)


def cadence(stride_hz: Column) -> Column:
    """Steps per minute: two steps per stride."""
    return 2.0 * stride_hz * 60.0


def gait_symmetry(l_stance: Column, r_stance: Column, l_swing: Column, r_swing: Column) -> Column:
    """1 - |L-R|/(L+R), averaged over stance and swing; 0 when either sum vanishes."""
    a, b = l_stance + r_stance, l_swing + r_swing
    score = ((1.0 - F.try_divide(F.abs(l_stance - r_stance), a))
             + (1.0 - F.try_divide(F.abs(l_swing - r_swing), b))) / 2.0
    return F.when((a == 0) | (b == 0), 0.0).otherwise(score)


def symmetry_index(left: Column, right: Column) -> Column:
    top = F.greatest(left, right)
    return F.when(top <= 0, 0.0).otherwise(F.try_divide(100.0 * F.least(left, right), top))


def swing_speed(stride_mm: Column, swing_ms: Column) -> Column:
    return _ratio(stride_mm, swing_ms)


def ratio_asymmetry(left: Column, right: Column) -> Column:
    """max(r, 1/r) of two sides: 1 when both vanish, infinite when only one does."""
    r = F.try_divide(left, right)
    return (F.when((left == 0) & (right == 0), 1.0)
            .when((left == 0) | (right == 0), math.inf)
            .otherwise(F.greatest(r, F.try_divide(F.lit(1.0), r))))


def intensity_asymmetry(left: Column, right: Column) -> Column:
    return _ratio(F.abs(left - right), left + right)


def pressure(delta: Column) -> Column:
    """Pressure of a brightness increase; increases up to 8 grey levels are noise."""
    return 18.0 * F.pow(F.greatest(delta - 8.0, F.lit(0.0)), F.lit(0.75))


def time_to_frame(seconds: Column, fps: float) -> Column:
    """1-based frame at a time, rounding halves to even."""
    return F.greatest(F.lit(1), F.rint(seconds * float(fps)).cast("int") + 1)


def cm_to_px(cm: Column, px_per_mm: float, origin_px: float = 0.0) -> Column:
    return F.lit(float(origin_px)) + cm * (px_per_mm * 10.0)


# Fixed value: pattern of a coordinate pair in free text.
XY_PATTERN = r"[\(\s]*(-?\d+(?:\.\d+)?)[\s,]+(-?\d+(?:\.\d+)?)[\s\)]*"


def parse_xy(text: Column) -> Column:
    """``"(133, 436)"`` or ``"133, 436"`` -> struct(x, y); text without a pair is (0, 0)."""
    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(text, XY_PATTERN, i).try_cast("double"), F.lit(0.0))
    return F.struct(part(1).alias("x"), part(2).alias("y"))


def px_to_mm(px: Column, px_per_mm: float) -> Column:
    return px / px_per_mm


def px2_to_mm2(px2: Column, px_per_mm: float) -> Column:
    return px2 / (px_per_mm * px_per_mm)


def px2_to_cm2(px2: Column, px_per_mm: float) -> Column:
    return px2 / (px_per_mm * px_per_mm) / 100.0


def frames_to_seconds(frames: Column, fps: Column | float) -> Column:
    fps = F.lit(float(fps)) if isinstance(fps, (int, float)) else fps
    return frames / F.greatest(fps, F.lit(1.0))


def duration_s(frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, F.try_divide(frames, fps)).otherwise(0.0)


def detector_score(valid: Column, assigned: Column, short: Column, unassigned: Column) -> Column:
    return 10.0 * valid + 2.0 * assigned - 3.0 * short - 0.5 * unassigned


def green_excess(r: Column, g: Column, b: Column) -> Column:
    return 2.0 * g - r - b


def colour_distance_score(r: Column, g: Column, b: Column, target: tuple[float, float, float]) -> Column:
    """300 minus the distance to a target colour, not below 0."""
    tr, tg, tb = target
    d = F.sqrt((r - tr) * (r - tr) + (g - tg) * (g - tg) + (b - tb) * (b - tb))
    return F.greatest(F.lit(0.0), 300.0 - d)


def display_round(v: Column) -> Column:
    """Four digits for values below 100, two above."""
    return F.when(F.abs(v) < 100, F.round(v, 4)).otherwise(F.round(v, 2))
