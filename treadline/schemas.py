"""Fixed vocabularies and table schemas. Units: millimetres, seconds, pixels, frames; missing numbers are NULL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Limb labels in canonical order.
LIMBS = ("LF", "RF", "LH", "RH")

# Limb dimension (limb, long name, side, girdle, toe body part, heel body part).
LIMB_ROWS = (
    ("LF", "LeftFore", "L", "fore", "LeftForeToe", "LeftForeHeel"),
    ("RF", "RightFore", "R", "fore", "RightForeToe", "RightForeHeel"),
    ("LH", "LeftHind", "L", "hind", "LeftHindToe", "LeftHindHeel"),
    ("RH", "RightHind", "R", "hind", "RightHindToe", "RightHindHeel"),
)
# Body axis parts.
AXIS_PARTS = ("Nose", "MidPoint1", "MidPoint2", "Butt")

# Default calibration.
DEFAULT_FPS = 60.0
DEFAULT_PX_PER_MM = 1.92

LIMB_SCHEMA = "limb string, limb_name string, side string, girdle string, toe string, heel string"


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
KEYPOINTS = _schema(trial_id=_S, frame=_I, bodypart=_S, x=_D, y=_D, likelihood=_D)
GROUND_TRUTH = _schema(print_id=_I, frame_idx=_I, cx_px=_D, cy_px=_D, paw_id=_S)
DETECTION = _schema(trial_id=_S, frame=_I, det_id=_I, cx=_D, cy=_D, x1=_I, y1=_I, x2=_I, y2=_I, area_px=_I,
                    mean_intensity=_D, peak_intensity=_D, touches_edge=_B)
BODY_ROI = _schema(trial_id=_S, frame=_I, tx1=_I, ty1=_I, tx2=_I, ty2=_I, ex1=_I, ey1=_I, ex2=_I, ey2=_I, area_px=_I)


def limb_dimension(spark: SparkSession) -> DataFrame:
    """The four limbs: a fixed dimension, safe to broadcast."""
    return spark.createDataFrame(LIMB_ROWS, LIMB_SCHEMA)
