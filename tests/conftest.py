import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TREADLINE_SHUFFLE_PARTITIONS", "4")
    from treadline.session import local_session
    s = local_session("4", "tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def contact_df(spark):
    """Contact rows from a string of 0/1 per (trial, limb)."""
    def make(signals, **cols):
        rows = [(t, l, i, int(c)) for (t, l), s in signals.items() for i, c in enumerate(s)]
        df = spark.createDataFrame(rows, "trial_id string, limb string, frame int, in_stance int")
        from pyspark.sql import functions as F
        return df.withColumns({k: F.expr(e) for k, e in cols.items()})
    return make
