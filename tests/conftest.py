import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from threatlens.session import build_session

    s = build_session("local[4]", shuffle_partitions=8)
    if not s.sparkContext.getCheckpointDir():   # only where unset, as in tests
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="threatlens-test-ckpt-"))
    yield s
    s.stop()


def col1(spark, values, expr, typ="string"):
    """Evaluate a column function over a one-column literal table, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(expr("v")).collect()]
