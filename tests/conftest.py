import os
import sys

import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from check import session

    return session("4")


@pytest.fixture
def tight(spark):
    """Lower every size setting, so that small data takes the way of heavy keys and large tables."""
    from check import TIGHT

    for key, value in TIGHT.items():
        spark.conf.set(key, str(value))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield spark
    for key in TIGHT:
        spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture
def seven(spark):
    """One customer: a tie, a negative and a missing amount, a window edge and empty windows."""
    rows = [
        (1, "2025-03-31 22:00:00", 100, 7), (2, "2025-03-31 22:30:00", -50, 7), (3, "2025-03-31 23:00:00", 70, 8),
        (4, "2025-03-31 23:00:00", 200, 7), (5, "2025-03-31 23:30:00", 1000, 8), (6, "2025-04-01 22:30:00", None, 7),
        (7, "2025-04-04 10:00:00", 500, 9),
    ]
    df = spark.createDataFrame(rows, "event_id long, event_dttm string, amt int, event_desc int").withColumn("amt", F.col("amt").cast("double"))
    return df.selectExpr(
        "1L as customer_id", "event_id", "cast(event_dttm as timestamp) as event_ts",
        "unix_timestamp(cast(event_dttm as timestamp)) as sec", "amt", "cast(amt * 100 as long) as cents", "event_desc",
    )
