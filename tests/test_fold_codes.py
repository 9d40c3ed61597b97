"""Codes of all columns and folds from first sightings, against the code of each fold on its own."""

import pytest
from pyspark.sql import functions as F

from backtrail.operators import folds as fd

BORDERS = {"none": "2024-01-01", "some": "2024-01-11", "all": "2025-01-01"}


@pytest.fixture
def rows(spark):
    made = [(i, i * 11 % 17, None if i % 9 == 0 else -(i * 5 % 7), f"2024-01-{1 + i % 28:02d}") for i in range(120)]
    return spark.createDataFrame(made, "event_id long, a int, b int, day string").withColumn("event_ts", F.col("day").cast("timestamp")).drop("day")


@pytest.mark.parametrize("heavy", [False, True])
def test_equals_one_fold_at_a_time(rows, request, heavy):
    if heavy:
        request.getfixturevalue("tight")
    got = {r["event_id"]: r for r in fd.encode_folds(rows, rows, ["a", "b"], "event_ts", BORDERS).collect()}
    assert len(got) == 120
    for fold, border in BORDERS.items():
        known = rows.filter(F.col("event_ts") < F.lit(border).cast("timestamp"))
        for want in fd.encode(rows, known, ["a", "b"]).collect():
            for c in ("a", "b"):
                assert got[want["event_id"]][f"{c}_code_{fold}"] == want[f"{c}_code"]


def test_empty_tables(rows):
    coded = fd.encode_folds(rows, rows.limit(0), ["a", "b"], "event_ts", BORDERS)
    assert coded.select("a_code_all", "b_code_some").distinct().collect() == [(1, 1)]
    assert fd.encode_folds(rows.limit(0), rows, ["a"], "event_ts", BORDERS).count() == 0
