"""All registered queries against their SQL twins on the smallest tables; tools/check.py takes other sizes."""

import pytest
from check import compare, oracle
from conftest import FOLDER

from __spark_entry__ import FLAGSHIP, entry, oracle_sql, queries
from backtrail.plans import REGISTRY

SQL = oracle_sql()
NAMES = sorted(set(SQL) & set(REGISTRY))
# Forms for heavy keys and large lookups are compared on these as well.
TIGHT_NAMES = [
    FLAGSHIP, "past_amount_moments", "signed_velocity_windows", "trailing_row_means", "label_history_logs",
    "running_priors", "customer_profiles", "average_precision_ties",
]


@pytest.fixture(scope="module")
def duck():
    return oracle(FOLDER)


def check(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    cursor = duck.execute(SQL[name])
    problem = compare(rows, df.columns, cursor.fetchall(), [d[0] for d in cursor.description])
    spark.catalog.clearCache()
    assert problem is None, problem


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    check(spark, duck, name)


@pytest.mark.parametrize("name", TIGHT_NAMES)
def test_equals_sql_when_keys_are_heavy(tight, duck, name):
    check(tight, duck, name)


def test_entry_gives_rows(spark):
    assert entry(spark).count() > 0
