"""Every catalogue query against its SQL over the driver's smallest tables."""

import math
import os
from glob import glob

import duckdb
import pytest

from tallyforge.plans import catalogue_run  # noqa: F401  adds its queries
from tallyforge.plans.catalogue import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


def comparable(rows):
    return sorted((tuple(f"{x:.6g}" if isinstance(x, float) and not math.isnan(x) else str(x) for x in r) for r in rows))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF_DIR)
    theirs = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    assert comparable(ours.select(*names).collect()) == comparable(theirs.fetchall())
