"""Every query outside the llm subpackage against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalog
from tidemark.session import ship
from verify import canonical

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ship(spark)
    df = QUERIES[name](spark, FOLDER)
    mine = pd.DataFrame([r.asDict(True) for r in df.collect()], columns=df.columns)
    if name in SQL:
        cur = con.execute(SQL[name])
        theirs = pd.DataFrame(cur.fetchall(), columns=[c[0] for c in cur.description])
        assert sorted(mine.columns) == sorted(theirs.columns) and canonical(mine) == canonical(theirs)


def test_unknown_query(spark):
    with pytest.raises(LookupError):
        catalog.run(spark, FOLDER, "nothing")
    assert catalog.run(spark, FOLDER, "ag22_usage_window", days=3).select("day").distinct().count() == 3


def test_views(spark):
    catalog.register_views(spark, FOLDER)
    assert spark.sql("SELECT count(*) FROM media").first()[0] == 240
