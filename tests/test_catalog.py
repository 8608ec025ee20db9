"""Every query that has SQL agrees with it on the smallest tables."""

import os

import pytest

from compare import compare, duck
from rollframe.catalog import load_catalog

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
CAT = load_catalog()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no data")
@pytest.mark.parametrize("name", sorted(CAT.queries))
def test_query(spark, con, name):
    line, good = compare(spark, con, name, CAT.queries[name], CAT.sql.get(name), SF)
    assert good, line


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["uid", "traj_id", "score", "advantage"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
