"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from formspark.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(float(x), 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(columns).collect()
    if name in ORACLES:
        want = con.execute(ORACLES[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert plain(rows) == plain([tuple(r[i] for i in order) for r in want.fetchall()])


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["source", "type", "found", "valid", "review"]
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_what_the_removable_part_needs():
    import subprocess
    import sys

    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.abspath(__spark_entry__.__file__)))
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))], out.stderr
