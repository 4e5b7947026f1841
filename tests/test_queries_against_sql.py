import glob
import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def canonical(frame):
    import pandas as pd

    out = []
    for r in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple("" if pd.isna(x) else f"{float(x):.5f}" if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "if" else str(x) for x in r))
    return sorted(out)


def names():
    from quern.plans import general, reference

    return sorted({**general.ORACLE, **reference.ORACLE})


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, name):
    from quern.plans import general, reference

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = {**general.QUERIES, **reference.QUERIES}[name](spark, SF).toPandas()
    want = db.execute({**general.ORACLE, **reference.ORACLE}[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
