"""Every registered query with SQL against DuckDB on the smallest tables; the others must run and return rows."""

import duckdb
import pytest

from cloudweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "embeddings", "events", "documents")
#: Fixpoints that take long and have tests of their own.
SLOW = {"register_scans", "icp_planes", "random_walker", "chameleon", "supervoxels", "labelling_expansion", "labelling_swap", "density_peaks_modified"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    columns = sorted(df.columns)

    def text(v):
        return "" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)

    return columns, sorted(tuple(text(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_runs(spark, name):
    found = catalog.queries()[name](spark, SF)
    assert found.columns and found.count() > 0
