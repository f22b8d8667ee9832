"""Every graph-signal query against its oracle on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from spectrafold import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def same(spark_frame, oracle_frame):
    one, other = (f[sorted(f)].sort_values(sorted(f)).reset_index(drop=True).astype(str) for f in (spark_frame, oracle_frame))
    assert list(one) == list(other)
    assert one.equals(other)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_oracle(spark, tables, name):
    same(catalog.QUERIES[name](spark, str(DATA)).toPandas(), tables.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["gsr_sampler", "gsr_planned", "gsr_by_nation", "rnc_lineitem_variance"])
def test_models_give_finite_rows(spark, name):
    frame = catalog.QUERIES[name](spark, str(DATA)).toPandas()
    assert len(frame) and not frame.isna().any().any()
