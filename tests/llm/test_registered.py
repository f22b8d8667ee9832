"""The registered queries on the smallest tables, and the pipeline."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from spectrafold.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, name):
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    df, other = queries.QUERIES[name](spark, str(DATA)), c.execute(queries.ORACLES[name])
    names = [d[0] for d in other.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str(tuple(r)) for r in df.select(names).collect()) == sorted(map(str, other.fetchall()))


def test_all_operators_are_registered():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


def test_pipeline_stages(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(DATA))
        if name != "packing":
            docs = docs.persist()
            assert docs.columns == columns and 0.7 * before <= docs.count() <= before
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert corpus_pipeline.run(spark, str(DATA)).count() > 0
