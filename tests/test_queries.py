"""Every registered query against its SQL, on the smallest folder; the driver's contract."""

import glob
import math
import os

import duckdb
import pytest

from vigilflow import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def key(row):
    return tuple((v is None, round(v, 9) if isinstance(v, float) and not math.isnan(v) else v) if not isinstance(v, str) else (False, v) for v in row)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((key(r) for r in frame.select(*columns).collect()), key=str)
    if name not in registry.ORACLES:
        assert got
        return
    want = con.sql(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert got == sorted((key(r) for r in want), key=str)


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLES) <= set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_enrichment_reads_text_once_and_few_columns(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = registry.QUERIES["relevance_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and plan.count("ArrowEvalPython [") == 1
    assert "Cartesian" not in registry.QUERIES["cross_source_bonus"](spark, SF)._jdf.queryExecution().executedPlan().toString()


BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


@pytest.mark.parametrize("name", ["cycle_public_items", "normalize_news", "cycle_counters", "threat_score"])
def test_batches_are_bounded(spark, name):
    """A query of these settings alone must bound what a Python worker gets at once, also when its plan was made before."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    @F.arrow_udf("struct<n:long,bytes:long>")
    def seen(texts: pa.Array) -> pa.Array:
        return pa.array([{"n": len(texts), "bytes": texts.nbytes}] * len(texts), pa.struct([("n", pa.int64()), ("bytes", pa.int64())]))

    for _ in range(2):
        for key in BATCH:
            spark.conf.unset(key)
        registry.QUERIES[name](spark, SF)
        most = lambda rows, length: spark.range(0, rows, 1, 1).select(seen(F.repeat(F.lit("x"), F.lit(length) + (F.col("id") % 2).cast("int"))).alias("s")).agg(F.max("s.n"), F.max("s.bytes")).first()
        assert most(3000, 10)[0] <= 500
        assert most(300, 100_000)[1] <= 5_000_000
