"""Every registered query of the library against its SQL, row by row."""

import os

import duckdb
import pytest
from ledgerweave.catalog import MODULES
from ledgerweave.session import TABLES

CASES = [(name, run, sql) for module in MODULES for name, (run, sql) in module.QUERIES.items()]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        path = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize(("name", "run", "sql"), CASES, ids=[c[0] for c in CASES])
def test_query_equals_sql(spark, duck, sf_dir, name, run, sql):
    df = run(spark, sf_dir)
    rows = [r.asDict() for r in df.collect()]
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: repr([canonical(r[c]) for c in sorted(columns)])
    assert sorted(map(key, rows)) == sorted(key(dict(zip(columns, r, strict=True))) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_answers_of_a_hot_account_keep_all_rows(spark, sf_dir, tmp_path):
    from ledgerweave.operators.statements import QUERIES
    from pyspark.sql import functions as F

    run, sql = QUERIES["sanitize_rows"]
    kinds = F.array(F.lit("purchase"), F.lit("view"), F.lit("click"))
    hot = F.when(F.col("id") < 5000, 7).otherwise(10 + F.col("id") % 5)  # ten's answer is broken JSON
    spark.range(5050).select(
        F.col("id").alias("event_id"), F.expr("timestamp_seconds(1700000000 + id)").alias("ts"), hot.cast("long").alias("user_id"),
        F.get(kinds, (F.col("id") % 3).cast("int")).alias("event_type"), (F.col("id") % 977 / 100).alias("value"), F.lit("{}").alias("props"),
    ).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    df = run(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
    assert max(r[1] for r in want) > 4000
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
