"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from framewright import queries as engine

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    names = sorted(frame.columns)
    return sorted(tuple("" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", ["alloc_neyman", "chance_pps_capped", "srswor_stratified", "systematic_serp", "pps_multinomial", "two_stage", "ht_mean_se_strat", "overlap_negative"])
def test_query_and_sql_agree(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.sql(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    assert rows_of(engine.queries()[name](spark, SF).toPandas()) == rows_of(db.sql(engine.oracle_sql()[name]).df())


def repeated(folder, name, key, times, where="true"):
    """A copy of a smallest table, repeated with shifted keys, and a database that sees it."""
    db = duckdb.connect()
    db.sql(f"create view {name} as select t.* replace (({key} + 1000000 * r)::BIGINT as {key}) from '{SF}/{name}.parquet' t, range({times}) r(r) where {where}")
    db.sql(f"copy {name} to '{folder}/{name}.parquet' (format parquet)")
    return db


def test_more_certain_units_than_draws(spark, tmp_path):
    db = repeated(tmp_path, "part", "p_partkey", 12, "p_size > 44")
    assert db.sql("select max(n) from (select count(*) n from part where p_size >= 49 group by p_brand)").fetchall()[0][0] > 30
    assert rows_of(engine.queries()["chance_certainty_size"](spark, str(tmp_path)).toPandas()) == rows_of(db.sql(engine.oracle_sql()["chance_certainty_size"]).df())


@pytest.mark.parametrize("name", ["pps_multinomial", "joint_multinomial"])
def test_draws_by_intervals_are_one_pass(spark, tmp_path, name):
    db = repeated(tmp_path, "part", "p_partkey", 20)
    got = engine.queries()[name](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan.replace("unboundedpreceding$(), unboundedfollowing", "")
    assert rows_of(got.toPandas()) == rows_of(db.sql(engine.oracle_sql()[name]).df())


def test_pairs_of_one_pool_are_dealt_out(spark, tmp_path):
    db = repeated(tmp_path, "part", "p_partkey", 20)
    got = engine.queries()["joint_poisson"](spark, str(tmp_path))
    assert rows_of(got.toPandas()) == rows_of(db.sql(engine.oracle_sql()["joint_poisson"]).df())
    assert got.rdd.getNumPartitions() >= 16


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
