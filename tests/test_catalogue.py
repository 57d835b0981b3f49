"""Every core query against its SQL; those without SQL must run and keep their columns."""

import os

import pytest

import __spark_entry__
from panelforge.plans import catalogue
from tests.compare import DATA, check

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, name):
    check(spark, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


@pytest.mark.parametrize("name", ["task_build_all", "simulate_tasks"])
def test_tasks_take_every_test_question(spark, name):
    asked = {r[0] for r in spark.read.parquet(f"{DATA}/questions.parquet").where("split = 'test'").select("variable_name").collect()}
    got = {}
    for r in catalogue.QUERIES[name](spark, DATA).select("respondent_id", "question").collect():
        got.setdefault(r[0], []).append(r[1])
    assert got and all(sorted(x) == sorted(asked) for x in got.values())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
