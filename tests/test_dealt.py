"""What one task holds doesn't grow with the tables: keys are dealt by the number of rows."""

import re

import pytest

from hopspark.plans.catalogue import QUERIES
from hopspark.plans.oracle import ORACLE
from hopspark.sources import scratch
from oracle import SF, assert_same


@pytest.mark.parametrize("name", ["key_violations", "append_edges"])
def test_partitions_follow_the_rows(spark, monkeypatch, name):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(scratch, "TASK_ROWS", n // 10)
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    groups = [int(x) for x in re.findall(r"Exchange hashpartitioning\([^\n]*, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert groups and max(groups) >= 10
    # no keys of edges are grouped or joined in a number of partitions of Spark's own
    assert not re.search(r"Exchange hashpartitioning\((source|target|o_orderkey|l_orderkey)[^\n]*ENSURE_REQUIREMENTS", plan)
    assert_same(spark, QUERIES[name], ORACLE[name])
