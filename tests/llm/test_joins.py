"""No join of what grows with the input is left to Spark's expected sizes, which an explode makes far too small."""

import re

import pytest
from pyspark.sql import functions as F

from leakdrift.llm import common, lines, neardup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module, query", [(neardup, neardup.op6_minhash_near_dedup), (lines, lines.op10_line_dedup)])
def test_every_join_says_how_it_is_made(spark, monkeypatch, module, query):
    plans, real = [], common.written

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    monkeypatch.setattr(common, "written", kept)
    monkeypatch.setattr(module, "written", kept)
    plans.append(query(spark, SF)._jdf.queryExecution().optimizedPlan().toString())
    joins = [line for p in plans for line in p.splitlines() if re.match(r"[\s:+|-]*Join ", line)]
    assert len(joins) > 20
    assert not [j for j in joins if "strategy=" not in j]


def test_slots_of_all_bands_are_not_broadcast(spark):
    # 2,000 rows of 2,000 elements: Spark expects some 20 KB and four million rows come.
    rows = spark.range(2000).selectExpr("id", "sequence(0, 1999) as s")
    slots = common.written(rows).selectExpr("id", "explode(s) as value")
    sizes = slots.groupBy("value").count()
    plan = common.shuffled_join(slots, sizes, "value")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_hubs_are_broadcast_once_and_only_where_there_can_be_any(spark, tmp_path):
    spark.range(5000).selectExpr("id % 3 as u", "id + 3 as v").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    many = common.with_least(rows, least, 5000)
    assert {(r.u, r.v, r.m) for r in many.collect()} == {(k % 3, k + 3, k % 3 + 3) for k in range(5000)}
    plan = many._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("BroadcastExchange") == 1, plan
    few = common.with_least(rows.where("v < 200"), least, 197)
    assert few.count() == 197 and "roadcast" not in few._jdf.queryExecution().optimizedPlan().toString()
