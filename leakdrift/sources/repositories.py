"""Repositories that Spark derives from the given tables: their files' paths, ignore lines and attribute lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakdrift.sources.corpus import corpus, table

#: Ignore lines; the same text runs in Spark and in SQL oracles.
IGNORE_LINES = """
select s_nationkey % 2 as repo, cast(s_suppkey as int) as line_no, case s_suppkey % 12
  when 0 then concat('# rules of ', s_name) when 1 then '' when 2 then '*.lock' when 3 then concat('!tests/t', cast(s_suppkey * 4 as {V}), '.lock')
  when 4 then 'node_modules/' when 5 then concat('/lib/z', cast(s_suppkey * 2 + 5 as {V})) when 6 then 'img/*'
  when 7 then concat('!img/p', cast(s_suppkey * 2 as {V}), '.png') when 8 then 'docs/**' when 9 then 'src/svc?.rs'
  when 10 then case s_suppkey % 3 when 0 then '  .env  ' when 1 then 'Cargo.*' else '*.json' end
  else concat('config/app*', cast(s_suppkey % 10 as {V}), '.env') end as line
from supplier
"""
#: Attribute lines.
ATTRIBUTE_LINES = """
select p_size % 2 as repo, cast(p_partkey as int) as line_no, case p_partkey % 9
  when 0 then concat('# ', p_name) when 1 then '' when 2 then 'config/*  leakdrift-encrypt filter=x' when 3 then 'node_modules/* vendor'
  when 4 then concat('lib/z', cast(p_partkey as {V}), ' encrypt ') when 5 then concat('src/svc', cast(p_partkey - 5 as {V}), '.rs sign diff text')
  when 6 then concat('*.lock lock-', cast(p_partkey % 5 as {V})) when 7 then 'lonely' else concat('* filter=git-crypt', ' diff=git-crypt') end as line
from part
"""


def derived(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    """The text's rows over the given table."""
    return spark.sql(text.format(V="string").replace(f"from {name}", f"from {{{name}}}"), **{name: table(spark, sf_dir, name)})


def ignore_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, IGNORE_LINES, "supplier")


def attribute_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, ATTRIBUTE_LINES, "part")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with the repository that each file is in."""
    return corpus(spark, sf_dir).withColumn("repo", F.col("doc_id") % 2)
