"""The queries on members and on lists of files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakdrift.functions import checks
from leakdrift.functions import inventory as V
from leakdrift.operators import members, objects
from leakdrift.plans import records, state
from leakdrift.plans.oracles import C, EXT, HAS_EXT, SCORED, any_of, q
from leakdrift.sources.corpus import corpus, table


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who ask their nation's team to take them in, some of them twice."""
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.col("c_nationkey").cast("long").alias("team"), (F.col("c_custkey") % 700).alias("member"), F.col("c_custkey").alias("added_at"))


def k09_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = state.people(spark, sf_dir).withColumn("added_at", F.lit(-1).cast("long")).drop("active")
    return members.admissions(people, arrivals(spark, sf_dir), limit=30)


def k09_offboarding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries of each team's last member leaving."""
    people = state.people(spark, sf_dir).withColumn("role", F.when(F.col("member") % 2 == 0, "Admin").otherwise("Member"))
    gone = people.groupBy("team").agg(F.max("member").alias("member"))
    # The summaries are of those who leave, so only their grants are made: a row's map has no other members of the team.
    leaving = people.join(F.broadcast(gone), ["team", "member"], "left_semi")
    held = objects.issued(state.keys(spark, sf_dir), leaving, lambda _: F.lit("x"))
    return members.offboarded(people, held, gone, F.lit("2024-06-01").cast("timestamp"), "owner")[2].drop("removed_at")


def b03_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each preset leaves out of the files."""
    path, size = F.col("file_path"), F.octet_length("content")
    kinds = {"source": V.SOURCE_CODE, "config": V.CONFIG_FILES, "all": V.ALL_FILES}
    return corpus(spark, sf_dir).select("doc_id", *[V.skip_reason(path, size, c).alias(f"{k}_reason") for k, c in kinds.items()])


def b04_hook_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", "file_path", V.hook_takes(F.col("file_path")).alias("taken"))


def f03_files_with_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold 3 in their path, and whether they have findings."""
    files = V.search(corpus(spark, sf_dir).select("doc_id", "file_path"), "3", hidden=False)
    return V.with_secrets(files, records.findings(spark, sf_dir))


def j05_largest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred files that a list by size shows first."""
    path = F.concat("file_path", F.lit("/"), F.col("doc_id").cast("string"))
    rows = corpus(spark, sf_dir).select(path.alias("file_path"), (F.col("doc_id") % 50 == 0).alias("is_directory"), F.octet_length("content").alias("size"), checks.is_encrypted(path).alias("is_encrypted"), F.lit(0).alias("modified"))
    return V.listed(rows, "size", 100).select("file_path", "is_directory", "size")


QUERIES = {f.__name__: f for f in (k09_admissions, k09_offboarding, b03_presets, b04_hook_files, f03_files_with_secrets, j05_largest_files)}


def skip_sql(config: V.ScanConfig) -> str:
    out = f"case when strlen(content) > {config.largest} then 'File too large: ' || strlen(content) || ' bytes'"
    if config.included:
        out += f" when {HAS_EXT} and {EXT} not in {any_of(config.included)} then 'Extension not in include list: ' || {EXT}"
    if config.excluded:
        out += f" when {HAS_EXT} and {EXT} in {any_of(config.excluded)} then 'Extension in exclude list: ' || {EXT}"
    return out + "".join(f" when contains(lower(file_path), {q(w)}) then {q('Path contains excluded component: ' + w)}" for w in config.parts) + " end"


LEFT_OUT = " or ".join([*[f"ends_with(file_path, {q(x)})" for x in V.BINARY_SUFFIXES], "ends_with(file_path, '.test.js')", "ends_with(file_path, '.spec.ts')", "starts_with(file_path, 'test/')", "starts_with(file_path, 'tests/')", "ends_with(file_path, '.md')"])

ORACLES = {
    "k09_admissions": """with recursive p as (select s_nationkey as team, s_suppkey as member from supplier),
      a as (select c_nationkey as team, c_custkey % 700 as member, c_custkey as added_at, row_number() over (partition by c_nationkey order by c_custkey, c_custkey % 700) as k from customer),
      s as (select t.team, cast(0 as bigint) as k, cast(-1 as bigint) as member, cast(-1 as bigint) as added_at, cast(null as varchar) as error, list_transform(list(p.member) filter (p.member is not null), lambda x: cast(x as bigint)) as known
        from (select distinct team from a) t left join p on p.team = t.team group by t.team
       union all select a.team, a.k, a.member, a.added_at, case when len(coalesce(s.known, [])) >= 30 then 'Maximum team size reached' when list_contains(s.known, a.member) then 'Member already exists' end,
        case when len(coalesce(s.known, [])) >= 30 or coalesce(list_contains(s.known, a.member), false) then s.known else list_append(coalesce(s.known, cast([] as bigint[])), cast(a.member as bigint)) end
        from s join a on a.team = s.team and a.k = s.k + 1)
      select team, member, added_at, error from s where k > 0""",
    "k09_offboarding": """with p as (select s_nationkey as team, s_suppkey as member, s_acctbal >= 0 as active from supplier), g as (select team, max(member) as member from p group by 1),
      n as (select p_size % 25 as team, count(*) as n from part group by 1)
      select g.team, g.member, case when g.member % 2 = 0 then 'Admin' else 'Member' end as role, case when p.active then coalesce(n.n, 0) else 0 end as keys_revoked
      from g join p on p.team = g.team and p.member = g.member left join n on n.team = g.team""",
    "b03_presets": f"with c as ({C}) select doc_id, {skip_sql(V.SOURCE_CODE)} as source_reason, {skip_sql(V.CONFIG_FILES)} as config_reason, {skip_sql(V.ALL_FILES)} as all_reason from c",
    "b04_hook_files": f"with c as ({C}) select doc_id, file_path, not ({LEFT_OUT}) as taken from c",
    "f03_files_with_secrets": SCORED + "select doc_id, file_path, file_path in (select file_path from l) as has_secrets from c where contains(lower(file_path), '3') and not starts_with(regexp_extract(file_path, '[^/]*$'), '.')",
    "j05_largest_files": f"with c as ({C}) select file_path || '/' || doc_id as file_path, doc_id % 50 = 0 as is_directory, cast(strlen(content) as int) as size from c order by is_directory desc, size desc, file_path limit 100",
}
