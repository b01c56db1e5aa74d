"""Members' lifecycle: who is taken in, who leaves, and what goes with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakdrift.operators import objects

FULL, KNOWN = "Maximum team size reached", "Member already exists"


def admissions(people: DataFrame, new: DataFrame, limit: int = 20) -> DataFrame:
    """new (team, member, added_at, more) with `error`, as if its rows were added one after another; null where one is taken in.

    A team that has `limit` members, active or not, takes nobody; a member that is there, or was taken in by an earlier
    row, isn't taken again. Rows of a team go by (added_at, member); rows that tie in both are one attempt each. Rows
    without a team or member are left out, as they have no place.
    """
    new = new.where("team is not null and member is not null")
    held = people.groupBy("team").agg(F.count("*").alias("_held"))
    known = people.select("team", "member").distinct().withColumn("_known", F.lit(True))
    rows = new.join(known, ["team", "member"], "left")
    again = Window.partitionBy("team", "member").orderBy("added_at")
    rows = rows.withColumn("_fresh", F.col("_known").isNull() & (F.row_number().over(again) == 1))
    # How many were taken in before a row, had the team no limit; beyond it nobody is, so the limit is met at once.
    before = Window.partitionBy("team").orderBy("added_at", "member", F.col("_fresh").desc()).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.count_if("_fresh").over(before), F.lit(0))
    rows = rows.withColumn("_taken", taken).join(held, "team", "left")
    error = F.when(F.coalesce("_held", F.lit(0)) + F.col("_taken") >= limit, FULL).when(~F.col("_fresh"), KNOWN)
    return rows.select(*new.columns, error.alias("error"))


def with_admitted(people: DataFrame, new: DataFrame, limit: int = 20) -> DataFrame:
    """people (team, member, added_at, more) and the members of `new`, with the same columns, that are taken in."""
    return people.unionByName(admissions(people, new, limit).where("error is null").select(*people.columns))


def deactivated(people: DataFrame, gone: DataFrame) -> DataFrame:
    """people, with those in `gone` (team, member) no longer active; they stay rows."""
    out = gone.select("team", "member").distinct().withColumn("_gone", F.lit(True))
    rows = people.join(out, ["team", "member"], "left")
    return rows.withColumn("active", F.col("active") & F.col("_gone").isNull()).select(*people.columns)


def offboarded(people: DataFrame, keys: DataFrame, gone: DataFrame, now: Column, by: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """What is left of people and keys (with grants) without the members in `gone`, and three records of their leaving:

    a summary (team, member, role, keys_revoked, removed_at), revocations of their tokens (member, at), and audit entries
    (timestamp, operation, actor, details). Members that aren't there leave no record.
    """
    leaving = people.join(gone.select("team", "member").distinct(), ["team", "member"], "left_semi").select("team", "member", "role").distinct()
    # Of a key's grants only those that go become rows; who leaves is sent to every task.
    out = leaving.where("member is not null").groupBy("team").agg(F.collect_set("member").alias("_gone"))
    held = keys.join(F.broadcast(out), "team").select("team", F.explode(F.array_intersect("_gone", F.map_keys("grants"))).alias("member"))
    held = held.groupBy("team", "member").agg(F.count("*").alias("_n"))
    summary = leaving.join(held, ["team", "member"], "left").select("team", "member", "role", F.coalesce("_n", F.lit(0)).alias("keys_revoked"), now.alias("removed_at"))
    text = F.concat(F.lit("Offboarded member: "), F.col("member").cast("string"), F.lit(" (role: "), "role", F.lit(", keys revoked: "), F.col("keys_revoked").cast("string"), F.lit(")"))
    entries = summary.select(F.unix_timestamp("removed_at").alias("timestamp"), F.lit("member_offboarding").alias("operation"), F.lit(by).alias("actor"), text.alias("details"))
    left = people.join(leaving.select("team", "member"), ["team", "member"], "left_anti").select(*people.columns)
    return left, objects.without_members(keys, leaving), summary, summary.select("member", F.col("removed_at").alias("at")), entries
