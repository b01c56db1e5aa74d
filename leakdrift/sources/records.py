"""Sources and sinks of records: members and keys in JSON folders, rules from files, the audit log as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakdrift.operators.rules import Rule, rules_from

MEMBER = "id string, public_key string, signing_key string, role string, added_at long, added_by string, active boolean"
METADATA = "struct<created_at:long,created_by:string,purpose:string,algorithm:string,expires_at:long>"
KEY = f"id string, encrypted_for_members map<string,string>, metadata {METADATA}, signature string"
RULES = "rules array<struct<id:string,name:string,description:string,rule_type:string,secret_type:string,confidence:double,pattern:string,case_sensitive:boolean,min_entropy:double,min_length:int,max_length:int,keywords:array<string>,context_radius:int,require_high_entropy:boolean>>"
#: Between the four parts of a line of the audit log.
BAR = " | "


def json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record of each .json file that lies in the folder itself; folders below, such as of archived keys, are not read.

    A file that isn't a record of the schema is an error.
    """
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").option("mode", "FAILFAST").json(path)


def members(spark: SparkSession, path: str) -> DataFrame:
    return json_folder(spark, path, MEMBER)


def keys(spark: SparkSession, path: str) -> DataFrame:
    return json_folder(spark, path, KEY)


def grants_of(found: DataFrame) -> DataFrame:
    """Keys to (key_id, member), one row for each grant."""
    return found.select(F.col("id").alias("key_id"), F.explode(F.map_keys("encrypted_for_members")).alias("member"))


def rules(spark: SparkSession, path: str) -> list[Rule]:
    """The rules of a JSON file or folder of files with a list `rules`; whatever a rule lacks is an error before any scan.

    Rules are settings of a job, so they come to the driver.
    """
    rows = spark.read.schema(RULES).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("rules")).collect()
    return rules_from([{"type" if k == "rule_type" else k: v for k, v in r.asDict().items() if v is not None} for r in rows])


def audit_entries(lines: DataFrame) -> DataFrame:
    """Lines (value) of four parts to (timestamp, operation, actor, details); a timestamp that is no whole number is 0."""
    parts = F.split("value", r" \| ", -1)
    stamp = F.when(F.get(parts, F.lit(0)).rlike(r"\A\+?[0-9]+\z"), F.expr("try_cast(split(value, ' [|] ', -1)[0] as bigint)"))
    rows = lines.where(F.size(parts) == 4)
    return rows.select(F.coalesce(stamp, F.lit(0)).alias("timestamp"), *[F.get(parts, F.lit(k)).alias(n) for k, n in ((1, "operation"), (2, "actor"), (3, "details"))])


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    return audit_entries(spark.read.text(path))


def audit_lines(entries: DataFrame) -> DataFrame:
    return entries.select(F.concat_ws(BAR, F.col("timestamp").cast("string"), "operation", "actor", "details").alias("value"))


def append_audit(entries: DataFrame, path: str) -> None:
    """Adds entries to the log; those of a failed write are not seen."""
    audit_lines(entries).write.mode("append").text(path)


def newest(entries: DataFrame, most: int | None = None) -> DataFrame:
    """The entries from the newest on, `most` of them at most; those of one time by their other columns."""
    rows = entries.orderBy(F.desc("timestamp"), "operation", "actor", "details")
    return rows if most is None else rows.limit(most)


def export_objects(objects: DataFrame, path: str) -> None:
    """Payloads beside their metadata (path, payload, size, checksum, algorithm), in a folder for each algorithm."""
    record = F.struct(F.col("path").alias("original_path"), "size", "checksum", "algorithm")
    objects.select("path", "payload", F.to_json(record).alias("metadata"), "algorithm").write.mode("overwrite").partitionBy("algorithm").parquet(path)
