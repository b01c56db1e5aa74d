"""The queries on records, reports and settings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakdrift.functions import checks
from leakdrift.operators import oplog, scan, team
from leakdrift.plans.oracles import LOG, MAY, MEMBERS, SCORED, SEVERITIES, any_of, q
from leakdrift.sources import records
from leakdrift.sources.corpus import corpus, op_log, table
from leakdrift.sources.repositories import derived

#: Lines of an audit log, some of them broken; the same text runs in Spark and in SQL oracles.
AUDIT_LINES = """
select concat(case event_id % 10 when 1 then 'bad' else cast(event_id * 37 % 100003 as {V}) end, ' | ', event_type, ' | user', cast(user_id as {V}),
  case event_id % 10 when 0 then '' when 2 then ' | a | b' else concat(' | ', props) end) as value
from events
"""
#: Settings, some of them wrong.
SETTINGS = """
select p_partkey, case p_partkey % 8 when 0 then concat('memory_cost=', cast(p_size * 50000 as {V})) when 1 then concat('time_cost=', cast(p_size * 4 as {V}))
  when 2 then concat('parallelism=', cast(p_partkey % 20 as {V})) when 3 then concat(p_name, '=x') when 4 then p_brand
  when 5 then concat('max_size=', repeat('y', cast(p_partkey % 1200 as int))) when 6 then concat('memory_cost=', p_type) else concat('memory_cost=', cast(p_size * 100 as {V})) end as pair
from part
"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.scored(scan.pattern_matches(corpus(spark, sf_dir)))
    return scan.first_of_span(rows.withColumn("stage", F.lit(0)).withColumnRenamed("name", "detector_name"))


def a12_audit_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.audit_entries(derived(spark, sf_dir, AUDIT_LINES, "events"))


def j04_newest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.newest(a12_audit_entries(spark, sf_dir), 100)


def a07_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.report(findings(spark, sf_dir), {"min_confidence": 0.3, "include_low_confidence": True})


def b17_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, those of every third document suppressed wherever the same value stands in the same file; what is reportable."""
    found = findings(spark, sf_dir)
    marked = scan.mark_ignored(found, found.where("doc_id % 3 = 0"))
    return marked.select("doc_id", "start_position", "is_ignored", (~F.col("is_ignored") & (F.col("confidence") >= 0.3)).alias("reportable"))


def g05_risk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.risk_totals(findings(spark, sf_dir))


def g06_scan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_status(findings(spark, sf_dir))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each operation as its service's memory."""
    return op_log(spark, sf_dir).select("event_id", "service", "ts", (F.col("duration_ms") * 10_000).cast("long").alias("usage"))


def g12_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = oplog.memory_stats(usage(spark, sf_dir), 7 * 86_400)
    return rows.select("service", "uptime_s", *[F.round(c, 6).alias(c) for c in ("current_mb", "peak_mb", "average_mb")], F.round("growth_mb_per_s", 9).alias("growth_mb_per_s"))


def i05_memory_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.growth(usage(spark, sf_dir), 7 * 86_400, 7 * 86_400)


def l15_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, SETTINGS, "part").select("p_partkey", checks.config_errors(F.col("pair")).alias("found"))
    return rows.select("p_partkey", checks.is_valid(F.col("found")).alias("is_valid"), F.array_join(F.transform("found", lambda e: e["message"]), "; ").alias("messages"))


def l08_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", checks.permissions((F.col("p_partkey") % 512).cast("int"), F.col("p_size") % 2 == 0).alias("letters"))


def f08_key_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team.key_ids(team.grants(table(spark, sf_dir, "lineitem")), team.members(table(spark, sf_dir, "supplier")))


def f08_grant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether members may have a key: asked of each part by its lines' numbers, taken for members."""
    lines = table(spark, sf_dir, "lineitem")
    asked = lines.select(F.col("l_partkey").alias("key_id"), F.col("l_linenumber").cast("long").alias("member")).distinct()
    return team.grant_lookup(team.grants(lines), team.members(table(spark, sf_dir, "supplier")), asked)


def f09_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team.allowed(team.members(table(spark, sf_dir, "supplier")))


def n03_verify_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sealed under a key and verified with it, every third with another one; null texts are no ciphertexts."""
    right, wrong = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    sealed = team.encrypted(table(spark, sf_dir, "documents").select("doc_id", "text"), right)
    return sealed.select("doc_id", team.verified(F.col("text"), F.when(F.col("doc_id") % 3 == 0, wrong).otherwise(right)).alias("verified"))


def g18_team_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, active ones, keys, expired ones and audit entries, in one row."""
    keys = table(spark, sf_dir, "part").select((F.col("p_partkey") % 200 < 62).alias("expired"))
    return team.stats(team.members(table(spark, sf_dir, "supplier")), keys, a12_audit_entries(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    a12_audit_entries, j04_newest_entries, a07_report, b17_suppressed, g05_risk_totals, g06_scan_status, g12_memory, i05_memory_growth, l15_settings,
    l08_permissions, f08_key_ids, f08_grant_lookup, f09_reasons, n03_verify_key, g18_team_stats,
)}

ENTRIES = f"""a as ({AUDIT_LINES.format(V='varchar')}), s as (select string_split(value, ' | ') as x from a),
 e as (select case when regexp_matches(x[1], '^[+]?[0-9]+$') then coalesce(try_cast(x[1] as bigint), 0) else 0 end as timestamp, x[2] as operation, x[3] as actor, x[4] as details from s where len(x) = 4)"""
USAGE = LOG + ", u as (select event_id, service, ts, cast(trunc(duration_ms * 10000) as bigint) as usage from o)"
KEY = "string_split(pair, '=')[1]"
NUMBER = "case when regexp_matches(v, '^[+]?[0-9]{1,10}$') and cast(v as bigint) <= 4294967295 then cast(v as bigint) end"
SETTING_ERRORS = [("not has", "Invalid config format, expected key=value", True), ("has and not regexp_matches(k, '^[a-zA-Z0-9_.]+$')", "Configuration key contains invalid characters", True)]
for _key, _label, _low, _least, _high, _most in checks.LIMITS:
    SETTING_ERRORS += [(f"has and k = {q(_key)} and n is null", f"{_label} must be a valid number", True), (f"has and k = {q(_key)} and n < {_low}", _least, True)]
    if _high is not None:
        SETTING_ERRORS.append((f"has and k = {q(_key)} and n > {_high}", _most, False))
TOLD = "[" + ", ".join(f"case when {c} then {q(m)} end" for c, m, _ in SETTING_ERRORS) + ", case when has and k = 'parallelism' and n > 16 then 'Parallelism (' || n || ') higher than recommended (8)' end"
TOLD += f", case when has and k not in {any_of([x[0] for x in checks.LIMITS])} and strlen(v) > 1000 then 'Configuration value too long' end]"
MIB = 1024 * 1024

ORACLES = {
    "a12_audit_entries": f"with {ENTRIES} select * from e",
    "j04_newest_entries": f"with {ENTRIES} select * from e order by timestamp desc, operation, actor, details limit 100",
    "a07_report": SCORED + f""", z as (select *, {SEVERITIES} as severity from l),
      o as (select file_path, list({{'value': value, 'secret_type': secret_type, 'line_number': line_number, 'column_number': column_number, 'start_position': start_position, 'end_position': end_position, 'confidence': confidence, 'confidence_level': confidence_level, 'severity': severity}}
        order by start_position, end_position, secret_type, value, line_number, column_number, confidence) as findings, count(*) as total, count(*) filter (confidence >= 0.7) as high from z group by 1)
      select file_path, cast(to_json({{'file_path': file_path, 'options': {{'min_confidence': cast(0.3 as double), 'include_low_confidence': true}}, 'findings': findings, 'stats': {{'total': total, 'high_confidence': high}}}}) as varchar) as report from o""",
    "b17_suppressed": SCORED + ", g as (select distinct file_path, value from l where doc_id % 3 = 0) select doc_id, start_position, g.value is not null as is_ignored, g.value is null and confidence >= 0.3 as reportable from l left join g on g.file_path = l.file_path and g.value = l.value",
    "g05_risk_totals": SCORED + "select count(*) as total, count(*) filter (confidence >= 0.8) as high, count(*) filter (confidence >= 0.5 and confidence < 0.8) as medium, count(distinct file_path) as files from l",
    "g06_scan_status": SCORED + """, t as (select count(*) as total, count(*) filter (confidence >= 0.7) as high, count(*) filter (confidence >= 0.4 and confidence < 0.7) as medium from l)
      select *, case when total = 0 then 'Scan complete: No secrets detected' else 'Scan complete: ' || total || ' findings (' || high || ' high, ' || medium || ' medium confidence)' || case when high > 0 then ' | High confidence findings require attention!' else '' end end as message from t""",
    "g12_memory": USAGE + f""", x as (select service, max(ts) as z, min(ts) as a, max(usage) as peak, arg_max(usage, {{'t': ts, 'e': event_id}}) as now from u group by 1),
      y as (select u.service, avg(usage) as mean, count(*) as n, arg_min(usage, {{'t': ts, 'e': event_id}}) as first from u join x on x.service = u.service and u.ts > x.z - interval 7 days group by 1),
      w as (select x.*, y.mean, y.n, y.first, cast(floor((epoch_us(z) - epoch_us(a)) / 1000000) as bigint) as up from x join y using (service))
      select service, up as uptime_s, round(now / {MIB}, 6) as current_mb, round(peak / {MIB}, 6) as peak_mb, round(mean / {MIB}, 6) as average_mb,
       round(case when n > 1 and up > 0 then (now - first) / {MIB} / up else 0 end, 9) as growth_mb_per_s from w""",
    "i05_memory_growth": USAGE + " select service, event_id, usage - first_value(usage) over (partition by service order by ts range between interval 7 days preceding and current row) as growth from u",
    "l15_settings": f"""with s as ({SETTINGS.format(V='varchar')}), t as (select p_partkey, contains(pair, '=') as has, {KEY} as k, case when contains(pair, '=') then substr(pair, length({KEY}) + 2) else '' end as v from s),
      u as (select *, {NUMBER} as n from t)
      select p_partkey, not ({' or '.join(f'coalesce({c}, false)' for c, _, z in SETTING_ERRORS if z)}) as is_valid, array_to_string(list_filter({TOLD}, lambda x: x is not null), '; ') as messages from u""",
    "l08_permissions": "select p_partkey, case when p_size % 2 = 0 then 'd' else '-' end || " + " || ".join(f"case when (p_partkey % 512) & {1 << (8 - k)} > 0 then '{'rwx'[k % 3]}' else '-' end" for k in range(9)) + " as letters from part",
    "f08_key_ids": f"with m as ({MEMBERS}) select distinct member, l_partkey as key_id from m join lineitem on l_suppkey = member where active",
    "f08_grant_lookup": f"""with m as ({MEMBERS}), g as (select distinct l_partkey as key_id, l_suppkey as member from lineitem), a as (select distinct l_partkey as key_id, cast(l_linenumber as bigint) as member from lineitem)
      select a.key_id, a.member, case when m.member is null then 'no such member' when not active then 'member is not active' when g.member is null then 'no grant for the member' end as error
      from a left join m on m.member = a.member left join g on g.key_id = a.key_id and g.member = a.member""",
    "f09_reasons": f"with m as ({MEMBERS}), o as (select unnest({list(team.MATRIX['Owner'])}) as operation) select member, operation, active and ({MAY}) as allowed, case when not active then 'inactive' when {MAY} then 'role' else 'role lacks permission' end as reason from m, o",
    "n03_verify_key": "select doc_id, case when text is not null then doc_id % 3 > 0 end as verified from documents",
    "g18_team_stats": f"with {ENTRIES}, m as ({MEMBERS}) select (select count(*) from m) as members, (select count(*) from m where active) as active_members, (select count(*) from part) as keys, (select count(*) from part where p_partkey % 200 < 62) as expired_keys, (select count(*) from e) as audit_entries",
}
