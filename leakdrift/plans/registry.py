"""Every registered query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakdrift.functions import text as T
from leakdrift.functions import checks
from leakdrift.functions import windows as W
from leakdrift.operators import oplog, rules, scan, team
from leakdrift.plans import inventory, policy, records, state
from leakdrift.plans.oracles import ORACLES as SQL
from leakdrift.plans.oracles import ENTROPY_RULE, RULES
from leakdrift.sources.corpus import corpus, op_log, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


def pattern_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the library, scored."""
    rows = scan.scored(scan.pattern_matches(corpus(spark, sf_dir)))
    return rows.withColumn("stage", F.lit(0)).withColumnRenamed("name", "detector_name")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.first_of_span(pattern_findings(spark, sf_dir))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ", -1)).alias("value"))
    return rows.where(F.length("value") >= 8).distinct()


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All different strings between spaces, short and empty ones too."""
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ", -1)).alias("value")).distinct()


@query("c02_find_all_matches")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.pattern_matches(corpus(spark, sf_dir)).select("doc_id", "seq", "value", "start_position", "end_position", "line_number", "column_number")


@query("c04_pattern_context")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.pattern_matches(corpus(spark, sf_dir))
    sure = T.pattern_adjusted(F.col("name"), F.col("base_confidence"), F.col("value"), F.col("context"))
    return rows.select("doc_id", "seq", "start_position", T.rounded(sure).alias("confidence"))


@query("c05_hook_scan")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.hook_lines(corpus(spark, sf_dir)).select("doc_id", "line_number", "name", "value", "col_bytes")


@query("c06_content_warnings")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.content_warnings(corpus(spark, sf_dir)).select("doc_id", "file_path", "warnings")


@query("c19_composite_confidence")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_findings(spark, sf_dir).select("doc_id", "seq", "start_position", "confidence", F.round("entropy_score", 6).alias("entropy_score"))


@query("c25_scan_content")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan_content(corpus(spark, sf_dir))
    return found.select("doc_id", "file_path", "value", "secret_type", "start_position", "end_position", "line_number", "column_number", "stage", "confidence", "confidence_level", "severity")


@query("c26_post_process")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.post_process(scan.scan_content(corpus(spark, sf_dir)), most=100).select("doc_id", "value", "secret_type", "confidence")


@query("i01_span_dedup")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("doc_id", "start_position", "end_position", "detector_name", "secret_type", "confidence_level")


@query("g01_by_level")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("confidence_level").agg(F.count("*").alias("n"))


@query("g02_by_type")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("secret_type").agg(F.count("*").alias("n"))


@query("g03_summary")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    return findings(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(c >= 0.7).alias("high"), F.count_if(c >= 0.3).alias("reportable"), F.count_distinct("file_path").alias("files"))


@query("g05_risk")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    return findings(spark, sf_dir).groupBy("file_path").agg(F.count("*").alias("n"), F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"))


@query("b11_critical")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("secret_type")
    return findings(spark, sf_dir).where((F.col("confidence") >= 0.9) | kind.contains("AWS") | kind.contains("Private Key")).select("doc_id", "start_position", "detector_name")


@query("b01_skip_classifier")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", "file_path", T.skip_reason(F.col("file_path"), F.octet_length("content")).alias("skip_reason"))


@query("g04_scan_totals")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.coalesce(T.skip_reason(F.col("file_path"), F.octet_length("content")), F.lit("scanned"))
    return corpus(spark, sf_dir).groupBy(reason.alias("outcome")).agg(F.count("*").alias("n"))


@query("d02_entropy")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return tokens(spark, sf_dir).select("value", F.round(T.entropy(v), 6).alias("shannon"), T.charset_size(v).alias("charset"), T.class_count(v).alias("classes"))


@query("c12_false_positives")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select("value", T.false_positive(F.col("value")).alias("false_positive"))


@query("g07_op_metrics")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.metrics(op_log(spark, sf_dir)).select("op_type", "n", "errors", "min_ms", "max_ms", "avg_ms", "error_rate", "throughput")


@query("g11_durations")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.durations(op_log(spark, sf_dir))


@query("i04_trailing_rate")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.trailing_rate(op_log(spark, sf_dir))


@query("g13_alerts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.alerts(op_log(spark, sf_dir))


@query("g14_health")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.health(oplog.alerts(op_log(spark, sf_dir)))


@query("i06_failure_runs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.failure_runs(op_log(spark, sf_dir), threshold=2)


@query("f08_keys_available")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team.keys_available(team.grants(table(spark, sf_dir, "lineitem")), team.members(table(spark, sf_dir, "supplier")))


@query("f09_permissions")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team.allowed(team.members(table(spark, sf_dir, "supplier"))).drop("reason")


@query("n02_decrypt_batch")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lit("0123456789abcdef")  # a caller's key; this one is for the round trip only
    return team.decrypted(team.encrypted(table(spark, sf_dir, "documents").select("doc_id", "text"), key), key)


@query("n03_verify_wrong_key")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed = team.encrypted(table(spark, sf_dir, "documents").select("doc_id", "text"), F.lit("0123456789abcdef"))
    return team.decrypted(sealed, F.lit("fedcba9876543210")).select("doc_id", F.col("error").isNull().alias("verified"))


@query("n07_chunks")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = team.chunks(table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("payload")), 1024)
    return parts.select("doc_id", "chunk_no", F.sha2("chunk", 256).alias("digest"))


@query("n08_integrity")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks against the checksums of a manifest: every 7th document's first chunk has lost its last byte on the way."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    parts = team.chunks(docs.select("doc_id", F.col("text").cast("binary").alias("payload")), 4096)
    chunk = F.expr("substring(chunk, 1, greatest(octet_length(chunk) - 1, 0))")
    parts = parts.withColumn("chunk", F.when((F.col("doc_id") % 7 == 0) & (F.col("chunk_no") == 0), chunk).otherwise(F.col("chunk")))
    manifest = docs.select("doc_id", F.sha2("text", 256).alias("checksum"))
    return team.reassembled(parts).join(manifest, "doc_id").select("doc_id", (F.sha2("payload", 256) == F.col("checksum")).alias("intact"))


@query("e08_rules")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.execute(corpus(spark, sf_dir), RULES)
    return found.select("doc_id", "rule_id", "match_type", "text", F.col("start").alias("start_position"), F.col("end").alias("end_position"), "confidence")


@query("e02_entropy_rule")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entropy rule on all texts: the places of windows that are likely secrets."""
    found = rules.execute(corpus(spark, sf_dir), [ENTROPY_RULE])
    return found.select("doc_id", "text", F.col("start").alias("start_position"), F.col("end").alias("end_position"), T.rounded(F.col("confidence")).alias("confidence"))


@query("d05_analyse")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens(spark, sf_dir).select("value", T.analyse(F.col("value")).alias("e"))
    return rows.select("value", *[F.round(f"e.{k}", 6).alias(k) for k in ("shannon", "normalized")], "e.charset", "e.likely", T.rounded(F.col("e.confidence")).alias("confidence"))


@query("d15_line_entropy")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "value"))
    rows = rows.where(F.octet_length("value") >= 20).withColumn("h", W.many_entropies(F.col("value")))
    return rows.where(F.round("h", 9) > 4.0).select("doc_id", "line_no")


@query("b16_validity")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("doc_id", "start_position", "detector_name", scan.is_valid_finding().alias("is_valid"))


@query("a08_csv_report")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.csv_rows(findings(spark, sf_dir))


@query("c27_summary")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("doc_id", "start_position", scan.summary().alias("summary"))


@query("l13_password_checks")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, sf_dir).select("value", checks.password_errors(F.col("value")).alias("found"))
    return rows.select("value", checks.is_valid(F.col("found")).alias("is_valid"), F.array_join(F.transform("found", lambda e: e["message"]), "; ").alias("messages"))


@query("l14_path_checks")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of each document, taken for a path."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "path"))
    rows = rows.select("doc_id", "line_no", checks.path_errors(F.col("path")).alias("found"))
    return rows.select("doc_id", "line_no", checks.is_valid(F.col("found")).alias("is_valid"), F.array_join(F.transform("found", lambda e: e["message"]), "; ").alias("messages"))


@query("g19_validation_rollup")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.rollup(values(spark, sf_dir).select(checks.password_errors(F.col("value")).alias("found")), "found")


@query("l02_encrypted_paths")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    rows = corpus(spark, sf_dir).select("doc_id", checks.encrypted_path(path).alias("encrypted"), checks.flat_path(path).alias("flat"), "file_path")
    return rows.withColumn("decrypted", checks.decrypted_path(F.col("encrypted"))).drop("file_path")


@query("g09_byte_totals")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.byte_totals(op_log(spark, sf_dir))


@query("g16_storage")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").groupBy("lang").agg(F.count("*").alias("objects"), F.sum(F.octet_length("text")).alias("bytes"))


@query("g17_duplicate_objects")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("checksum"), F.octet_length("text").alias("n"))
    found = rows.groupBy("checksum").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), (F.sum("n") - F.min("n")).alias("wasted"))
    return found.where("copies > 1")


@query("l06_human_size")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.human_size(F.octet_length("text")).alias("size"))


@query("g10_throughput")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the throughput map as rows."""
    found = oplog.throughput_map(oplog.metrics(op_log(spark, sf_dir)))
    return found.select(F.explode("throughput").alias("name", "per_second"))


@query("f12_pairs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.paired(op_log(spark, sf_dir))


@query("g15_component_health")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.component_health(op_log(spark, sf_dir))


@query("i07_retries")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.retry_audit(op_log(spark, sf_dir))


@query("l07_minutes")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("modified"))


@query("l10_encodings")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in hex and base64, as digests, and whether both give the text back."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.lower(F.hex("text")).alias("h"), T.base64_of(F.col("text")).alias("b"))
    back = (F.unhex("h").cast("string") == F.col("text")) & (F.unbase64("b").cast("string") == F.col("text"))
    return rows.select("doc_id", F.md5("h").alias("hex_md5"), F.md5("b").alias("base64_md5"), back.alias("round_trip"))


ORACLES: dict[str, str] = dict(SQL)
for part in (policy, state, records, inventory):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
