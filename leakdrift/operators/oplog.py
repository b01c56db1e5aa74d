"""The operations log: metrics by operation, trailing rates, alerts, health, breaker runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metrics(log: DataFrame) -> DataFrame:
    """By operation: count, errors, total, least, largest and mean duration, last time, whole-second throughput."""
    ms = F.col("duration_ms")
    rows = log.groupBy("op_type").agg(
        F.count("*").alias("n"), F.count_if(~F.col("success")).alias("errors"), F.sum(ms.cast("decimal(28,6)")).alias("total"),
        F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.max("ts").alias("last_ts"),
    )
    seconds = F.floor(F.col("total") / 1000)
    return rows.select(
        "op_type", "n", "errors", F.col("total").cast("double").alias("total_ms"), "min_ms", "max_ms", "last_ts",
        F.floor(F.col("total") / F.col("n")).cast("bigint").alias("avg_ms"), F.round(F.col("errors") / F.col("n"), 9).alias("error_rate"),
        F.round(F.when(seconds >= 1, F.col("n") / seconds.cast("double")).otherwise(0.0), 6).alias("throughput"),
    )


#: Seconds of a service's log that one task sorts: a hot service is spread over as many tasks as it has such spans.
SPAN = 86_400


def span_of(at: Column, width_s: int) -> Column:
    return F.floor(at / (width_s * 1_000_000))


def trailing_rate(log: DataFrame, seconds: int = 600, width_s: int = SPAN) -> DataFrame:
    """At each operation, the service's operations per minute over the last `seconds`, this one included.

    A span of a service has its own rows and those that its first ones look back to.
    """
    at, back = F.unix_micros(F.col("ts").cast("timestamp")), seconds * 1_000_000
    rows = log.select("event_id", "service", at.alias("_at")).withColumn("_own", span_of(F.col("_at"), width_s))
    rows = rows.withColumn("_span", F.explode_outer(F.sequence(F.col("_own"), span_of(F.col("_at") + back, width_s))))
    last = Window.partitionBy("service", "_span").orderBy("_at").rangeBetween(-back, 0)
    rows = rows.withColumn("_n", F.count("*").over(last)).where(F.col("_own").eqNullSafe(F.col("_span")))
    return rows.select("event_id", "service", F.round(F.col("_n") / (seconds / 60), 6).alias("per_minute"))


def with_row_before(rows: DataFrame, columns: list[str], name: str, width_s: int = SPAN) -> DataFrame:
    """rows (service, ts, event_id, more) with a struct of the columns of the service's row before; null for its first.

    Rows are sorted within spans; each span's first row gets the last of the spans before, of which there is one row each.
    """
    span = span_of(F.unix_micros(F.col("ts").cast("timestamp")), width_s)
    rows = rows.withColumn("_span", span)
    own = F.lag(F.struct(*columns)).over(Window.partitionBy("service", "_span").orderBy("ts", "event_id"))
    ends = rows.groupBy("service", "_span").agg(F.max_by(F.struct(*columns), F.struct("ts", "event_id")).alias("_end"))
    ends = ends.select(F.col("service").alias("_s"), F.col("_span").alias("_p"), F.lag("_end").over(Window.partitionBy("service").orderBy("_span")).alias("_carried"))
    out = rows.withColumn("_lag", own).join(ends, F.col("service").eqNullSafe(F.col("_s")) & F.col("_span").eqNullSafe(F.col("_p")), "left")
    return out.withColumn(name, F.coalesce("_lag", "_carried")).drop("_span", "_lag", "_carried", "_s", "_p")


def alerts(log: DataFrame, slow_ms: float = 1000, critical_ms: float = 5000) -> DataFrame:
    """One row for slow operations and one for a low rate over the last minute of the log, where they hold."""
    slow = log.where(F.col("duration_ms") > slow_ms).agg(F.count("*").alias("n"), F.sum(F.col("duration_ms").cast("decimal(28,6)")).alias("s")).where("n > 0")
    mean = (F.col("s") / F.col("n")).cast("double")
    slow = slow.select(F.lit("slow_operations").alias("alert"), "n", F.round(mean, 6).alias("value"), F.when(mean > critical_ms, "Critical").otherwise("Warning").alias("severity"))
    end = log.agg(F.max("ts").alias("end"))
    recent = log.join(F.broadcast(end), F.col("ts") > F.col("end") - F.expr("interval 60 seconds"))  # one row is broadcast
    rate = recent.agg(F.count("*").alias("n")).where("n > 0 and n < 600")
    return slow.unionByName(rate.select(F.lit("low_throughput").alias("alert"), "n", F.round(F.col("n") / 60, 6).alias("value"), F.lit("Warning").alias("severity")))


def health(found: DataFrame) -> DataFrame:
    worst = F.coalesce(F.max(F.when(F.col("severity") == "Critical", 2).otherwise(1)), F.lit(0))
    return found.agg(worst.alias("w")).select(F.when(F.col("w") == 2, "Critical").when(F.col("w") == 1, "Degraded").otherwise("Healthy").alias("status"))


def failures_in_a_row(log: DataFrame, width_s: int = SPAN) -> DataFrame:
    """Each failure of a service with `attempt`, its number in the run of failures without a success between, and `run`,
    the (ts, event_id) of the run's first.

    Runs are counted within spans. A span says how many failures it ends with and where these began; what a span without
    a success before goes on from is the sum over the spans since the last one that had a success.
    """
    log = log.withColumn("_span", span_of(F.unix_micros(F.col("ts").cast("timestamp")), width_s))
    turn = Window.partitionBy("service", "_span").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("_island", F.sum(F.col("success").cast("int")).over(turn))
    own = Window.partitionBy("service", "_span", "_island").orderBy("ts", "event_id")
    at = F.struct("ts", "event_id")
    failed = rows.where("not success").withColumn("_k", F.row_number().over(own)).withColumn("_first", F.first(at).over(own))
    islands = rows.groupBy("service", "_span", "_island").agg(F.count_if(~F.col("success")).alias("_n"), F.min(F.when(~F.col("success"), at)).alias("_from"))
    # The last island of a span is what follows its last success, or all of it where it has none.
    tails = islands.groupBy("service", "_span").agg(F.max("_island").alias("_any"), F.max_by(F.struct("_n", "_from"), "_island").alias("_t"))
    spans = Window.partitionBy("service").orderBy("_span")
    tails = tails.withColumn("_chain", F.sum((F.col("_any") > 0).cast("int")).over(spans))
    chain = Window.partitionBy("service", "_chain").orderBy("_span").rowsBetween(Window.unboundedPreceding, 0)
    tails = tails.withColumn("_sum", F.sum("_t._n").over(chain)).withColumn("_start", F.min("_t._from").over(chain))
    tails = tails.select(F.col("service").alias("_s"), F.col("_span").alias("_p"), F.lag("_sum").over(spans).alias("_sum"), F.lag("_start").over(spans).alias("_start"))
    failed = failed.join(tails, F.col("service").eqNullSafe(F.col("_s")) & F.col("_span").eqNullSafe(F.col("_p")), "left")
    goes_on = F.col("_island") == 0
    attempt = F.col("_k") + F.when(goes_on, F.coalesce("_sum", F.lit(0))).otherwise(0)
    run = F.when(goes_on, F.coalesce("_start", "_first")).otherwise(F.col("_first"))
    return failed.withColumn("attempt", attempt.cast("int")).withColumn("run", run).select(*[c for c in log.columns if c != "_span"], "attempt", "run")


def failure_runs(log: DataFrame, threshold: int = 3, width_s: int = SPAN) -> DataFrame:
    """Runs of at least `threshold` failures of a service without a success between: service, first and last time, length."""
    runs = failures_in_a_row(log, width_s).groupBy("service", "run").agg(F.min("ts").alias("opened"), F.max("ts").alias("last_ts"), F.count("*").alias("failures"))
    return runs.where(F.col("failures") >= threshold).drop("run")


def durations(log: DataFrame) -> DataFrame:
    """By service: mean, slowest and fastest operation (the latest of the slowest, the earliest of the fastest)."""
    key = F.struct("duration_ms", "event_id")
    return log.groupBy("service").agg(
        F.round((F.sum(F.col("duration_ms").cast("decimal(28,6)")) / F.count("*")).cast("double"), 4).alias("avg_ms"),
        F.max(key)["event_id"].alias("slowest"), F.min(key)["event_id"].alias("fastest"),
    )


def byte_totals(log: DataFrame) -> DataFrame:
    """Bytes of successful encryptions and decryptions, and successful operations: one row, zeros for an empty log."""
    good = F.col("success")
    size = lambda op: F.coalesce(F.sum(F.when(good & (F.col("op_type") == op), F.col("size_bytes"))), F.lit(0)).cast("bigint")
    return log.agg(size("Encrypt").alias("bytes_encrypted"), size("Decrypt").alias("bytes_decrypted"), F.count_if(good).alias("n_good"))


def throughput_map(found: DataFrame, prefix: str = "crypto_") -> DataFrame:
    """Rows of metrics() to one row with a map of operations to operations a second, of a second in all or more."""
    some = found.where(F.floor(F.col("total_ms") / 1000) >= 1)
    pair = F.struct(F.concat(F.lit(prefix), "op_type").alias("key"), "throughput")
    return some.agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("throughput"))


def paired(log: DataFrame, start: str = "Read", end: str = "Write") -> DataFrame:
    """Each end with the start that is open for its service: event_id of both and the microseconds between.

    A start that follows an open one replaces it, an end closes it, and an end without an open one is ignored; so an
    end has a pair where the service's start or end before it is a start. Ties of time are in the order of event_id.
    """
    rows = log.where(F.col("op_type").isin(start, end))
    rows = with_row_before(rows, ["op_type", "event_id", "ts"], "_before")
    rows = rows.where((F.col("op_type") == end) & (F.col("_before.op_type") == start))
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_before.ts").cast("timestamp"))
    return rows.select("service", F.col("_before.event_id").alias("start_id"), F.col("event_id").alias("end_id"), us.alias("micros"))


def component_health(log: DataFrame, slow_ms: float = 1000) -> DataFrame:
    """By service the status after its last operation, and the worst of all operations as `overall`.

    A failure is critical, a slow success degrades, any other is healthy. Last is by (ts, event_id), from a grouped
    maximum; an empty log has no rows.
    """
    level = F.when(~F.col("success"), 2).when(F.col("duration_ms") > slow_ms, 1).otherwise(0)
    name = lambda c: F.element_at(F.array(*map(F.lit, ["Healthy", "Degraded", "Critical"])), c + 1)
    rows = log.withColumn("_level", level).groupBy("service").agg(
        F.max_by("_level", F.struct("ts", "event_id")).alias("last"), F.max("_level").alias("worst"), F.count_if(F.col("_level") > 0).alias("issues")
    )
    worst = rows.agg(F.max("worst").alias("all_worst"))
    rows = rows.crossJoin(F.broadcast(worst))  # one row is broadcast
    return rows.select("service", name(F.col("last")).alias("status"), "issues", name(F.col("all_worst")).alias("overall"))


def retry_audit(log: DataFrame, base_ms: int = 100, most_ms: int = 10_000, width_s: int = SPAN) -> DataFrame:
    """Each repeated failure of a service without a success between: its attempt number, the wait that exponential
    backoff asks for before it (doubled from base_ms, most_ms at most), the wait there was, and whether that was too short.
    """
    # The row before one of a run that isn't its first is of the run.
    rows = with_row_before(log.select("service", "event_id", "ts", "success"), ["ts"], "_before", width_s)
    rows = failures_in_a_row(rows, width_s)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = rows.withColumn("waited", micros("ts") - micros("_before.ts"))
    asked = F.least(F.lit(base_ms) * F.pow(F.lit(2.0), F.col("attempt") - 2), F.lit(float(most_ms)))
    rows = rows.where("attempt > 1").withColumn("asked_ms", asked.cast("long"))
    return rows.select("service", "event_id", "attempt", "asked_ms", F.col("waited").alias("waited_us"), (F.col("waited") < F.col("asked_ms") * 1000).alias("too_early"))


MIB = 1024 * 1024


def memory_stats(usage: DataFrame, seconds: int = 3600) -> DataFrame:
    """usage (service, ts, usage, event_id) to a row for each service: current, peak, mean and growth, in MiB.

    Current is the last row's, peak that of all rows; mean and growth are of the last `seconds`, growth a second since
    the service's first row. One row of a service, or rows of one instant, have no growth. Ties go by event_id.
    """
    last = usage.groupBy("service").agg(F.max("ts").alias("_end"), F.min("ts").alias("_begin"), F.max("usage").alias("_peak"), F.max_by("usage", F.struct("ts", "event_id")).alias("_now"))
    kept = usage.join(last.select("service", "_end"), "service").where(F.col("ts") > F.col("_end") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))
    kept = kept.groupBy("service").agg(F.avg("usage").alias("_mean"), F.count("*").alias("_n"), F.min_by("usage", F.struct("ts", "event_id")).alias("_first"))
    up = (F.unix_micros(F.col("_end").cast("timestamp")) - F.unix_micros(F.col("_begin").cast("timestamp"))) / 1e6
    growth = F.when((F.col("_n") > 1) & (F.floor(up) > 0), (F.col("_now") - F.col("_first")) / MIB / F.floor(up)).otherwise(0.0)
    rows = last.join(kept, "service")
    return rows.select("service", (F.col("_now") / MIB).alias("current_mb"), (F.col("_peak") / MIB).alias("peak_mb"), (F.col("_mean") / MIB).alias("average_mb"), growth.alias("growth_mb_per_s"), F.floor(up).alias("uptime_s"))


def growth(usage: DataFrame, seconds: int = 3600, width_s: int = 3600) -> DataFrame:
    """At each row, how much more is used than at the service's first row of the last `seconds`; windows are spread over
    spans of `width_s`, each with the rows that it looks back to, so that a hot service is in many tasks.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    width, back = width_s * 1_000_000, seconds * 1_000_000
    rows = usage.select("service", "event_id", "usage", at.alias("_at")).withColumn("_own", F.floor(F.col("_at") / width))
    spans = F.sequence(F.col("_own"), F.floor((F.col("_at") + back) / width))
    rows = rows.withColumn("_span", F.explode(spans))
    order = Window.partitionBy("service", "_span").orderBy("_at").rangeBetween(-back, 0)
    first = F.min(F.struct("_at", "event_id", "usage")).over(order)["usage"]
    return rows.withColumn("_first", first).where("_own = _span").select("service", "event_id", (F.col("usage") - F.col("_first")).alias("growth"))
