"""As-of joins without range joins: the last row of a key at or before a time, however many rows the key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: Column, name: str, width_s: int = 86_400) -> DataFrame:
    """left with column `name`: `value` of the key's last row in `right` at or before left's `at`; null where there is none.

    Both tables have `key` and the timestamp `at`. A row of right at the same instant counts; of several at one instant
    the largest value does. Both sides are sorted together within `width_s` seconds of a key, so that a hot key is
    spread over tasks; of earlier spans each key's last value is carried over, one row for each span. Rows of left with a
    null key or time get null; values must not be null.
    """
    span = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (width_s * 1_000_000))
    left = left.withColumn("_span", span)
    some = right.select(F.col(key).alias("_key"), F.col(at).alias("_at"), value.alias("_value")).where("_key is not null and _at is not null and _value is not null")
    some = some.withColumn("_span", F.floor(F.unix_micros(F.col("_at").cast("timestamp")) / (width_s * 1_000_000)))
    # Within a span: rows of right come before those of left at the same instant.
    own = left.select(F.col(key).alias("_key"), F.col(at).alias("_at"), "_span", F.lit(1).alias("_side"), F.lit(None).cast(some.schema["_value"].dataType).alias("_value"), F.struct(*left.columns).alias("_row"))
    theirs = some.select("_key", "_at", "_span", F.lit(0).alias("_side"), "_value", F.lit(None).cast(own.schema["_row"].dataType).alias("_row"))
    order = Window.partitionBy("_key", "_span").orderBy("_at", "_side", F.col("_value").asc_nulls_last())
    met = own.unionByName(theirs).withColumn("_in", F.last("_value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    met = met.where("_side = 1")
    # Over spans: each one's last value, carried to the spans that have rows of left.
    ends = some.groupBy("_key", "_span").agg(F.max(F.struct("_at", "_value"))["_value"].alias("_end"))
    spans = left.select(F.col(key).alias("_key"), "_span").where("_key is not null").distinct().join(ends, ["_key", "_span"], "full")
    earlier = Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_key", "_span", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    out = met.join(spans, ["_key", "_span"], "left")
    return out.select("_row.*", F.coalesce("_in", "_carried").alias(name)).drop("_span")


def valid_tokens(uses: DataFrame, revocations: DataFrame, width_s: int = 86_400) -> DataFrame:
    """uses (token, member, issued_at, expires_at, at) with `revoked_at` and `valid`.

    A token is valid at its use where it hasn't expired (the instant of expiry is too late) and was issued after the
    member's last revocation at or before the use; one issued at the instant of the revocation is not valid.
    """
    found = as_of(uses, revocations, "member", "at", F.col("at"), "revoked_at", width_s)
    good = (F.col("at") < F.col("expires_at")) & (F.col("revoked_at").isNull() | (F.col("issued_at") > F.col("revoked_at")))
    return found.withColumn("valid", F.coalesce(good, F.lit(False)))
