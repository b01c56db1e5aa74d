"""Stored objects and their metadata, and keys that are granted to members."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes from which an object is no longer small, and from which it is large.
SMALL, LARGE = 1024, 16_384


def size_bucket(size: Column) -> Column:
    return F.when(size < SMALL, "small").when(size < LARGE, "medium").when(size.isNotNull(), "large")


def reconciled(objects: DataFrame, metadata: DataFrame) -> DataFrame:
    """objects (path, size, checksum) beside metadata (path, size, checksum), whose paths end with .metadata.

    (path, status, size, bucket): matched, size differs, checksum differs, no metadata, or no object. Rows of a path
    that comes twice are held against each other's all; null paths match nothing.
    """
    theirs = metadata.select(F.regexp_replace("path", r"\.metadata$", "").alias("path"), F.col("size").alias("_size"), F.col("checksum").alias("_sum"), F.lit(True).alias("_m"))
    rows = objects.select("path", "size", "checksum", F.lit(True).alias("_o")).join(theirs, "path", "full")
    status = (
        F.when(F.col("_m").isNull(), "no metadata").when(F.col("_o").isNull(), "no object").when(~F.col("size").eqNullSafe(F.col("_size")), "size differs")
        .when(~F.col("checksum").eqNullSafe(F.col("_sum")), "checksum differs").otherwise("matched")
    )
    size = F.coalesce("size", "_size")
    return rows.select("path", status.alias("status"), size.alias("size"), size_bucket(size).alias("bucket"))


def optimisation(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """(issue, n, bytes): orphans of both sides, small objects, and what duplicates by checksum take beyond the first."""
    part = lambda where, name: rows.where(where).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).select(F.lit(name).alias("issue"), "n", "bytes")
    copies = objects.where("checksum is not null").groupBy("checksum").agg(F.count("*").alias("k"), F.sum("size").alias("s"), F.min("size").alias("one"))
    copies = copies.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("s") - F.col("one")), F.lit(0)).alias("bytes"))
    out = part("status = 'no metadata'", "objects without metadata").unionByName(part("status = 'no object'", "metadata without object"))
    return out.unionByName(part("bucket = 'small' and status <> 'no object'", "small objects")).unionByName(copies.select(F.lit("duplicates").alias("issue"), "n", "bytes"))


#: A blob is an expression of key_id and member, or a function that makes it of a member's column.
Blob = Column | Callable[[Column], Column]


def of_member(blob: Blob, member: Column) -> Column:
    return blob(member) if callable(blob) else blob


def dealt(keys: DataFrame) -> DataFrame:
    """Keys in as many parts as a shuffle makes: a file of them is small, what is done for each of them isn't."""
    return keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys.columns)


def expiry(created_at: Column, days: int = 90) -> Column:
    return created_at + F.make_dt_interval(F.lit(days))


def issued(keys: DataFrame, people: DataFrame, blob: Blob, days: int = 90) -> DataFrame:
    """keys (team, key_id, created_at) with `grants`, a map from each of the team's active members to `blob`, and `expires_at`.

    With a function for `blob` grants are made inside their keys' rows, from the teams' members, which are sent to every
    task (8 bytes a member or so); nothing is shuffled but the keys. An expression takes a row for each grant, which
    suits small teams (20 members at most, where the limit holds).
    """
    active = people.where("active and member is not null").select("team", "member").distinct()
    expires = expiry(F.col("created_at"), days)
    if not callable(blob):
        rows = keys.join(active, "team", "left").withColumn("_g", F.when(F.col("member").isNotNull(), F.struct(F.col("member").alias("key"), blob.alias("value"))))
        rows = rows.groupBy(*keys.columns).agg(F.array_sort(F.collect_list("_g")).alias("_g"))
        return rows.withColumn("grants", F.map_from_entries("_g")).drop("_g").withColumn("expires_at", expires)
    teams = active.groupBy("team").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("member", F.lit(True))))).alias("_m"))
    rows = dealt(keys).join(F.broadcast(teams), "team", "left")
    none = F.create_map().cast(teams.schema["_m"].dataType)
    grants = F.transform_values(F.coalesce("_m", none), lambda member, _: blob(member))
    return rows.select(*keys.columns, grants.alias("grants"), expires.alias("expires_at"))


def granted_to(keys: DataFrame, members: DataFrame, blob: Blob) -> DataFrame:
    """keys with a grant for each of `members` (team, member, one a team); a grant that is there stays as it is.

    Members, of whom there are no more than teams, are sent to every task; keys and their grants stay where they are.
    """
    rows = keys.join(F.broadcast(members.select("team", "member")), "team", "left")
    more = F.when(F.col("member").isNotNull() & ~F.map_contains_key("grants", F.col("member")), F.map_concat("grants", F.create_map(F.col("member"), of_member(blob, F.col("member")))))
    return rows.withColumn("grants", F.coalesce(more, F.col("grants"))).drop("member")


def without_members(keys: DataFrame, gone: DataFrame) -> DataFrame:
    """keys without the grants of the members in `gone` (team, member), and `removed`, how many grants went.

    Those who go are sent to every task; keys and their grants stay where they are.
    """
    left = gone.groupBy("team").agg(F.collect_set("member").alias("_gone"))
    rows = keys.join(F.broadcast(left), "team", "left").withColumn("_n", F.size("grants"))
    kept = F.map_filter("grants", lambda k, _: ~F.coalesce(F.array_contains("_gone", k), F.lit(False)))
    return rows.withColumn("grants", kept).withColumn("removed", F.col("_n") - F.size("grants")).drop("_gone", "_n")


def live_and_archived(keys: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Keys that haven't expired, and those that have; the instant of expiry is too late. Keys without one never expire."""
    over = F.coalesce(now >= F.col("expires_at"), F.lit(False))
    return keys.where(~over), keys.where(over)


def rotated(records: DataFrame, ring: DataFrame, column: str = "content") -> DataFrame:
    """records (key_id, column, more) sealed by the old key of their key_id, sealed anew by the new one.

    `ring` has (key_id, old_key, new_key, new_id), one row for each key. What the old key doesn't open stays as it is
    under the old id, with an error; records without a key in the ring stay, too.
    """
    rows = records.join(ring, "key_id", "left")
    clear = F.try_aes_decrypt(F.col(column), F.col("old_key"), F.lit("GCM"))
    rows = rows.withColumn("_clear", clear)
    good = F.col("_clear").isNotNull()
    error = F.when(F.col("old_key").isNull(), "no such key").when(F.col(column).isNotNull() & ~good, "authentication failed")
    sealed = F.when(good, F.aes_encrypt("_clear", "new_key", F.lit("GCM"))).otherwise(F.col(column))
    moved = F.when(F.col("old_key").isNotNull() & (good | F.col(column).isNull()), F.col("new_id")).otherwise(F.col("key_id"))
    return rows.withColumn("error", error).withColumn("key_id", moved).withColumn(column, sealed).drop("_clear", "old_key", "new_key", "new_id")


def xor_bytes(value: Column, by: int) -> Column:
    """Each byte of a binary value combined with one number."""
    digits = F.hex(value)
    byte = lambda i: F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(by))
    places = F.sequence(F.lit(0), F.octet_length(value) - 1)
    return F.unhex(F.array_join(F.transform(places, lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC with SHA-256 in hex, of binary columns; null where either is."""
    short = F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)
    padded = F.unhex(F.rpad(F.hex(short), 128, "0"))
    inner = F.unhex(F.sha2(F.concat(xor_bytes(padded, 0x36), message), 256))
    return F.sha2(F.concat(xor_bytes(padded, 0x5C), inner), 256)
