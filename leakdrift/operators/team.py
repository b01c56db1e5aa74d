"""Members, key grants, objects and encrypted tables as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each role may do.
MATRIX = {
    "Owner": ["AddMember", "RemoveMember", "RotateKeys", "ViewKeys", "EncryptFile", "DecryptFile"],
    "Admin": ["AddMember", "RemoveMember", "RotateKeys", "ViewKeys", "EncryptFile", "DecryptFile"],
    "Member": ["ViewKeys", "EncryptFile", "DecryptFile"],
    "ReadOnly": ["ViewKeys", "DecryptFile"],
}
ROLES = list(MATRIX)


def members(supplier: DataFrame) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return supplier.select(F.col("s_suppkey").alias("member"), role.alias("role"), (F.col("s_acctbal") >= 0).alias("active"))


def allowed(people: DataFrame) -> DataFrame:
    """(member, operation, allowed, reason) for every operation; the matrix is a literal, no join."""
    may = F.create_map(*[x for r, ops in MATRIX.items() for x in (F.lit(r), F.array(*[F.lit(o) for o in ops]))])
    rows = people.select("*", F.explode(F.array(*[F.lit(o) for o in MATRIX["Owner"]])).alias("operation"))
    ok = F.col("active") & F.array_contains(may[F.col("role")], F.col("operation"))
    reason = F.when(~F.col("active"), "inactive").when(ok, "role").otherwise("role lacks permission")
    return rows.select("member", "operation", ok.alias("allowed"), reason.alias("reason"))


#: Rows of a table of grants that one task makes distinct.
PART_ROWS = 500_000


def grants(lineitem: DataFrame) -> DataFrame:
    """Which key (part) is granted to which member (supplier).

    Few rows repeat, so they are dealt out before they are made distinct, to more tasks the more rows there are: none
    holds more of a larger table. Asks for the number of rows, which files tell without being read.
    """
    rows = lineitem.select(F.col("l_partkey").alias("key_id"), F.col("l_suppkey").alias("member"))
    least = int(lineitem.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, lineitem.count() // PART_ROWS), "key_id", "member").distinct()


def keys_available(granted: DataFrame, people: DataFrame) -> DataFrame:
    """How many keys each active member holds, none included."""
    held = granted.groupBy("member").agg(F.count("*").alias("n"))
    return people.where("active").join(held, "member", "left").select("member", F.coalesce("n", F.lit(0)).alias("n_keys"))


def key_ids(granted: DataFrame, people: DataFrame) -> DataFrame:
    """(member, key_id): the keys that each active member has a grant for."""
    return granted.join(people.where("active").select("member"), "member", "left_semi").select("member", "key_id").distinct()


def grant_lookup(granted: DataFrame, people: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (key_id, member) with `error`: null where the member is active and has a grant for the key."""
    rows = asked.join(people.select("member", "active"), "member", "left")
    rows = rows.join(granted.select("key_id", "member").distinct().withColumn("_g", F.lit(True)), ["key_id", "member"], "left")
    error = F.when(F.col("active").isNull(), "no such member").when(~F.col("active"), "member is not active").when(F.col("_g").isNull(), "no grant for the member")
    return rows.select(*asked.columns, error.alias("error"))


def stats(people: DataFrame, keys: DataFrame, entries: DataFrame) -> DataFrame:
    """One row of counts over members (active), keys (expired) and audit entries."""
    counts = [
        people.agg(F.count("*").alias("members"), F.count_if("active").alias("active_members")),
        keys.agg(F.count("*").alias("keys"), F.count_if("expired").alias("expired_keys")), entries.agg(F.count("*").alias("audit_entries")),
    ]
    # Each is one row.
    return counts[0].crossJoin(F.broadcast(counts[1])).crossJoin(F.broadcast(counts[2]))


def verified(sealed: Column, key: Column) -> Column:
    """Whether the key opens a sealed value; null for null."""
    return F.when(sealed.isNotNull(), F.try_aes_decrypt(sealed, key, F.lit("GCM")).isNotNull())


def encrypted(rows: DataFrame, key: Column, column: str = "text") -> DataFrame:
    """rows with `column` sealed by AES-GCM under a fresh vector for each row; nulls stay null."""
    return rows.withColumn(column, F.aes_encrypt(F.col(column), key, F.lit("GCM")))


def decrypted(rows: DataFrame, key: Column, column: str = "text") -> DataFrame:
    """rows with `column` opened, and `error` where a value cannot be opened with the key (it is null then)."""
    clear = F.try_aes_decrypt(F.col(column), key, F.lit("GCM"))
    failed = F.col(column).isNotNull() & clear.isNull()
    return rows.withColumn("error", F.when(failed, "authentication failed")).withColumn(column, clear.cast("string"))


def chunks(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, payload) to (doc_id, chunk_no, chunk); an empty payload is one empty chunk, a null one has none."""
    n = F.greatest(F.ceil(F.octet_length("payload") / size), F.lit(1))
    rows = rows.where("payload is not null").select("doc_id", "payload", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk_no"))
    return rows.select("doc_id", "chunk_no", F.substr("payload", (F.col("chunk_no") * size + 1).cast("int"), F.lit(size)).alias("chunk"))


def reassembled(parts: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, chunk) to (doc_id, payload): the chunks in their order, put together in one step."""
    found = F.array_sort(F.collect_list(F.struct("chunk_no", "chunk")))
    whole = F.unhex(F.array_join(F.transform(F.col("x"), lambda p: F.hex(p["chunk"])), ""))
    return parts.groupBy("doc_id").agg(found.alias("x")).select("doc_id", whole.alias("payload"))
