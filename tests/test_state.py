"""Breakers, as-of joins, snapshots, grants and rotation against brute force; the streams against the batch operators."""

import datetime as dt
import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from leakdrift.operators import asof, breaker, objects, oplog, snapshots
from leakdrift.plans import state as queries
from leakdrift.sources.corpus import op_log
from leakdrift.streaming import stateful

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)
LOG = "event_id long, service long, ts timestamp, op_type string, success boolean, duration_ms double"


def log_rows(seed, n, services=3, gap=300):
    rng = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        at += rng.choice([0, 1, gap // 10, gap, gap * 5])
        rows.append((i, rng.randrange(services), T0 + dt.timedelta(seconds=at), rng.choice(["Read", "Write", "Encrypt"]), rng.random() < 0.45, rng.random() * 9000))
    return rows


def plain_breaker(rows, threshold, timeout_s):
    out, state = [], {}
    for i, s, ts, _, ok, _ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        n, last = state.get(s, (0, None))
        is_open = n >= threshold
        if is_open and (ts - last).total_seconds() <= timeout_s:
            out.append((i, s, "Open", "rejected", "Open"))
            continue
        met = "HalfOpen" if is_open else "Closed"
        n, last = (0, last) if ok else (n + 1, ts)
        state[s] = (n, last)
        now = "Open" if n >= threshold else "Closed"
        out.append((i, s, met, "ok" if ok else "opened" if now == "Open" else "failed", now))
    return sorted(out)


@pytest.mark.parametrize(("threshold", "timeout", "chunk"), [(2, 400, 3600), (1, 299, 60), (3, 5000, 100_000), (2, 0, 1)])
def test_breaker_states(spark, threshold, timeout, chunk):
    rows = log_rows(threshold, 700)
    log = spark.createDataFrame(rows, LOG).repartition(5)
    got = sorted(tuple(r) for r in breaker.breaker_states(log, threshold, timeout * 1000, chunk).collect())
    assert got == plain_breaker(rows, threshold, timeout)
    assert breaker.breaker_states(log.limit(0)).count() == 0


def test_two_failures_open_and_time_closes(spark):
    ms = lambda n: T0 + dt.timedelta(milliseconds=n)
    rows = [(0, 1, ms(0), "x", False, 1.0), (1, 1, ms(0), "x", False, 1.0), (2, 1, ms(1), "x", True, 1.0), (3, 1, ms(100), "x", True, 1.0), (4, 1, ms(151), "x", True, 1.0), (5, None, ms(1), "x", True, 1.0)]
    got = sorted(tuple(r)[2:] for r in breaker.breaker_states(spark.createDataFrame(rows, LOG), 2, 100).orderBy("event_id").collect())
    assert got == sorted([("Closed", "failed", "Closed"), ("Closed", "opened", "Open"), ("Open", "rejected", "Open"), ("Open", "rejected", "Open"), ("HalfOpen", "ok", "Closed")])


def test_a_hot_service_is_in_many_tasks(spark):
    rows = [(i, 7, T0 + dt.timedelta(hours=i), "x", i % 3 > 0, 1.0) for i in range(2000)]
    log = spark.createDataFrame(rows, LOG)
    dealt = log.withColumn("chunk", F.floor(F.unix_micros("ts") / 3_600_000_000)).repartition(16, "service", "chunk")
    assert dealt.select(F.spark_partition_id()).distinct().count() > 4
    got = sorted(tuple(r) for r in breaker.breaker_states(log, 1, 3_600_000).collect())
    assert got == plain_breaker(rows, 1, 3600)


@pytest.mark.parametrize("width", [1, 50, 100_000])
def test_as_of(spark, width):
    rng = random.Random(width)
    moment = lambda: T0 + dt.timedelta(seconds=rng.randrange(300))
    right = [(rng.choice([1, 2, None]), moment(), rng.randrange(5)) for _ in range(60)]
    left = [(i, rng.choice([1, 2, 3, None]), rng.choice([moment(), moment(), None])) for i in range(200)]
    found = asof.as_of(spark.createDataFrame(left, "i int, k int, at timestamp"), spark.createDataFrame(right, "k int, at timestamp, v int"), "k", "at", F.col("v"), "seen", width)
    got = sorted(tuple(r) for r in found.select("i", "seen").collect())
    want = []
    for i, k, at in left:
        hits = [(a, v) for k2, a, v in right if k is not None and k2 == k and at is not None and a <= at]
        want.append((i, max(hits)[1] if hits else None))
    assert got == want


def test_tokens_at_the_same_instant(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    uses = [("before", 1, day(0), day(90), day(1)), ("issued at revocation", 1, day(2), day(90), day(3)), ("used at revocation", 1, day(1), day(90), day(2)), ("after", 1, day(3), day(90), day(4)), ("expired", 2, day(0), day(5), day(5)), ("no member", None, day(0), day(9), day(1))]
    frame = spark.createDataFrame(uses, "token string, member int, issued_at timestamp, expires_at timestamp, at timestamp")
    gone = spark.createDataFrame([(1, day(2))], "member int, at timestamp")
    got = {r.token: r.valid for r in asof.valid_tokens(frame, gone).collect()}
    assert got == {"before": True, "issued at revocation": False, "used at revocation": False, "after": True, "expired": False, "no member": True}


def test_manifest_versions(spark, tmp_path):
    columns = "path string, version int, checksum string, deleted boolean"
    table = snapshots.Versions(spark, str(tmp_path / "t"))
    assert table.version() is None and table.current() is None
    first = spark.createDataFrame([("a", 1, "x", False), ("b", 1, "y", False), ("c", 1, "z", False)], columns)
    second = spark.createDataFrame([("a", 2, "x2", False), ("b", 2, None, True), ("d", 2, "w", False), ("d", 3, "w3", False), ("c", 0, "old", False)], columns)
    assert table.merge(first, ["path"], ["version"], 1) and table.merge(second, ["path"], ["version"], 2)
    now = sorted(tuple(r) for r in table.current().collect())
    assert now == [("a", 2, "x2"), ("c", 1, "z"), ("d", 3, "w3")]
    # A replayed batch changes nothing, and neither does a version that was begun and never counted.
    assert not table.merge(second, ["path"], ["version"], 2) and table.version() == 2
    first.drop("deleted").write.parquet(str(tmp_path / "t" / "v=3"))
    assert sorted(tuple(r) for r in table.current().collect()) == now
    assert table.merge(second, ["path"], ["version"], 3) and table.version() == 3
    assert sorted(tuple(r) for r in table.current().collect()) == now


def test_restored_rows_replace(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, x string")
    old = spark.createDataFrame([(2, "old"), (3, "c")], "id int, x string")
    once = snapshots.replaced(now, old, ["id"])
    assert sorted(tuple(r) for r in once.collect()) == [(1, "a"), (2, "old"), (3, "c")]
    assert sorted(tuple(r) for r in snapshots.replaced(once, old, ["id"]).collect()) == [(1, "a"), (2, "old"), (3, "c")]


def test_reconciliation(spark):
    things = spark.createDataFrame([("a", 1, "x"), ("b", 2000, "y"), ("c", 3, "z"), ("e", 5, "q"), (None, 1, "n")], "path string, size int, checksum string")
    meta = spark.createDataFrame([("a.metadata", 1, "x"), ("b.metadata", 2, "y"), ("d.metadata", 4, "w"), ("e.metadata", 5, "r"), (None, 9, "n")], "path string, size int, checksum string")
    rows = objects.reconciled(things, meta)
    got = sorted(((r.path, r.status, r.bucket) for r in rows.collect()), key=str)
    assert got == sorted([("a", "matched", "small"), ("b", "size differs", "medium"), ("c", "no metadata", "small"), ("d", "no object", "small"), ("e", "checksum differs", "small"), (None, "no metadata", "small"), (None, "no object", "small")], key=str)
    assert {r.issue: r.n for r in objects.optimisation(rows, things).collect()} == {"objects without metadata": 2, "metadata without object": 2, "small objects": 4, "duplicates": 0}


def test_grants(spark):
    keys = spark.createDataFrame([(1, 10, T0), (1, 11, T0 - dt.timedelta(days=100)), (2, 20, None)], "team int, key_id int, created_at timestamp")
    people = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, False), (3, 9, True)], "team int, member int, active boolean")
    blob = F.concat_ws("/", F.col("key_id").cast("string"), F.col("member").cast("string"))
    held = objects.issued(keys, people, blob)
    assert {r.key_id: r.grants for r in held.collect()} == {10: {1: "10/1", 2: "10/2"}, 11: {1: "11/1", 2: "11/2"}, 20: {}}
    live, archived = objects.live_and_archived(held, F.lit(T0))
    assert {r.key_id for r in live.collect()} == {10, 20} and {r.key_id for r in archived.collect()} == {11}
    again = objects.live_and_archived(held, F.lit(T0 + dt.timedelta(days=90)))[1]
    assert {r.key_id for r in again.collect()} == {10, 11}
    new = spark.createDataFrame([(1, 3), (2, 4)], "team int, member int")
    more = objects.granted_to(live, new, blob)
    assert {r.key_id: sorted(r.grants) for r in more.collect()} == {10: [1, 2, 3], 20: [4]}
    left = objects.without_members(more, spark.createDataFrame([(1, 1), (1, 3), (1, 77)], "team int, member int"))
    assert {r.key_id: (sorted(r.grants), r.removed) for r in left.collect()} == {10: ([2], 2), 20: ([4], 0)}


def test_grants_are_made_in_their_keys_rows(spark):
    keys = spark.createDataFrame([(k % 4, k, T0) for k in range(50)], "team int, key_id int, created_at timestamp")
    people = spark.createDataFrame([(t, m, m % 3 > 0) for t in range(3) for m in range(40)] + [(1, None, True), (1, 1, True)], "team int, member int, active boolean")
    blob = lambda m: F.concat_ws("/", F.col("key_id").cast("string"), m.cast("string"))
    held = objects.issued(keys, people, blob)
    want = objects.issued(keys, people, blob(F.col("member")))
    assert {r.key_id: (r.team, r.grants, r.expires_at) for r in held.collect()} == {r.key_id: (r.team, r.grants, r.expires_at) for r in want.collect()}
    one = spark.createDataFrame([(1, 3), (3, 5)], "team int, member int")
    more = objects.without_members(objects.granted_to(held, one, blob), people.where("member = 4"))
    got = {r.key_id: (len(r.grants), r.grants.get(3), r.grants.get(5), r.removed) for r in more.collect()}
    assert got == {k: ((26, 26, 25, 1)[k % 4] - (k % 4 == 0), f"{k}/3" if k % 4 == 1 else None, f"{k}/5", int(k % 4 < 3)) for k in range(50)}
    # Keys are dealt out once; grants never move.
    plan = more._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert (plan.count("Join"), plan.count("BroadcastHashJoin"), plan.count("REPARTITION_BY_NUM")) == (3, 3, 1), plan


def test_grants_of_all_keys_of_a_team_take_their_steps_once(spark, tmp_path):
    parts = [(k, None if k % 7 == 0 else k % 30) for k in range(1, 120)]
    suppliers = [(m, m % 20, -1.0 if m in (3, 21, 45) else 1.0) for m in range(1, 60)] + [(60, 0, -1.0)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    want = {}
    for key, p_size in parts:
        team = None if p_size is None else p_size % 25
        archived = dt.datetime(2024, 1, 1) + dt.timedelta(days=key % 200 + 90) <= dt.datetime(2024, 6, 1)
        own = [(m, b >= 0) for m, t, b in suppliers if t == team]
        held = {m for m, active in own if active} | ({-1 - team} if own and not archived else set())
        left = held - {min((m for m, _ in own), default=None)}
        digest = lambda m: hashlib.sha256(f"{key}:{m}".encode()).hexdigest()  # noqa: B023, E731
        text = ",".join(f"{m}={digest(m)}" for m in sorted(left, key=lambda m: f"{m}="))
        want[key] = (archived, len(held) - len(left), len(left), hashlib.md5(text.encode()).hexdigest())
    rows = queries.k11_grants(spark, str(tmp_path))
    assert {r.key_id: (r.archived, r.removed, r.n_grants, r.grants_md5) for r in rows.collect()} == want
    # A grant is made in one place, and no map of a key's grants is copied or filtered.
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and plan.index("sha2(") < plan.index("Join"), plan


def test_rotation(spark):
    k = lambda c: F.lit(c * 16)
    rows = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 3, "c"), (4, 1, None), (5, None, "e")], "i int, key_id int, t string").withColumn("content", F.aes_encrypt("t", k("o"), F.lit("GCM")))
    ring = spark.createDataFrame([(1, "o" * 16, "n" * 16, 101), (2, "x" * 16, "n" * 16, 102)], "key_id int, old_key string, new_key string, new_id int")
    out = objects.rotated(rows, ring)
    opens = lambda c: F.try_aes_decrypt("content", k(c), F.lit("GCM")).cast("string").alias(c)
    got = {r.i: (r.key_id, r.error, r.o, r.n) for r in out.select("i", "key_id", "error", opens("o"), opens("n")).collect()}
    assert got == {1: (101, None, None, "a"), 2: (2, "authentication failed", "b", None), 3: (3, "no such key", "c", None), 4: (101, None, None, None), 5: (None, "no such key", "e", None)}


def test_hmac(spark):
    rows = [(bytes([0x0B] * 20), b"Hi There"), (b"Jefe", b"what do ya want for nothing?"), (b"\xaa" * 131, b"long key"), (b"k" * 64, b""), (b"", b"m"), (bytes(range(256)), bytes(range(256)))]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k binary, m binary")
    got = {r.i: r.h for r in frame.select("i", objects.hmac_sha256(F.col("k"), F.col("m")).alias("h")).collect()}
    assert got == {i: hmac.new(k, m, hashlib.sha256).hexdigest() for i, (k, m) in enumerate(rows)}
    assert got[0] == "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"


def test_hmac_query(spark):
    texts = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.l11_hmac(spark, SF).collect():
        d = texts[r.doc_id]
        assert r.signature == hmac.new(((d.lang or "-") + "-key").encode() * (d.doc_id % 30 + 1), d.text.encode(), hashlib.sha256).hexdigest() and not r.verifies_changed


@pytest.fixture
def stateful_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def streamed(spark, parts, make, tmp_path):
    """What a stream gives whose rows arrive in these parts, one micro-batch each."""
    source = tmp_path / "in"
    for k, rows in enumerate(parts):
        path = str(tmp_path / f"part{k}")
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(path)
        (source).mkdir(exist_ok=True)
        file = next((tmp_path / f"part{k}").glob("part-*.parquet"))
        target = source / f"{k:04d}.parquet"
        target.write_bytes(file.read_bytes())
        import os

        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = str(tmp_path / "out")
    query = make(log).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(out).collect())


END = (9_999, 99, T0 + dt.timedelta(days=3), "Encrypt", True, 1.0)


def test_streamed_pairs(spark, tmp_path, stateful_store):
    s = lambda n: T0 + dt.timedelta(seconds=n)
    rows = [(1, 1, s(0), "Read", True, 1.0), (2, 1, s(5), "Read", True, 1.0), (3, 1, s(9), "Write", True, 1.0), (4, 1, s(10), "Write", True, 1.0), (5, 2, s(3), "Write", True, 1.0), (6, 2, s(4), "Read", True, 1.0), (7, 2, s(4000), "Write", True, 1.0)]
    late = (8, 1, s(4), "Write", True, 1.0)
    # The restarted start comes out of order, in a later part than its end; the late end is behind the watermark.
    got = streamed(spark, [[rows[0], rows[2], rows[4]], [rows[1], rows[3], rows[5]], [rows[6]], [END], [late, (10_000, 99, END[2], "Encrypt", True, 1.0)]], stateful.paired, tmp_path)
    want = oplog.paired(spark.createDataFrame(rows, LOG)).select(F.col("end_id"), "service", "start_id", "micros")
    assert got == sorted(tuple(r) for r in want.collect()) == [(3, 1, 2, 4_000_000), (7, 2, 6, 3_996_000_000)]


def test_streamed_breaker(spark, tmp_path, stateful_store):
    rows = log_rows(11, 200)
    rng = random.Random(2)
    # Rows arrive in the parts of their time, shuffled within.
    parts = [sorted(rows[k : k + 50], key=lambda _: rng.random()) for k in range(0, 200, 50)]
    got = streamed(spark, [*parts, [END], [(10_000, 99, END[2], "Encrypt", True, 1.0)]], lambda log: stateful.breaker_states(log, 2, 400_000), tmp_path)
    assert [r for r in got if r[1] != 99] == plain_breaker(rows, 2, 400)


def test_alerts_are_upserted_once(spark, tmp_path):
    s = lambda n: T0 + dt.timedelta(seconds=n)
    source = tmp_path / "in"

    def arrive(k, rows):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(source))

    def run(checkpoint="c"):
        log = spark.readStream.schema(LOG).parquet(str(source))
        stateful.upserted(stateful.minute_alerts(log), str(tmp_path / "table"), ["alert", "start"], ["n"], str(tmp_path / checkpoint)).awaitTermination()
        return {r.start: (r.n, r.severity) for r in snapshots.Versions(spark, str(tmp_path / "table")).current().collect()}

    arrive(0, [(1, 1, s(1), "x", True, 2000.0), (2, 1, s(70), "x", True, 9000.0), (3, 1, s(71), "x", True, 10.0)])
    assert run() == {s(0): (1, "Warning"), s(60): (1, "Critical")}
    arrive(1, [(4, 1, s(2), "x", True, 20_000.0)])
    assert run() == {s(0): (2, "Critical"), s(60): (1, "Critical")}
    # Restarted from the checkpoint without news, and from none at all: a row for each alert still.
    assert run() == run("other") == {s(0): (2, "Critical"), s(60): (1, "Critical")}


def test_breaker_query_is_the_plain_replay(spark):
    rows = [(r.event_id, r.service, r.ts, r.op_type, r.success, r.duration_ms) for r in op_log(spark, SF).collect()]
    got = sorted(tuple(r) for r in queries.i06_breaker_states(spark, SF).collect())
    assert got == plain_breaker(rows, queries.THRESHOLD, queries.TIMEOUT_MS / 1000)
    assert {r[3] for r in got} == {"ok", "failed", "opened", "rejected"}
