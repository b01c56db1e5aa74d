"""Members' lifecycle and lists of files against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leakdrift.functions import inventory as V
from leakdrift.operators import members, objects, team

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("limit", [0, 3, 5, 100])
def test_admissions_one_after_another(spark, limit):
    rng = random.Random(limit)
    people = [(t, m, 0) for t in (1, 2) for m in range(2)]
    new = [(rng.choice([1, 2, 3]), rng.randrange(8), rng.randrange(30)) for _ in range(60)] + [(None, 1, 1), (1, None, 1)]
    schema = "team int, member int, added_at int"
    have = {t: {m for x, m, _ in people if x == t} for t in (1, 2, 3)}
    want = []
    for t, m, at in sorted((r for r in new if None not in r), key=lambda r: (r[2], r[1])):
        error = members.FULL if len(have[t]) >= limit else members.KNOWN if m in have[t] else None
        if error is None:
            have[t].add(m)
        want.append((t, m, at, error))
    p, n = spark.createDataFrame(people, schema), spark.createDataFrame(new, schema)
    got = [tuple(r) for r in members.admissions(p, n, limit).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert members.with_admitted(p, n, limit).count() == len(people) + sum(e is None for *_, e in want)
    assert members.admissions(p, n.limit(0), limit).count() == 0 and members.admissions(p.limit(0), n, 100).where("error is null").count() == len({r[:2] for r in new if None not in r})


def test_leaving(spark):
    people = spark.createDataFrame([(1, 1, "Owner", True), (1, 2, "Member", True), (2, 9, "Admin", False)], "team int, member int, role string, active boolean")
    keys = objects.issued(spark.createDataFrame([(1, 10, T0), (1, 11, T0)], "team int, key_id int, created_at timestamp"), people, F.lit("b"))
    gone = spark.createDataFrame([(1, 2), (1, 2), (2, 9), (2, 77)], "team int, member int")
    left, kept, summary, revoked, entries = members.offboarded(people, keys, gone, F.lit(T0), "ann")
    assert [tuple(r) for r in left.collect()] == [(1, 1, "Owner", True)]
    assert {r.key_id: (sorted(r.grants), r.removed) for r in kept.collect()} == {10: ([1], 1), 11: ([1], 1)}
    assert sorted(tuple(r) for r in summary.collect()) == [(1, 2, "Member", 2, T0), (2, 9, "Admin", 0, T0)]
    assert sorted(r.member for r in revoked.collect()) == [2, 9]
    assert sorted(r.details for r in entries.collect()) == ["Offboarded member: 2 (role: Member, keys revoked: 2)", "Offboarded member: 9 (role: Admin, keys revoked: 0)"]
    assert sorted((r.member, r.active) for r in members.deactivated(people, gone).collect()) == [(1, True), (2, False), (9, False)]


def test_grants_of_those_who_stay_are_no_rows(spark):
    people = spark.createDataFrame([(1, m, "Member", m % 2 == 0) for m in range(200)], "team int, member int, role string, active boolean")
    keys = objects.issued(spark.createDataFrame([(1, k, T0) for k in range(30)], "team int, key_id int, created_at timestamp"), people, F.lit("b"))
    gone = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, None)], "team int, member int")
    summary = members.offboarded(people, keys, gone, F.lit(T0), "ann")[2]
    assert sorted((r.member, r.keys_revoked) for r in summary.collect()) == [(2, 30), (3, 0), (4, 30)]
    assert "explode(map_keys(" not in summary._jdf.queryExecution().optimizedPlan().toString()


def test_skip_reasons_and_hook(spark):
    paths = [("a/b.rs", 5), ("a/.env", 5), ("x.PNG", 5), ("x.properties", 5), ("node_modules/x.js", 5), ("big.rs", 11 * 1024 * 1024), ("Makefile", 5), ("a.exe", 5)]
    df = spark.createDataFrame(paths, "p string, n int")
    reasons = lambda c: [r[0] for r in df.select(V.skip_reason(F.col("p"), F.col("n"), c)).collect()]
    large = f"File too large: {11 * 1024 * 1024} bytes"
    assert reasons(V.SOURCE_CODE) == [None, None, "Extension not in include list: png", "Extension not in include list: properties", "Path contains excluded component: node_modules", large, None, "Extension not in include list: exe"]
    assert reasons(V.ALL_FILES) == [None, None, None, None, "Path contains excluded component: node_modules", large, None, None]
    assert reasons(V.CONFIG_FILES)[:4] == ["Extension not in include list: rs", None, "Extension not in include list: png", None]
    odd = df.select(V.skip_reason(F.col("p"), F.col("n"), regular=F.col("p") != "Makefile")).collect()
    assert odd[6][0] == "Not a regular file" and odd[7][0] == "Extension in exclude list: exe"
    hook = [("a.test.js", False), ("tests/x.rs", False), ("my/tests/x.rs", True), ("a.md", False), ("a.rs", True), ("x.tar.gz", False)]
    got = spark.createDataFrame(hook, "p string, w boolean").select("w", V.hook_takes(F.col("p")).alias("t")).collect()
    assert all(r.w == r.t for r in got)


def test_lists(spark):
    rows = [("b/Z.txt", False, 5, T0, False), ("a/y.enc", False, 9, T0 + dt.timedelta(1), True), ("dir", True, 0, T0, False), ("c/.x", False, 1, T0, False)]
    files = spark.createDataFrame(rows, "file_path string, is_directory boolean, size int, modified timestamp, is_encrypted boolean")
    order = lambda mode: [r.file_path for r in V.listed(files, mode).collect()]
    assert order("name") == ["dir", "c/.x", "a/y.enc", "b/Z.txt"] and order("size") == ["dir", "a/y.enc", "b/Z.txt", "c/.x"]
    assert order("modified")[1] == "a/y.enc" and order("type") == ["dir", "c/.x", "a/y.enc", "b/Z.txt"] and order("encrypted")[:2] == ["dir", "a/y.enc"]
    assert [r.file_path for r in V.listed(files, "size", 1).collect()] == ["dir"]
    assert {r.file_path for r in V.search(files, "Z").collect()} == {"b/Z.txt"} and V.search(files, "").count() == 4 and V.search(files, "", hidden=False).count() == 3
    found = spark.createDataFrame([("dir",), ("dir",), ("b/Z.txt",)], "file_path string")
    assert {r.file_path: r.has_secrets for r in V.with_secrets(files, found).collect()} == {"dir": True, "b/Z.txt": True, "a/y.enc": False, "c/.x": False}


def test_more_grants_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(team, "PART_ROWS", 100, raising=False)
    lines = spark.createDataFrame([(i % 1500, i % 7) for i in range(3000)], "l_partkey long, l_suppkey long")
    held = team.grants(lines)
    assert held.rdd.getNumPartitions() == 30 and team.grants(lines.limit(0)).count() == 0
    people = spark.createDataFrame([(m, m != 3) for m in range(8)], "member long, active boolean")
    got = [(r.member, r.key_id) for r in team.key_ids(held.unionByName(held), people).collect()]
    assert sorted(got) == sorted({(i % 7, i % 1500) for i in range(3000) if i % 7 != 3})
