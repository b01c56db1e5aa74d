"""Policy lines against brute force."""

import random
import re

import pytest

from leakdrift.operators import policy as P


def attribute_matches(pattern, path):
    if pattern.startswith("*."):
        return path.endswith(pattern[1:])
    if pattern.endswith("/*"):
        return path.startswith(pattern[:-1])
    return path == pattern


def glob_matches(glob, sub, rooted):
    out = ""
    i = 0
    while i < len(glob):
        if glob.startswith("/**/", i):
            out, i = out + "/(?:.*/)?", i + 4
        elif glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i):
            out, i = out + "/.*", i + 3
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return re.fullmatch(out if rooted else f"(?:.*/)?{out}", sub) is not None


def ignored(lines, path):
    """Step by step from the root, as a walk does."""
    steps = path.split("/")
    for n in range(1, len(steps) + 1):
        sub, folder, verdict = "/".join(steps[:n]), n < len(steps), False
        for line in lines:
            t = line.strip(" ")
            if not t or t.startswith("#"):
                continue
            negated = t.startswith("!")
            g = t[1:] if negated else t
            only_folders, g = g.endswith("/"), g.removesuffix("/")
            if g.startswith("**/") and "/" not in g[3:]:
                g = g[3:]
            rooted = "/" in g
            g = g.removeprefix("/")
            if g and (folder or not only_folders) and glob_matches(g, sub, rooted):
                verdict = not negated
        if verdict:
            return True
    return False


PATTERNS = ["*.env", "*.env.local", "secrets/*", "config/secrets.*", "a/b/*", "/*", "*", ".env", "a/.env", "*.", "x.y", "*./b"]
PATHS = [".env", "a/.env", "a.env", "x.env.local", "secrets/k", "secrets", "config/secrets.yml", "config/secrets.*", "a/b/c", "a/b", "x.y", "z.x.y", "d.e/f.g", "a.", "*", "", "/abs/file.env", "q./b"]


def test_first_attribute_is_that_of_all_lines(spark):
    rng = random.Random(3)
    lines = [(r, n, rng.choice(PATTERNS), f"a{n}", []) for r in (0, 1, None) for n in range(7)]
    paths = [(r, p, k) for k, (r, p) in enumerate((r, p) for r in (0, 1, 2, None) for p in [*PATHS, PATHS[0], None])]
    attrs = spark.createDataFrame(lines, "repo int, line_no int, pattern string, attribute string, extra_attrs array<string>")
    rows = spark.createDataFrame(paths, "repo int, file_path string, k int")
    found = P.first_attribute(rows, attrs)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    got = {r.k: (r.attribute, r.line_no) for r in found.collect()}
    for r, p, k in paths:
        hit = next(((a, n) for q, n, pat, a, _ in lines if r is not None and q == r and p is not None and attribute_matches(pat, p)), (None, None))
        assert got[k] == hit, (r, p)
    assert len(got) == len(paths)
    assert P.first_attribute(rows.limit(0), attrs).count() == 0 and P.first_attribute(rows, attrs.limit(0)).where("attribute is not null").count() == 0


def test_ignored_paths_are_those_of_a_walk(spark):
    rng = random.Random(4)
    some = ["*.enc", "!config.toml", "# *", "", "  *.log  ", "target/", "/build", "docs/*", "!docs/keep.md", "**/tmp", "a/**/z", "lib/**", "file?.txt", "*", "!*.rs", "!src/", "node*", "deep/er/", "x.y.z", "!a.enc"]
    repos = {r: [rng.choice(some) for _ in range(rng.randint(1, 6))] for r in range(40)}
    names = ["a.enc", "config.toml", "target", "build", "docs", "keep.md", "tmp", "z", "lib", "file1.txt", "main.rs", "src", "node_modules", "deep", "er", "x.y.z", "a", "b.log", ".enc"]
    paths = [(r, "/".join(rng.choice(names) for _ in range(rng.randint(1, 4)))) for r in repos for _ in range(40)]
    lines = spark.createDataFrame([(r, n, x) for r, xs in repos.items() for n, x in enumerate(xs)], "repo int, line_no int, line string")
    got = {(r.repo, r.file_path) for r in P.ignored_paths(spark.createDataFrame(paths, "repo int, file_path string"), lines).collect()}
    want = {(r, p) for r, p in paths if ignored(repos[r], p)}
    assert got == want and 100 < len(want) < len(set(paths)) - 100


def test_walk_reasons(spark):
    rows = [(1, "a/b.txt"), (1, ".git/x"), (1, "a/.hid"), (1, "a/b/c/d"), (1, "out.enc"), (1, None)]
    lines = spark.createDataFrame([(1, 0, "*.enc")], "repo int, line_no int, line string")
    paths = spark.createDataFrame(rows, "repo int, file_path string")
    got = {r.file_path: r.left_out for r in P.walk(paths, lines, depth=3).collect()}
    assert got == {"a/b.txt": None, ".git/x": "hidden", "a/.hid": "hidden", "a/b/c/d": "too deep", "out.enc": "ignored", None: None}
    assert {r.left_out for r in P.walk(paths, None, hidden=True).collect()} == {None}


@pytest.mark.parametrize("seed", range(3))
def test_cleanup(spark, seed):
    rng = random.Random(seed)
    lines = [rng.choice(["*.enc", "", "", " *.enc ", "#c", "!x", "  "]) for _ in range(30)]
    want, seen = [], set()
    for n, x in enumerate(lines):
        t = x.strip()
        if not t:
            if not want or want[-1][1].strip():
                want.append((n, x))
        elif t not in seen:
            seen.add(t)
            want.append((n, x))
    rows = spark.createDataFrame([(r, n, x) for r in (1, 2) for n, x in enumerate(lines)], "repo int, line_no int, line string")
    assert sorted(tuple(r) for r in P.cleaned(rows).collect()) == sorted((r, n, x) for r in (1, 2) for n, x in want)


def test_added_lines_are_added_once(spark):
    lines = spark.createDataFrame([(1, 0, "*.enc"), (1, 5, "!keep")], "repo int, line_no int, line string")
    new = spark.createDataFrame([(1, 0, "*.enc"), (1, 1, "!keep"), (1, 2, "keep"), (1, 3, "*.new"), (1, 4, "*.new"), (1, 5, "!*.enc"), (2, 0, "x"), (2, 1, "# c")], "repo int, line_no int, line string")
    once = P.with_added(lines, new)
    got = sorted(tuple(r) for r in once.collect())
    assert got == [(1, 0, "*.enc"), (1, 5, "!keep"), (1, 6, "*.new"), (1, 7, "!*.enc"), (2, 0, "x"), (2, 1, "# c")]
    again = P.with_added(once, new.where("line <> '# c'"))
    assert sorted(tuple(r) for r in again.collect()) == got


def test_lines_of_texts(spark):
    texts = spark.createDataFrame([(1, "a\r\nb\n\nc\n"), (2, ""), (3, None)], "repo int, content string")
    assert sorted(tuple(r) for r in P.lines_of(texts).collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, ""), (1, 3, "c")]


def test_only_matching_paths_are_sealed(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "a.env", "s3cret"), (1, "b.txt", "plain"), (1, "c.env", None), (1, None, "x")], "repo int, file_path string, content string")
    lines = spark.createDataFrame([(1, 0, "*.env", "enc", [])], "repo int, line_no int, pattern string, attribute string, extra_attrs array<string>")
    key = F.lit("0123456789abcdef")
    sealed = P.encrypt_by_policy(rows, lines, key)
    got = {r.file_path: (r.sealed, r.content, r.opened) for r in sealed.withColumn("opened", P.opened_or_as_is(F.col("content"), key)).collect()}
    assert got["b.txt"] == (False, b"plain", b"plain") and got[None] == (False, b"x", b"x") and got["c.env"] == (True, None, None)
    assert got["a.env"][0] and got["a.env"][1] != b"s3cret" and got["a.env"][2] == b"s3cret"
    wrong = sealed.select(P.opened_or_as_is(F.col("content"), F.lit("fedcba9876543210")).alias("o"), "content")
    assert all(r.o == r.content for r in wrong.collect())
