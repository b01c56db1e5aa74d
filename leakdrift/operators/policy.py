"""Policy lines of repositories: the attribute of a path, what a walk leaves out, and the upkeep of the lines.

Lines are rows (repo, line_no, line). A path meets lines by equal keys: a line is looked up by the suffix, folder, name
or path that it says, and a path by all of its own, of which it has as many as dots and slashes. So no path is held
against all lines; only lines with wildcards in other places are, within their repository.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakdrift.operators.team import encrypted

# Lines that every repository gets, those that are never ignored, and files that should not be ignored.
DEFAULT_IGNORED = ["*.leakdrift", "*.enc", ".leakdrift/keys/", ".leakdrift/cache/", "# Leakdrift temporary files", "*.tmp.leakdrift"]
NEVER_IGNORED = [".leakdrift/config.toml", ".leakdrift/team/", ".gitattributes"]
SECTION = "# Leakdrift - Encrypted files and directories"
IMPORTANT_FILES = ["Cargo.toml", "package.json", "requirements.txt", "Gemfile", "build.gradle", "pom.xml"]
# Lines that are added where a file matches them, and folders where one lies in them.
CANDIDATE_FILES = ["*.env", "*.env.local", "*.env.production", "*.env.staging", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa", "id_ed25519"]
CANDIDATE_FOLDERS = ["secrets/*", "config/secrets/*", "keys/*", "certs/*"]
# Parts of lines that belong to this product.
OWN_PARTS = ["leakdrift", ".enc", "*.secret", "*.key"]

KEYS = "array<struct<kind:string,key:string>>"


def lines_of(texts: DataFrame) -> DataFrame:
    """(repo, content) to (repo, line_no, line), line_no from 0; a last line without text is none. Null texts have none."""
    rows = texts.select("repo", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line"), F.size(F.split("content", "\r?\n")).alias("_n"))
    return rows.where((F.col("line") != "") | (F.col("line_no") < F.col("_n") - 1)).drop("_n")


def line_kind(line: Column) -> Column:
    """empty, comment, include or ignore; null lines are null."""
    t = F.trim(line)
    return F.when(t == "", "empty").when(t.startswith("#"), "comment").when(t.startswith("!"), "include").when(t.isNotNull(), "ignore")


def parsed(line: Column) -> Column:
    """(kind, value) of an ignore line, where value is the pattern or comment without blanks at its ends."""
    t, kind = F.trim(line), line_kind(line)
    return F.struct(kind.alias("kind"), F.when(kind == "include", F.substr(t, F.lit(2))).otherwise(t).alias("value"))


def attribute_lines(lines: DataFrame) -> DataFrame:
    """(repo, line_no, pattern, attribute, extra_attrs) of lines of two words or more that are no comments."""
    words = F.split(F.trim("line"), r"\s+")
    rows = lines.where(~line_kind(F.col("line")).isin("empty", "comment")).where(F.size(words) >= 2)
    return rows.select("repo", "line_no", F.get(words, F.lit(0)).alias("pattern"), F.get(words, F.lit(1)).alias("attribute"), F.slice(words, F.lit(3), F.size(words)).alias("extra_attrs"))


def attribute_text(rows: DataFrame) -> DataFrame:
    """attribute_lines() back to lines."""
    line = F.concat_ws(" ", "pattern", "attribute", F.array_join("extra_attrs", " "))
    return rows.select("repo", "line_no", F.trim(line).alias("line"))


def keyed(kind: str, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"))


def dotted(name: Column) -> Column:
    """The ends of a name from each of its dots on."""
    parts = F.split(name, r"\.", -1)
    places = F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2)))
    found = F.transform(places, lambda i: F.concat(F.lit("."), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    return F.when(F.size(parts) > 1, found).otherwise(F.array().cast("array<string>"))


def attribute_key(pattern: Column) -> Column:
    """What a path must have to match: `*.x` the suffix, `d/*` the folder, everything else the whole path."""
    return (
        F.when(pattern.startswith("*."), keyed("suffix", F.substr(pattern, F.lit(2))))
        .when(pattern.endswith("/*"), keyed("folder", F.left(pattern, F.length(pattern) - 1)))
        .otherwise(keyed("path", pattern))
    )


def attribute_keys(path: Column) -> Column:
    """All keys that a path has; null has none."""
    steps = F.split(path, "/", -1)
    places = F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1)))
    folders = F.transform(places, lambda i: keyed("folder", F.concat(F.array_join(F.slice(steps, F.lit(1), i), "/"), F.lit("/"))))
    folders = F.when(F.size(steps) > 1, folders).otherwise(F.array().cast(KEYS))
    return F.concat(F.array(keyed("path", path)), F.transform(dotted(path), lambda s: keyed("suffix", s)), folders)


def first_attribute(paths: DataFrame, lines: DataFrame) -> DataFrame:
    """paths (repo, file_path, more) with `attribute` and `line_no` of their repository's first line that matches.

    Both are null where none does, or the path is null. Of the lines with the same key only the first is looked at; a
    path is looked up once however often it comes, and equal keys are joined, without any pattern being tried.
    """
    key = attribute_key(F.col("pattern"))
    index = lines.select("repo", "line_no", "attribute", key.alias("k")).groupBy("repo", "k.kind", "k.key").agg(F.min(F.struct("line_no", "attribute")).alias("_hit"))
    wanted = paths.select("repo", "file_path").where("file_path is not null").distinct()
    wanted = wanted.select("repo", "file_path", F.inline(attribute_keys(F.col("file_path"))))
    hits = wanted.join(index, ["repo", "kind", "key"]).groupBy("repo", "file_path").agg(F.min("_hit").alias("_hit"))
    return paths.join(hits, ["repo", "file_path"], "left").select(*paths.columns, "_hit.attribute", "_hit.line_no")


def encrypt_by_policy(rows: DataFrame, lines: DataFrame, key: Column) -> DataFrame:
    """rows (repo, file_path, content) with the contents sealed whose path has an attribute; the others as they are, as bytes."""
    found = first_attribute(rows, lines).withColumn("_clear", F.col("content").cast("binary"))
    found = encrypted(found.withColumn("content", F.when(F.col("attribute").isNotNull(), F.col("_clear"))), key, "content")
    return found.withColumn("content", F.coalesce("content", "_clear")).withColumn("sealed", F.col("attribute").isNotNull()).drop("_clear", "line_no")


def opened_or_as_is(content: Column, key: Column) -> Column:
    """What the key opens, and what it doesn't unchanged."""
    return F.coalesce(F.try_aes_decrypt(content, key, F.lit("GCM")), content)


def conflicts(lines: DataFrame) -> DataFrame:
    """(repo, pattern, attribute, other): patterns with several attributes, each two of these in both orders once."""
    some = lines.select("repo", "pattern", "attribute").distinct()
    other = some.withColumnRenamed("attribute", "other")
    return some.join(other, ["repo", "pattern"]).where("attribute <> other")


def discovered(paths: DataFrame, lines: DataFrame, attribute: str, depth: int = 3) -> DataFrame:
    """(repo, pattern, attribute): candidates that a file of the repository matches and no line has yet.

    Files count down to `depth` steps, folders wherever a file lies in them.
    """
    patterns = F.array(*[F.lit(p) for p in (*CANDIDATE_FILES, *CANDIDATE_FOLDERS)])
    candidates = paths.select("repo").distinct().select("repo", F.explode(patterns).alias("pattern")).withColumn("k", attribute_key(F.col("pattern")))
    some = paths.where("file_path is not null").select("repo", F.size(F.split("file_path", "/")).alias("steps"), F.explode(attribute_keys(F.col("file_path"))).alias("k"))
    # As many keys as suffixes, folders and paths; they are made distinct where they are read before they are sent.
    some = some.where((F.col("steps") <= depth) | (F.col("k.kind") == "folder")).select("repo", "k").distinct()
    found = candidates.join(some, ["repo", "k"], "left_semi").join(lines.select("repo", "pattern"), ["repo", "pattern"], "left_anti")
    return found.select("repo", "pattern", F.lit(attribute).alias("attribute"))


GLOB = r"[*?\[]"


def glob_regex(glob: Column) -> Column:
    """The regex of a glob: `*` and `?` stay within a step, `**` doesn't."""
    out = F.regexp_replace(glob, r"([.+^$(){}|\\])", r"\\$1")
    for regex, by in ((r"\*\*/", "\x01"), (r"/\*\*", "\x02"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\x01", "(?:.*/)?"), ("\x02", "/.*")):
        out = F.regexp_replace(out, regex, by)
    return out


def ignore_rules(lines: DataFrame) -> DataFrame:
    """(repo, line_no, negated, only_folders, kind, key, regex): ignore and include lines by the key that finds them.

    A line with a slash before its end starts at the root, any other matches at every step; one that ends with a slash
    matches folders alone. Kinds: a step's name, its end from a dot on, the path from the root, the folder it lies in,
    or a glob, whose regex decides.
    """
    rows = lines.select("repo", "line_no", parsed(F.col("line")).alias("p")).where(F.col("p.kind").isin("include", "ignore"))
    rows = rows.select("repo", "line_no", (F.col("p.kind") == "include").alias("negated"), F.col("p.value").endswith("/").alias("only_folders"), F.regexp_replace("p.value", "/$", "").alias("g"))
    rows = rows.withColumn("g", F.regexp_replace("g", r"^\*\*/(?=[^/]*$)", "")).withColumn("rooted", F.col("g").contains("/"))
    g = F.regexp_replace("g", "^/", "")
    rows = rows.withColumn("g", g).where("g <> ''")
    g, plain = F.col("g"), ~F.col("g").rlike(GLOB)
    folder = F.regexp_extract(g, r"^([^*?\[]+)/\*\*?$", 1)
    key = (
        F.when(~F.col("rooted") & plain, keyed("name", g)).when(~F.col("rooted") & g.rlike(r"^\*\.[^*?\[]*$"), keyed("end", F.substr(g, F.lit(2))))
        .when(F.col("rooted") & plain, keyed("path", g)).when(F.col("rooted") & (folder != ""), keyed("within", folder)).otherwise(keyed("glob", F.lit("")))
    )
    regex = F.concat(F.when(F.col("rooted"), "^").otherwise("(?:^|/)"), glob_regex(g), F.lit("$"))
    return rows.select("repo", "line_no", "negated", "only_folders", key.alias("k"), regex.alias("regex")).select("repo", "line_no", "negated", "only_folders", "k.kind", "k.key", F.when(F.col("k.kind") == "glob", F.col("regex")).alias("regex"))


def steps_of(path: Column) -> Column:
    """Array of a path's steps from the root: the path up to it, whether it's a folder, and its keys."""
    names = F.split(path, "/", -1)

    def step(i: Column) -> Column:
        name, sub = F.get(names, i - 1), F.array_join(F.slice(names, F.lit(1), i), "/")
        above = F.array_join(F.slice(names, F.lit(1), i - 1), "/")
        keys = F.concat(
            F.array(keyed("name", name), keyed("path", sub), keyed("glob", F.lit(""))),
            F.when(i > 1, F.array(keyed("within", above))).otherwise(F.array().cast(KEYS)), F.transform(dotted(name), lambda s: keyed("end", s)),
        )
        return F.struct(sub.alias("sub"), (i < F.size(names)).alias("folder"), keys.alias("keys"))

    return F.transform(F.sequence(F.lit(1), F.size(names)), step)


def ignored_paths(paths: DataFrame, lines: DataFrame) -> DataFrame:
    """(repo, file_path) of the paths that their repository's lines ignore, once each.

    For each step of a path the last line that matches it decides; a path is ignored where it or a folder above is, and
    no line takes it back below an ignored folder. Null paths are not ignored.
    """
    rules = ignore_rules(lines).groupBy("repo", "kind", "key", "only_folders", "regex").agg(F.max(F.struct("line_no", "negated")).alias("_last"))
    wanted = paths.select("repo", "file_path").where("file_path is not null").distinct()
    wanted = wanted.select("repo", "file_path", F.inline(steps_of(F.col("file_path")))).select("repo", "file_path", "sub", "folder", F.inline("keys"))
    hits = wanted.join(rules, ["repo", "kind", "key"]).where((~F.col("only_folders") | F.col("folder")) & (F.col("regex").isNull() | F.expr("sub rlike regex")))
    last = hits.groupBy("repo", "file_path", "sub").agg(F.max("_last").alias("_last")).where("not _last.negated")
    return last.select("repo", "file_path").distinct()


def walk(paths: DataFrame, lines: DataFrame | None = None, hidden: bool = False, depth: int | None = None) -> DataFrame:
    """paths (repo, file_path, more) with `left_out`: why a walk doesn't come to a file; null where it does."""
    path = F.col("file_path")
    reason = F.lit(None).cast("string")
    if lines is not None:
        ignored = ignored_paths(paths, lines).withColumn("_ignored", F.lit(True))
        paths = paths.join(ignored, ["repo", "file_path"], "left").select(*paths.columns, "_ignored")
        reason = F.when(F.col("_ignored"), "ignored")
    if depth is not None:
        reason = F.when(F.size(F.split(path, "/")) > depth, "too deep").otherwise(reason)
    if not hidden:
        reason = F.when(path.rlike(r"(^|/)\.[^/]"), "hidden").otherwise(reason)
    return paths.withColumn("left_out", reason).drop("_ignored")


def important_ignored(lines: DataFrame) -> DataFrame:
    """(repo, line_no, pattern, file): ignore lines that match a file which should stay, by the hook's plain matching."""
    rows = lines.select("repo", "line_no", parsed(F.col("line")).alias("p")).where(F.col("p.kind") == "ignore")
    rows = rows.select("repo", "line_no", F.col("p.value").alias("pattern"), F.explode(F.array(*[F.lit(f) for f in IMPORTANT_FILES])).alias("file"))
    p, f = F.col("pattern"), F.col("file")
    same = p == f
    starts = F.when(p.endswith("*"), f.startswith(F.left(p, F.length(p) - 1))).when(p.startswith("*."), f.endswith(F.substr(p, F.lit(2)))).otherwise(False)
    return rows.where(same | starts)


def warnings(attributes: DataFrame, ignores: DataFrame) -> DataFrame:
    """(repo, warning) of attribute lines with conflicts or that match everything, and of ignore lines as above."""
    texts = lambda *parts: F.concat(*[F.lit(x) if k % 2 == 0 else F.col(x) for k, x in enumerate(parts)]).alias("warning")
    both = conflicts(attributes).select("repo", texts("Conflicting attributes for pattern '", "pattern", "': '", "attribute", "' and '", "other", "'"))
    broad = attributes.where("pattern = '*'").select("repo", F.lit("Pattern '*' will encrypt all files - this may not be intended").alias("warning"))
    kept = important_ignored(ignores).select("repo", texts("Pattern '", "pattern", "' may ignore important file '", "file", "'"))
    return both.unionByName(broad).unionByName(kept)


def cleaned(lines: DataFrame) -> DataFrame:
    """Lines without those that repeat an earlier one of their repository, and then without empty ones after empty ones.

    An empty line is held against the line before it that has stayed, so that duplicates between two empty lines don't
    keep both. Lines are compared without the blanks around them.
    """
    rows = lines.withColumn("_t", F.trim("line"))
    same = Window.partitionBy("repo", "_t").orderBy("line_no")
    rows = rows.withColumn("_n", F.when(F.col("_t") != "", F.row_number().over(same)).otherwise(1)).where("_n = 1")
    before = F.lag("_t").over(Window.partitionBy("repo").orderBy("line_no"))
    return rows.withColumn("_b", before).where(~((F.col("_t") == "") & F.coalesce(F.col("_b") == "", F.lit(False)))).drop("_t", "_n", "_b")


def is_own(line: Column) -> Column:
    """Whether a line belongs to this product: comments by its name, others by what it writes."""
    t, kind = F.trim(line), line_kind(line)
    own = reduce(lambda a, b: a | b, [t.contains(p) for p in OWN_PARTS])
    return F.when(kind == "comment", F.lower(t).contains("leakdrift")).when(kind.isin("include", "ignore"), own).otherwise(F.lit(False))


def without_own(lines: DataFrame) -> DataFrame:
    return lines.where(~is_own(F.col("line")))


def with_added(lines: DataFrame, new: DataFrame) -> DataFrame:
    """lines and those of `new` (repo, line_no, line) whose pattern the repository doesn't have, behind its last one.

    A pattern counts as there whether it's ignored or included; an include line is added unless it is there itself.
    Comments and empty lines are added as they are. A pattern that `new` has twice is added once.
    """
    own = lines.select("repo", parsed(F.col("line")).alias("p"))
    any_kind = own.where(F.col("p.kind").isin("include", "ignore")).select("repo", F.col("p.value").alias("_v")).distinct()
    included = own.where(F.col("p.kind") == "include").select("repo", F.col("p.value").alias("_v")).distinct()
    rows = new.withColumn("_p", parsed(F.col("line"))).withColumn("_v", F.col("_p.value"))
    first = Window.partitionBy("repo", "_p").orderBy("line_no")
    once = rows.where(F.col("_p.kind").isin("include", "ignore")).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    # A pattern that is only ignored may be included as well, but none is ignored that is included.
    fresh = once.where("_p.kind = 'ignore'").join(any_kind, ["repo", "_v"], "left_anti")
    fresh = fresh.unionByName(once.where("_p.kind = 'include'").join(included, ["repo", "_v"], "left_anti"))
    fresh = fresh.unionByName(rows.where(~F.col("_p.kind").isin("include", "ignore"))).select("repo", "line_no", "line")
    last = lines.groupBy("repo").agg(F.max("line_no").alias("_last"))
    fresh = fresh.join(last, "repo", "left").withColumn("_k", F.row_number().over(Window.partitionBy("repo").orderBy("line_no")))
    fresh = fresh.select("repo", (F.coalesce("_last", F.lit(-1)) + F.col("_k")).cast("int").alias("line_no"), "line")
    return lines.select("repo", "line_no", "line").unionByName(fresh)


def with_defaults(lines: DataFrame, repos: DataFrame) -> DataFrame:
    """lines with the default ones of each repository (a table with `repo`): under a heading where it has none of ours yet."""
    ours = lines.where(is_own(F.col("line"))).select("repo").distinct()
    heading = F.array(F.lit(""), F.lit(SECTION))
    body = F.array(*[F.lit(x) for x in (*DEFAULT_IGNORED, *[f"!{x}" for x in NEVER_IGNORED])])
    rows = repos.select("repo").distinct().join(ours.withColumn("_ours", F.lit(True)), "repo", "left")
    rows = rows.select("repo", F.posexplode(F.when(F.col("_ours"), body).otherwise(F.concat(heading, body))).alias("line_no", "line"))
    return with_added(lines, rows)


def imported(lines: DataFrame, attribute: str, marker: str = "git-crypt") -> DataFrame:
    """(repo, line_no, pattern, attribute) of another tool's attribute lines whose first attribute names it."""
    return attribute_lines(lines).where(F.col("attribute").contains(marker)).select("repo", "line_no", "pattern", F.lit(attribute).alias("attribute"))


def exported(attributes: DataFrame, marker: str = "git-crypt") -> DataFrame:
    """(repo, line_no, line): patterns with an encrypting attribute as the other tool's lines."""
    rows = attributes.where(F.col("attribute").contains("encrypt"))
    return rows.select("repo", "line_no", F.concat("pattern", F.lit(f" filter={marker} diff={marker}")).alias("line"))
