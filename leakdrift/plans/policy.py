"""The queries on policy lines, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakdrift.functions import checks
from leakdrift.operators import policy as P
from leakdrift.plans.oracles import C, FILE_NAME_HAS_EXT, q
from leakdrift.sources.repositories import ATTRIBUTE_LINES, IGNORE_LINES, attribute_source, files, ignore_lines


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.attribute_lines(attribute_source(spark, sf_dir))


def f05_first_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attribute of each file, and whether it should be encrypted."""
    found = P.first_attribute(files(spark, sf_dir).select("doc_id", "repo", "file_path"), attributes(spark, sf_dir))
    return found.select("doc_id", "file_path", "attribute", "line_no", F.col("attribute").isNotNull().alias("encrypt"))


def n05_policy_encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files sealed by policy, and read back: what isn't sealed passes through unchanged."""
    key = F.lit("0123456789abcdef")  # a caller's key; this one is for the round trip only
    sealed = P.encrypt_by_policy(files(spark, sf_dir).select("doc_id", "repo", "file_path", "content"), attributes(spark, sf_dir), key)
    stored = F.when(F.col("sealed"), checks.encrypted_path(F.col("file_path"))).otherwise(F.col("file_path"))
    return sealed.select("doc_id", "sealed", stored.alias("stored_path"), F.sha2(P.opened_or_as_is(F.col("content"), key), 256).alias("opened_sha256"))


def a05_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a walk over the files leaves one out."""
    return P.walk(files(spark, sf_dir).select("doc_id", "repo", "file_path"), ignore_lines(spark, sf_dir), hidden=False).select("doc_id", "file_path", "left_out")


def f13_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.discovered(files(spark, sf_dir), attributes(spark, sf_dir), "leakdrift-encrypt")


def f06_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.conflicts(attributes(spark, sf_dir))


def k07_policy_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.warnings(attributes(spark, sf_dir), ignore_lines(spark, sf_dir))


def i03_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cleaned(ignore_lines(spark, sf_dir))


def k02_default_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ignore lines with the default ones of every repository."""
    lines = ignore_lines(spark, sf_dir)
    return P.with_defaults(lines, lines)


def k04_without_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ignore_lines(spark, sf_dir)
    return P.without_own(P.with_defaults(lines, lines))


def k05_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ignore_lines(spark, sf_dir).select("repo", "line_no", F.inline(F.array(P.parsed(F.col("line")))))


def k06_attribute_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute lines taken apart, and put together again."""
    rows = attributes(spark, sf_dir)
    text = P.attribute_text(rows).withColumnRenamed("line", "rendered")
    return rows.join(text, ["repo", "line_no"]).select("repo", "line_no", "pattern", "attribute", F.size("extra_attrs").alias("n_extra"), "rendered")


def a14_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another tool's lines among the attribute lines as ours, and ours as the other tool's."""
    ours = P.imported(attribute_source(spark, sf_dir), "leakdrift-encrypt").select("repo", "line_no", F.concat_ws(" ", "pattern", "attribute").alias("line"))
    return ours.unionByName(P.exported(attributes(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (
    f05_first_attribute, n05_policy_encryption, a05_walk, f13_discovered, f06_conflicts, k07_policy_warnings, i03_cleanup, k02_default_lines,
    k04_without_own, k05_line_kinds, k06_attribute_lines, a14_exchange,
)}

I = IGNORE_LINES.format(V="varchar")  # noqa: E741
A = ATTRIBUTE_LINES.format(V="varchar")
LINES = f"""r as ({A}), w as (select repo, line_no, trim(line) as t, string_split_regex(trim(line), '\\s+') as x from r),
 l as (select repo, line_no, x[1] as pattern, x[2] as attribute, x[3:] as extra from w where t <> '' and not starts_with(t, '#') and len(x) >= 2)"""
FILES = f"c as ({C}), p as (select doc_id, doc_id % 2 as repo, file_path, content from c)"
MATCHES = """case when starts_with(pattern, '*.') then ends_with(file_path, substr(pattern, 2))
  when ends_with(pattern, '/*') then starts_with(file_path, left(pattern, length(pattern) - 1)) else file_path = pattern end"""
FIRST = f"""with {FILES}, {LINES}, f as (select doc_id, file_path, content, arg_min(attribute, line_no) as attribute, min(line_no) as line_no
  from p left join l on p.repo = l.repo and {MATCHES} group by all)"""
KIND = "case when trim(line) = '' then 'empty' when starts_with(trim(line), '#') then 'comment' when starts_with(trim(line), '!') then 'include' else 'ignore' end"
VALUE = "case when starts_with(trim(line), '!') then substr(trim(line), 2) else trim(line) end"
PARSED = f"i as ({I}), k as (select repo, line_no, line, {KIND} as kind, {VALUE} as value from i)"


def glob_sql(glob: str) -> str:
    """SQL for the regex of a glob."""
    out = f"regexp_replace({glob}, '([.+^$(){{}}|\\\\])', '\\\\\\1', 'g')"
    for old, new in (("**/", "\x01"), ("/**", "\x02"), ("*", "[^/]*"), ("?", "[^/]"), ("\x01", "(?:.*/)?"), ("\x02", "/.*")):
        out = f"replace({out}, {q(old)}, {q(new)})"
    return out


IGNORED = f"""{PARSED}, g0 as (select repo, line_no, kind = 'include' as negated, ends_with(value, '/') as only_folders, regexp_replace(value, '/$', '') as g from k where kind in ('ignore', 'include')),
 g1 as (select *, contains(g, '/') as rooted, regexp_replace(g, '^/', '') as h from g0),
 g2 as (select *, case when rooted then '^' else '(^|/)' end || {glob_sql('h')} || '$' as regex from g1),
 s as (select doc_id, repo, string_split(file_path, '/') as x, unnest(generate_series(1, len(string_split(file_path, '/')))) as n from p),
 u as (select doc_id, repo, n < len(x) as folder, array_to_string(x[1:n], '/') as sub from s),
 d as (select doc_id, sub, arg_max(negated, line_no) as negated from u join g2 using (repo) where (folder or not only_folders) and regexp_matches(sub, regex) group by all),
 z as (select distinct doc_id from d where not negated)"""
CANDIDATES = ", ".join(f"({q(x)})" for x in (*P.CANDIDATE_FILES, *P.CANDIDATE_FOLDERS))
CONFLICT = f"with {LINES} select distinct x.repo, x.pattern, x.attribute, y.attribute as other from l x join l y on x.repo = y.repo and x.pattern = y.pattern and x.attribute <> y.attribute"
OWN = f"case when {KIND} = 'comment' then contains(lower(trim(line)), 'leakdrift') when {KIND} = 'empty' then false else " + " or ".join(f"contains(trim(line), {q(x)})" for x in P.OWN_PARTS) + " end"
BODY = [*P.DEFAULT_IGNORED, *[f"!{x}" for x in P.NEVER_IGNORED]]
DEFAULTS = f"""with {PARSED}, o as (select distinct repo from i where {OWN}), t(o, line) as (values {', '.join(f'({n}, {q(x)})' for n, x in enumerate(['', P.SECTION, *BODY]))}),
 n as (select b.repo, t.o, t.line, {KIND.replace('line', 't.line')} as kind, {VALUE.replace('line', 't.line')} as value from (select distinct repo from i) b, t where t.o >= 2 or b.repo not in (select repo from o)),
 a as (select * from n where kind in ('comment', 'empty') or (kind = 'ignore' and not exists (select 1 from k where k.repo = n.repo and k.value = n.value and k.kind in ('ignore', 'include')))
   or (kind = 'include' and not exists (select 1 from k where k.repo = n.repo and k.value = n.value and k.kind = 'include'))),
 e as (select repo, line_no, line from i union all select a.repo, cast((select max(line_no) from i where i.repo = a.repo) + row_number() over (partition by a.repo order by o) as int), line from a)"""

ORACLES = {
    "f05_first_attribute": FIRST + " select doc_id, file_path, attribute, line_no, attribute is not null as encrypt from f",
    "n05_policy_encryption": FIRST + f" select doc_id, attribute is not null as sealed, case when attribute is null then file_path when {FILE_NAME_HAS_EXT} then file_path || '.enc' else file_path || '.dat.enc' end as stored_path, sha256(content) as opened_sha256 from f",
    "a05_walk": f"with {FILES}, {IGNORED} select doc_id, file_path, case when regexp_matches(file_path, '(^|/)[.][^/]') then 'hidden' when doc_id in (select doc_id from z) then 'ignored' end as left_out from p",
    "f13_discovered": f"with {FILES}, {LINES}, d(pattern) as (values {CANDIDATES}) select distinct p.repo, d.pattern, 'leakdrift-encrypt' as attribute from p, d where {MATCHES} and not exists (select 1 from l where l.repo = p.repo and l.pattern = d.pattern)",
    "f06_conflicts": CONFLICT,
    "k07_policy_warnings": f"with {LINES}, {PARSED}, y as ({CONFLICT}), m(file) as (values {', '.join(f'({q(x)})' for x in P.IMPORTANT_FILES)})" + """
      select repo, 'Conflicting attributes for pattern ''' || pattern || ''': ''' || attribute || ''' and ''' || other || '''' as warning from y
      union all select repo, 'Pattern ''*'' will encrypt all files - this may not be intended' from l where pattern = '*'
      union all select repo, 'Pattern ''' || value || ''' may ignore important file ''' || file || '''' from k, m where kind = 'ignore'
        and (value = file or case when ends_with(value, '*') then starts_with(file, left(value, length(value) - 1)) when starts_with(value, '*.') then ends_with(file, substr(value, 2)) else false end)""",
    "i03_cleanup": f"""with i as ({I}), a as (select *, row_number() over (partition by repo, trim(line) order by line_no) as n from i), b as (select * from a where trim(line) = '' or n = 1),
      d as (select *, lag(trim(line)) over (partition by repo order by line_no) as before from b) select repo, line_no, line from d where not (trim(line) = '' and before is not null and before = '')""",
    "k02_default_lines": DEFAULTS + " select * from e",
    "k04_without_own": DEFAULTS + f" select * from e where not ({OWN})",
    "k05_line_kinds": f"with {PARSED} select repo, line_no, kind, value from k",
    "k06_attribute_lines": f"with {LINES} select repo, line_no, pattern, attribute, cast(len(extra) as int) as n_extra, pattern || ' ' || attribute || case when len(extra) > 0 then ' ' || array_to_string(extra, ' ') else '' end as rendered from l",
    "a14_exchange": f"with {LINES} select repo, line_no, pattern || ' leakdrift-encrypt' as line from l where contains(attribute, 'git-crypt') union all select repo, line_no, pattern || ' filter=git-crypt diff=git-crypt' from l where contains(attribute, 'encrypt')",
}
