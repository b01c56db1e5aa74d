"""The queries' SQL for DuckDB, over the same tables."""

from __future__ import annotations

from leakdrift.functions import library as L
from leakdrift.operators.rules import Entropy, Every, Files, Keyword, Not, Regex, Rule
from leakdrift.operators.team import MATRIX, ROLES
from leakdrift.sources.corpus import CORPUS

C = CORPUS.format(V="varchar")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matches(source: str, regexes: list[str]) -> str:
    """CTEs that end in `m`: every match of every regex in source(doc_id, file_path, content) with its place."""
    each = " union all ".join(
        f"select doc_id, file_path, content, {k} as seq, string_split_regex(content, {q(r)}) as g, regexp_extract_all(content, {q(r)}) as v "
        f"from {source} where regexp_matches(content, {q(r)})"
        for k, r in enumerate(regexes)
    )
    chars = "cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) as bigint)"
    octets = "cast(list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: strlen(x))), 0) as bigint)"
    return f"""h as ({each}), e as (select *, unnest(generate_series(1, len(v))) as i from h),
    m0 as (select doc_id, file_path, seq, v[i] as value, {octets} as start_position, left(content, {chars}) as prefix, string_split(content, chr(10)) as lines from e),
    m as (select doc_id, file_path, seq, value, start_position, start_position + strlen(value) as end_position,
      cast(len(string_split(prefix, chr(10))) as int) as line_number, cast(length(string_split(prefix, chr(10))[-1]) + 1 as int) as column_number, lines from m0)"""


PATTERN_ROWS = ", ".join(f"({k}, {q(p.name)}, {q(p.secret_type)}, cast({p.confidence} as double))" for k, p in enumerate(L.PATTERNS))
ENTROPY = "coalesce(list_sum(list_transform(list_sort(list_distinct(string_split(value, ''))), lambda c: -((length(value) - length(replace(value, c, ''))) / cast(strlen(value) as double)) * log2((length(value) - length(replace(value, c, ''))) / cast(strlen(value) as double)))), 0.0)"
CLASSES = "(" + " + ".join(f"cast(regexp_matches(value, {q(p)}) as int)" for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")) + ")"
ADJUSTED = (
    "greatest(0.0, least(1.0, p.confidence"
    + "".join(f" - case when contains(lower(ctx), {q(w)}) or contains(lower(value), {q(w)}) then cast(0.2 as double) else 0 end" for w in L.TEST_WORDS)
    + r" - case when regexp_matches(ctx, '\A\s*(//|#|/\*)') then cast(0.1 as double) else 0 end"
    + "".join(f" + case when contains(lower(ctx), {q(w)}) then cast(0.1 as double) else 0 end" for w in L.CONFIG_WORDS)
    + "))"
)
STEPS = "list_distinct(list_transform(range(1, length(value)), lambda j: unicode(value[j + 1]) - unicode(value[j])))"
FALSE_POSITIVE = (
    "(" + " or ".join(f"contains(lower(value), {q(w)})" for w in L.FALSE_PARTS)
    + " or (strlen(value) >= 8 and len(list_distinct(string_split(value, ''))) = 1)"
    + f" or (length(value) >= 4 and len({STEPS}) = 1 and abs({STEPS}[1]) = 1))"
)
EXT = r"lower(regexp_extract(regexp_extract(file_path, '[^/]*$'), '^.+\.([^.]*)$', 1))"
HAS_EXT = r"regexp_matches(regexp_extract(file_path, '[^/]*$'), '^.+\.[^.]*$')"


def any_of(words: list[str]) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


COMPOSITE = f"""floor(greatest(0.0, least(1.0, a * case when h > 0 and h < 2.5 then cast(0.7 as double) when h > 4.5 then 1.1 else 1.0 end
  * case when strlen(value) < 8 then cast(0.6 as double) when strlen(value) > 40 and strlen(value) < 100 then 1.05 when strlen(value) > 200 then 0.8 else 1.0 end
  * case when {CLASSES} >= 3 then cast(1.1 as double) when {CLASSES} = 1 then 0.7 else 1.0 end
  * case when not {HAS_EXT} then cast(1.0 as double) when {EXT} in {any_of(L.CONFIG_EXTENSIONS)} then 1.2 when {EXT} in {any_of(L.SOURCE_EXTENSIONS)} then 1.0
      when {EXT} in {any_of(L.DOC_EXTENSIONS)} then 0.7 when contains(file_path, 'test') then 0.5 else 1.0 end
  * case when {FALSE_POSITIVE} then cast(0.3 as double) else 1.0 end)) * 1e6 + cast(0.51 as double)) / 1e6"""
SCORED = f"""with c as ({C}), {matches('c', [p.regex for p in L.PATTERNS])}, p(seq, name, secret_type, confidence) as (values {PATTERN_ROWS}),
s0 as (select m.*, array_to_string(lines[greatest(1, line_number - 2):line_number + 2], ' ') as ctx from m),
s1 as (select s0.*, p.name as detector_name, p.secret_type, case when strlen(value) between 8 and 1000 then {ENTROPY} else 0 end as h, {ADJUSTED} as a from s0 join p using (seq)),
s as (select *, {COMPOSITE} as confidence from s1),
f as (select * from s qualify row_number() over (partition by doc_id, start_position, end_position order by seq) = 1),
l as (select *, case when confidence < 0.3 then 'VeryLow' when confidence < 0.5 then 'Low' when confidence < 0.7 then 'Medium' when confidence < 0.9 then 'High' else 'VeryHigh' end as confidence_level from f)
"""
SKIP = (
    f"case when strlen(content) > {L.MAX_FILE_BYTES} then 'File too large: ' || strlen(content) || ' bytes' when {EXT} in {any_of(L.EXCLUDED_EXTENSIONS)} then 'Extension in exclude list: ' || {EXT} "
    + " ".join(f"when contains(lower(file_path), {q(w)}) then {q('Path contains excluded component: ' + w)}" for w in L.EXCLUDED_PARTS)
    + " end"
)
# The line's number goes where the path of a file stands.
HOOK_SOURCE = "(select doc_id, cast(generate_subscripts(string_split(content, chr(10)), 1) as int) as file_path, unnest(string_split(content, chr(10))) as content from c)"
HOOKS = matches(HOOK_SOURCE, list(L.HOOK_PATTERNS.values()))
LOG = """with o as (select event_id, ts, case event_type when 'view' then 'Read' when 'click' then 'Write' when 'signup' then 'Decrypt' else 'Encrypt' end as op_type,
 user_id as service, value * 100 as duration_ms, event_type <> 'error' as success from events)"""
MEMBERS = f"select s_suppkey as member, [{', '.join(map(q, ROLES))}][s_suppkey % 4 + 1] as role, s_acctbal >= 0 as active from supplier"
MAY = " or ".join(f"(role = {q(r)} and operation in {any_of(o)})" for r, o in MATRIX.items())
LINE_ENTROPY = f"exists (select 1 from (select unnest(string_split(content, chr(10))[1:100]) as value) v where strlen(rtrim(value, chr(13))) > 20 and round({ENTROPY.replace('value', 'rtrim(value, chr(13))')}, 9) > 4.0)"
NULS = "strlen(content) - strlen(replace(content, chr(0), ''))"
WARN_LIST = [(f"strlen(content) > {100 * 1024 * 1024}", "File too large for encryption (>100MB)"), (f"{NULS} > strlen(content) // 100", "File appears to be binary - ensure this is intended")]
WARN_LIST += [(f"regexp_matches(content, {q(r)})", f"{n} detected in file content") for n, r in L.WARNINGS.items()]
WARN_LIST += [(LINE_ENTROPY, "High entropy string detected - may be encoded secret")]
WARN_LIST += [("regexp_matches(lower(file_path), 'password|secret|key|token|credential')", "Filename suggests this file may contain sensitive data")]
WARN = "array_to_string(list_filter([" + ", ".join(f"case when {c} then {q(n)} end" for c, n in WARN_LIST) + "], lambda x: x is not null), '; ')"
TOKENS = "select distinct value from (select unnest(string_split(text, ' ')) as value from documents) where length(value) >= 8"

#: Rules of each kind that the query of the rules runs; the SQL below says the same.
RULES = [
    Rule("aws", Regex("akia[0-9a-z]{16}", case_sensitive=False), 0.9),
    Rule("words", Keyword(("password", "token"), 10), 0.7),
    Rule("both", Every((Regex("secret"), Regex("[0-9]{6}"))), 0.6),
    Rule("clean", Not((Regex("(?i)key|password|token|secret"),)), 0.5),
    Rule("files", Files((".env", "src/*.rs"), Regex("=[A-Za-z0-9]{8}")), 0.8),
    Rule("off", Regex("a"), enabled=False),
]

ENTROPY_RULE = Rule("windows", Entropy(4.2, 20, 22), 0.6)


def of_rule(rule: str, kind: str, sure: float, regex: str, where: str = "true") -> str:
    found = f"(with {matches('c', [regex])} select * from m)"
    return f"select doc_id, {q(rule)} as rule_id, {q(kind)} as match_type, value as text, start_position, end_position, cast({sure} as double) as confidence from {found} z where {where}"


def of_word(rule: str, word: str, radius: int, sure: float) -> str:
    k = len(word)
    return f"""select doc_id, {q(rule)} as rule_id, 'keyword' as match_type, substring(content, a, b - a + 1) as text, cast(strlen(left(content, a - 1)) as bigint) as start_position,
      cast(strlen(left(content, b)) as bigint) as end_position, cast({sure} as double) as confidence
      from (select doc_id, content, greatest(i - {radius}, 1) as a, least(i + {k + radius - 1}, length(content)) as b
        from (select doc_id, content, unnest(range(1, length(content) - {k} + 2)) as i from c where contains(lower(content), {q(word)})) x where substring(lower(content), i, {k}) = {q(word)}) y"""


HOLDS_BOTH = "regexp_matches(content, 'secret') and regexp_matches(content, '[0-9]{6}')"
RULE_ROWS = " union all ".join([
    of_rule("aws", "regex", 0.9, "(?i)akia[0-9a-z]{16}"),
    of_word("words", "password", 10, 0.7), of_word("words", "token", 10, 0.7),
    of_rule("both", "regex", 0.6, "secret", f"doc_id in (select doc_id from c where {HOLDS_BOTH})"),
    of_rule("both", "regex", 0.6, "[0-9]{6}", f"doc_id in (select doc_id from c where {HOLDS_BOTH})"),
    "select doc_id, 'clean', 'composite', 'negative_match', 0, 0, cast(0.5 as double) from c where not regexp_matches(content, '(?i)key|password|token|secret')",
    of_rule("files", "regex", 0.8, "=[A-Za-z0-9]{8}", "ends_with(file_path, '.env') or regexp_matches(file_path, 'src/.*.rs')"),
])
CHARSET = "len(list_distinct(string_split(value, '')))"
NORMAL = f"case when {CHARSET} > 1 then {ENTROPY} / log2({CHARSET}) else 0.0 end"
PROSE = "(" + " + ".join(f"cast(contains(lower(value), {q(w)}) as int)" for w in L.COMMON_WORDS) + ") >= 2"
COMMON = "(" + " or ".join(f"contains(lower(value), {q(w)})" for w in L.NON_SECRETS) + ")"
LIKELY = (
    f"{ENTROPY} >= 3.5 and {NORMAL} >= 0.6 and {CHARSET} >= 8 and not {PROSE} and not regexp_matches(value, '^([0-9]*|[A-Z]*|[a-z]*)$') and not {COMMON}"
)
SURE = (
    f"greatest(cast(0.0 as double), least(cast(1.0 as double), least({ENTROPY} / 6, cast(0.4 as double)) + cast(0.3 as double) * {NORMAL} + least({CHARSET} / cast(62 as double), cast(0.2 as double))"
    f" + case when strlen(value) >= 20 then cast(0.1 as double) when strlen(value) >= 12 then 0.05 else 0 end + case when {CLASSES} >= 3 then cast(0.1 as double) else 0 end"
    f" - case when {PROSE} then cast(0.3 as double) else 0 end - case when {COMMON} then cast(0.4 as double) else 0 end))"
)
INSIDE = "strlen(value) between 8 and 1000"
KINDS = "(" + " + ".join(f"cast(regexp_matches(value, {q(k)}) as int)" for k in (r"\p{Lu}", r"\p{Ll}", r"\p{N}", r"[^\p{L}\p{N}]")) + ")"
VALUES = "select distinct unnest(string_split(text, ' ')) as value from documents"
PASSWORD = [
    (r"not regexp_matches(value, '\A[^\n]{8,}\z')", "Password must be at least 8 characters long", "Critical"),
    ("(" + " or ".join(f"contains(lower(value), {q(w)})" for w in ("password", "12345678", "qwerty123", "admin123")) + ")", "Password appears to contain common weak patterns", "Warning"),
    (f"{KINDS} <= 1", "Password is very weak", "Warning"),
    (f"{KINDS} = 2", "Password is weak - consider adding more character types", "Warning"),
    (f"{KINDS} = 3", "Password is moderate strength", "Warning"),
]


def told(found: list[tuple[str, str, str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when {c} then {q(m)} end" for c, m, _ in found) + "], lambda x: x is not null), '; ')"


PATHS = [
    ("contains(value, '..')", "Path traversal detected (..)", "Critical"),
    (r"not regexp_matches(value, '^[^<>:|?*\x00-\x1f]*$')", "Path contains invalid characters", "Critical"),
    ("strlen(value) > 4096", "Path too long (max 4096 characters)", "Critical"),
]
FILE_NAME_HAS_EXT = r"regexp_matches(regexp_extract(file_path, '[^/]*$'), '^.+\.[^.]*$')"
HUNDREDTH = "printf('%.{d}f', cast(round_even(cast(confidence * 100 as decimal(20,9)), {d}) as double))"



def found(regexes: list[str], stage: int, keep: str = "true", names: list[str] | None = None) -> str:
    """Matches of the regexes in c that `keep` (a condition on value) holds for; with names, the second group's, by its name."""
    lead = "regexp_extract_all(content, {r}, 1)" if names else "cast([] as varchar[])"
    each = " union all ".join(
        f"select doc_id, file_path, content, {k} as seq, {q(names[k] if names else '')} as name, string_split_regex(content, {q(r)}) as g, regexp_extract_all(content, {q(r)}) as w, "
        f"{lead.format(r=q(r))} as l, regexp_extract_all(content, {q(r)}{', 2' if names else ''}) as v from c where regexp_matches(content, {q(r)})"
        for k, r in enumerate(regexes)
    )
    before = "array_to_string(list_concat(list_transform(generate_series(1, i - 1), lambda k: g[k] || w[k]), [g[i], coalesce(l[i], '')]), '')"
    return f"""select doc_id, file_path, {stage} as stage, seq, name, value, cast(strlen(b) as bigint) as start_position, cast(strlen(b) + strlen(value) as bigint) as end_position,
      cast(len(string_split(b, chr(10))) as int) as line_number, cast(length(string_split(b, chr(10))[-1]) + 1 as int) as column_number, string_split(content, chr(10)) as lines
      from (select *, {before} as b from (select * from (select *, v[i] as value from (select *, unnest(generate_series(1, len(v))) as i from ({each}) e0) e1) e2 where {keep}) e3) e4"""


TOKEN = r"[\p{L}\p{N}\-_+/=]+"
BASE64 = "[A-Za-z0-9+/]{20,}={0,2}"
LOOK = "strlen(value) between 8 and 1000 and not regexp_matches(value, '^([0-9]*|[A-Z]*|[a-z]*)$') and length(value) >= 10 and len(list_distinct(string_split(value, ''))) >= 10"
SHAPED = "(strlen(value) % 4 = 0 or (strlen(value) % 4 = 2 and ends_with(value, '==')) or (strlen(value) % 4 = 3 and ends_with(value, '=')))"
FREE = "not exists (select 1 from m0 x where x.doc_id = {t}.doc_id and (({t}.start_position >= x.start_position and {t}.start_position < x.end_position) or ({t}.end_position > x.start_position and {t}.end_position <= x.end_position)))"
CONTEXTUAL = {k: rf"""(?i)({k}[:\s=]+["']?)({r})["']?""" for k, r in L.CONTEXTUAL.items()}
GOOD_TOKEN = f"{INSIDE} and {LIKELY} and not {FALSE_POSITIVE} and {CHARSET} >= 10 and ({ENTROPY} <= 5.5 or regexp_matches(value, '^[ -~]*$'))"
GOOD_WORD = (
    f"not (" + " or ".join(f"contains(lower(value), {q(w)})" for w in L.HELP_WORDS) + f") and (name <> 'password' or {CLASSES} >= 2)"
    " and (name not in ('api_key', 'token') or strlen(value) >= 20) and (name <> 'secret' or strlen(value) >= 12)"
)
WORD_SURE = f"least(cast(0.95 as double), cast(0.6 as double) + case when name in ('password', 'private_key') then cast(0.15 as double) when name in ('api_key', 'token', 'secret') then 0.1 else 0 end + {CLASSES} * cast(0.05 as double) + case when strlen(value) > 30 then cast(0.1 as double) else 0 end + case when {ENTROPY} > 4.0 then cast(0.1 as double) else 0 end)"
ENTROPY_KIND = f"""case when starts_with(value, 'AKIA') then 'aws_access_key' when starts_with(value, 'sk_') or starts_with(value, 'pk_') then 'api_key' when regexp_matches(value, '^[0-9a-fA-F]{{40}}$') then 'sha1_hash_or_token'
  when regexp_matches(value, '^[0-9a-fA-F]{{64}}$') then 'sha256_hash_or_token' when {CLASSES} = 4 then 'high_entropy_password' when {CHARSET} > 50 then 'high_entropy_token' else 'high_entropy_string' end"""
SEVERITIES = "case secret_type " + " ".join(f"when {q(k)} then {v}" for k, v in L.SEVERITY.items()) + " else 5 end"
#: `m0` are the patterns' matches, `f` the findings of all stages, one for each span.
ALL_STAGES = SCORED.split("s0 as (")[0].replace(matches("c", [p.regex for p in L.PATTERNS]), "m0 as (" + found([p.regex for p in L.PATTERNS], 0) + ")").rstrip(", \n") + f""",
 t2 as ({found([TOKEN], 2, LOOK)}), t3 as ({found([BASE64], 3, SHAPED)}), t4 as ({found(list(CONTEXTUAL.values()), 4, "true", list(CONTEXTUAL))}),
 y as (select m0.*, p.secret_type, p.confidence as base from m0 join p using (seq)
  union all select t2.*, {ENTROPY_KIND}, {SURE} from t2 where {FREE.format(t='t2')} and {GOOD_TOKEN}
  union all select t3.*, {ENTROPY_KIND}, {SURE} from t3 where {FREE.format(t='t3')} and {INSIDE} and {SURE} > 0.6
  union all select t4.*, 'contextual_pattern', {WORD_SURE} from t4 where {GOOD_WORD}),
 s0 as (select y.*, array_to_string(list_transform(lines[greatest(1, line_number - 2):line_number + 2], lambda x: rtrim(x, chr(13))), ' ') as ctx, {{'confidence': base}} as p from y),
 s1 as (select s0.*, case when strlen(value) between 8 and 1000 then {ENTROPY} else 0 end as h, {ADJUSTED} as a from s0),
 s as (select *, case when stage = 4 then floor(base * 1e6 + cast(0.51 as double)) / 1e6 else {COMPOSITE} end as confidence from s1),
 f as (select * from s qualify row_number() over (partition by doc_id, start_position, end_position order by stage, seq) = 1),
 r as (select *, case when strlen(value) > 50 then left(value, 47) || '...' else value end as shown from f)
"""
BY_PATTERN = "p.confidence" + "".join(f" + case when detector_name = {q(n)} and contains(lower(ctx), {q(w)}) then cast(0.1 as double) else 0 end" for n, ws in L.CONTEXT_WORDS.items() for w in ws)
BY_PATTERN += "".join(f" - case when detector_name = {q(n)} and (contains(lower(ctx), {q(w)}) or contains(lower(value), {q(w)})) then cast(0.2 as double) else 0 end" for n, ws in L.IGNORE_WORDS.items() for w in ws)
BY_PATTERN += " - case when " + " or ".join(f"contains(lower(value), {q(w)})" for w in L.NO_SECRET_WORDS) + " then cast(0.3 as double) else 0 end"

ORACLES = {
    "c25_scan_content": ALL_STAGES + f"""select doc_id, file_path, shown as value, secret_type, start_position, end_position, line_number, column_number, stage, confidence,
      case when confidence < 0.3 then 'VeryLow' when confidence < 0.5 then 'Low' when confidence < 0.7 then 'Medium' when confidence < 0.9 then 'High' else 'VeryHigh' end as confidence_level, {SEVERITIES} as severity from r""",
    "c26_post_process": ALL_STAGES + f""", k as (select * from r where confidence >= 0.5 and not regexp_matches(shown, {q('|'.join(L.IGNORED_VALUES))}) order by confidence desc, doc_id, start_position, end_position, secret_type limit 100),
      d as (select *, lag(shown) over w as b_value, lag(file_path) over w as b_path from k window w as (order by confidence desc, doc_id, start_position, end_position, secret_type))
      select doc_id, shown as value, secret_type, confidence from d where b_value is null or b_value <> shown or b_path <> file_path""",
    "c02_find_all_matches": f"with c as ({C}), {matches('c', [p.regex for p in L.PATTERNS])} select doc_id, seq, value, start_position, end_position, line_number, column_number from m",
    "c04_pattern_context": SCORED + f"select doc_id, seq, start_position, floor(greatest(0.0, least(1.0, {BY_PATTERN})) * 1e6 + cast(0.51 as double)) / 1e6 as confidence from s1 join p using (seq)",
    "c05_hook_scan": f"with c as ({C}), {HOOKS}, n(seq, name) as (values {', '.join(f'({k}, {q(n)})' for k, n in enumerate(L.HOOK_PATTERNS))}) select doc_id, file_path as line_number, name, value, start_position as col_bytes from m join n using (seq)",
    "c06_content_warnings": f"with c as ({C}), w as (select doc_id, file_path, {WARN} as warnings from c) select doc_id, file_path, warnings from w where warnings <> ''",
    "c19_composite_confidence": SCORED + "select doc_id, seq, start_position, confidence, round(h, 6) as entropy_score from s",
    "i01_span_dedup": SCORED + "select doc_id, start_position, end_position, detector_name, secret_type, confidence_level from l",
    "g01_by_level": SCORED + "select confidence_level, count(*) as n from l group by 1",
    "g02_by_type": SCORED + "select secret_type, count(*) as n from l group by 1",
    "g03_summary": SCORED + "select count(*) as total, count(*) filter (confidence >= 0.7) as high, count(*) filter (confidence >= 0.3) as reportable, count(distinct file_path) as files from l",
    "g05_risk": SCORED + "select file_path, count(*) as n, count(*) filter (confidence >= 0.8) as high, count(*) filter (confidence >= 0.5 and confidence < 0.8) as medium from l group by 1",
    "b11_critical": SCORED + "select doc_id, start_position, detector_name from l where confidence >= 0.9 or contains(secret_type, 'AWS') or contains(secret_type, 'Private Key')",
    "b01_skip_classifier": f"with c as ({C}) select doc_id, file_path, {SKIP} as skip_reason from c",
    "g04_scan_totals": f"with c as ({C}), r as (select {SKIP} as skip_reason from c) select coalesce(skip_reason, 'scanned') as outcome, count(*) as n from r group by 1",
    "d02_entropy": f"with t as ({TOKENS}) select value, round({ENTROPY}, 6) as shannon, cast(len(list_distinct(string_split(value, ''))) as int) as charset, {CLASSES} as classes from t",
    "c12_false_positives": f"with t as ({TOKENS}) select value, {FALSE_POSITIVE} as false_positive from t",
    "g07_op_metrics": LOG + """, a as (select op_type, count(*) as n, count(*) filter (not success) as errors, sum(cast(duration_ms as decimal(28,6))) as total, min(duration_ms) as min_ms, max(duration_ms) as max_ms from o group by 1)
      select op_type, n, errors, min_ms, max_ms, cast(floor(cast(total as double) / n) as bigint) as avg_ms, round(errors / n, 9) as error_rate,
      round(case when floor(cast(total as double) / 1000) >= 1 then n / floor(cast(total as double) / 1000) else 0 end, 6) as throughput from a""",
    "g11_durations": LOG + " select service, round(cast(sum(cast(duration_ms as decimal(28,6))) as double) / count(*), 4) as avg_ms, max(struct_pack(d := duration_ms, e := event_id)).e as slowest, min(struct_pack(d := duration_ms, e := event_id)).e as fastest from o group by 1",
    "i04_trailing_rate": LOG + " select event_id, service, round(count(*) over (partition by service order by ts range between interval 10 minutes preceding and current row) / 10.0, 6) as per_minute from o",
    "g13_alerts": LOG + """, s as (select count(*) as n, cast(sum(cast(duration_ms as decimal(28,6))) as double) / count(*) as v from o where duration_ms > 1000),
      r as (select count(*) as n from o where ts > (select max(ts) from o) - interval 60 seconds)
      select 'slow_operations' as alert, n, round(v, 6) as value, case when v > 5000 then 'Critical' else 'Warning' end as severity from s where n > 0
      union all select 'low_throughput', n, round(n / 60, 6), 'Warning' from r where n > 0 and n < 600""",
    "g14_health": LOG + """, s as (select count(*) as n, avg(duration_ms) as v from o where duration_ms > 1000), r as (select count(*) as n from o where ts > (select max(ts) from o) - interval 60 seconds)
      select case when s.n > 0 and s.v > 5000 then 'Critical' when s.n > 0 or (r.n > 0 and r.n < 600) then 'Degraded' else 'Healthy' end as status from s, r""",
    "i06_failure_runs": LOG + """, x as (select *, sum(cast(success as int)) over (partition by service order by ts, event_id rows unbounded preceding) as island from o)
      select service, min(ts) as opened, max(ts) as last_ts, count(*) as failures from x where not success group by service, island having count(*) >= 2""",
    "f08_keys_available": f"with m as ({MEMBERS}), g as (select l_suppkey as member, count(distinct l_partkey) as n from lineitem group by 1) select m.member, coalesce(n, 0) as n_keys from m left join g using (member) where active",
    "f09_permissions": f"with m as ({MEMBERS}), o as (select unnest([{', '.join(map(q, MATRIX['Owner']))}]) as operation) select member, operation, active and ({MAY}) as allowed from m, o",
    "n02_decrypt_batch": "select doc_id, text, cast(null as varchar) as error from documents",
    "n03_verify_wrong_key": "select doc_id, text is null as verified from documents",
    "n07_chunks": "with b as (select doc_id, encode(text) as payload from documents where text is not null), n as (select doc_id, payload, unnest(generate_series(0, greatest(1, cast(ceil(octet_length(payload) / 1024.0) as bigint)) - 1)) as chunk_no from b) select doc_id, chunk_no, sha256(payload[chunk_no * 1024 + 1:chunk_no * 1024 + 1024]) as digest from n",
    "n08_integrity": "select doc_id, doc_id % 7 <> 0 or text = '' as intact from documents where text is not null",
    "e08_rules": f"with c as ({C}) {RULE_ROWS}",
    "e02_entropy_rule": f"""with c as ({C}), r as (select distinct doc_id, content, unnest(string_split_regex(content, '[ \\t\\n\\x0b\\f\\r"''(){{}}\\[\\]<>]+')) as run from c),
      k as (select *, unnest([20, 21, 22]) as k from r where length(run) >= 20), w as (select distinct doc_id, content, substring(run, cast(i as bigint), k) as value from (select *, unnest(generate_series(1, length(run) - k + 1)) as i from k) x),
      g as (select *, {ENTROPY} as h from w where {CHARSET} >= 8), e as (select *, {SURE} as sure from g where h >= 4.2 and {LIKELY})
      select doc_id, value as text, cast(strlen(left(content, position(value in content) - 1)) as bigint) as start_position, cast(strlen(left(content, position(value in content) - 1)) + strlen(value) as bigint) as end_position,
       floor(cast(0.6 as double) * sure * 1e6 + cast(0.51 as double)) / 1e6 as confidence from e where sure > 0.7""",
    "d05_analyse": f"with t as ({TOKENS}) select value, case when {INSIDE} then round({ENTROPY}, 6) else 0.0 end as shannon, case when {INSIDE} then round({NORMAL}, 6) else 0.0 end as normalized, cast(case when {INSIDE} then {CHARSET} else 0 end as int) as charset, {INSIDE} and {LIKELY} as likely, case when {INSIDE} then floor({SURE} * 1e6 + cast(0.51 as double)) / 1e6 else 0.0 end as confidence from t",
    "d15_line_entropy": f"with t as (select doc_id, unnest(string_split(text, chr(10))) as value, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as int) as line_no from documents) select doc_id, line_no from t where strlen(value) >= 20 and round({ENTROPY}, 9) > 4.0",
    "b16_validity": SCORED + "select doc_id, start_position, detector_name, secret_type in ('AWS Access Key', 'GitHub Token') or confidence > 0.8 as is_valid from l",
    "a08_csv_report": SCORED + f"select file_path as File, secret_type as Type, cast(line_number as varchar) as Line, {HUNDREDTH.format(d=2)} as Confidence, value as Value from l",
    "c27_summary": SCORED + f"select doc_id, start_position, secret_type || ' in ' || file_path || ' (line ' || line_number || ', confidence: ' || {HUNDREDTH.format(d=1)} || '%)' as summary from l",
    "l13_password_checks": f"with t as ({VALUES}) select value, not ({PASSWORD[0][0]}) as is_valid, {told(PASSWORD)} as messages from t",
    "l14_path_checks": f"with t as (select doc_id, unnest(string_split(text, chr(10))) as value, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as int) as line_no from documents) select doc_id, line_no, value <> '' and not ({' or '.join(c for c, _, _ in PATHS)}) as is_valid, case when value = '' then 'File path cannot be empty' else {told(PATHS)} end as messages from t",
    "g19_validation_rollup": f"with t as ({VALUES}) " + " union all ".join(f"select 'password' as field, {q(s)} as severity, sum(n) as n from (" + " union all ".join(f"select count(*) as n from t where {c}" for c, _, z in PASSWORD if z == s) + ") x having sum(n) > 0" for s in ("Critical", "Warning")),
    "l02_encrypted_paths": f"with c as ({C}), p as (select doc_id, file_path, file_path || case when {FILE_NAME_HAS_EXT} then '.enc' else '.dat.enc' end as encrypted from c) select doc_id, encrypted, translate(file_path, '/' || chr(92), '__') as flat, left(encrypted, length(encrypted) - 4) as decrypted from p",
    "g09_byte_totals": LOG + " select cast(coalesce(sum(size_bytes) filter (success and op_type = 'Encrypt'), 0) as bigint) as bytes_encrypted, cast(coalesce(sum(size_bytes) filter (success and op_type = 'Decrypt'), 0) as bigint) as bytes_decrypted, count(*) filter (success) as n_good from (select o.*, cast(trunc(duration_ms / 100 * 1024) as bigint) as size_bytes from o) o",
    "g10_throughput": LOG + ", m as (select op_type, count(*) as n, floor(sum(cast(duration_ms as decimal(28,6))) / 1000) as s from o group by 1) select 'crypto_' || op_type as name, round(n / cast(s as double), 6) as per_second from m where s >= 1",
    "f12_pairs": LOG + """, x as (select *, lag(op_type) over w as b_type, lag(event_id) over w as b_id, lag(ts) over w as b_ts from o where op_type in ('Read', 'Write') window w as (partition by service order by ts, event_id))
      select service, b_id as start_id, event_id as end_id, epoch_us(ts) - epoch_us(b_ts) as micros from x where op_type = 'Write' and b_type = 'Read'""",
    "g15_component_health": LOG + """, x as (select service, ts, event_id, case when not success then 2 when duration_ms > 1000 then 1 else 0 end as z from o)
      select service, ['Healthy', 'Degraded', 'Critical'][cast(arg_max(z, {'a': ts, 'b': event_id}) as int) + 1] as status, count(*) filter (z > 0) as issues, (select ['Healthy', 'Degraded', 'Critical'][max(z) + 1] from x) as overall from x group by 1""",
    "i07_retries": LOG + """, x as (select *, sum(cast(success as int)) over (partition by service order by ts, event_id rows unbounded preceding) as island from o),
      y as (select service, event_id, cast(row_number() over w as int) as attempt, epoch_us(ts) - epoch_us(lag(ts) over w) as waited_us from x where not success window w as (partition by service, island order by ts, event_id)),
      z as (select *, cast(least(100 * pow(2.0, attempt - 2), 10000.0) as bigint) as asked_ms from y where attempt > 1)
      select service, event_id, attempt, asked_ms, waited_us, waited_us < asked_ms * 1000 as too_early from z""",
    "l07_minutes": "select event_id, strftime(ts, '%Y-%m-%d %H:%M') as modified from events",
    "l10_encodings": "select doc_id, md5(lower(hex(encode(text)))) as hex_md5, md5(base64(encode(text))) as base64_md5, true as round_trip from documents where text is not null",
    "g16_storage": "select lang, count(*) as objects, cast(sum(strlen(text)) as bigint) as bytes from documents where text is not null group by 1",
    "g17_duplicate_objects": "select sha256(text) as checksum, count(*) as copies, min(doc_id) as first_id, cast(sum(strlen(text)) - min(strlen(text)) as bigint) as wasted from documents where text is not null group by 1 having count(*) > 1",
    "l06_human_size": "with b as (select doc_id, strlen(text) as n from documents where text is not null) select doc_id, case when n >= 1099511627776 then printf('%.1f TB', n / 1099511627776.0) when n >= 1073741824 then printf('%.1f GB', n / 1073741824.0) when n >= 1048576 then printf('%.1f MB', n / 1048576.0) when n >= 1024 then printf('%.1f KB', n / 1024.0) else n || ' B' end as size from b",
}
