"""The scan: documents (doc_id, file_path, content) to findings, and what is asked of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakdrift.functions import library as L
from leakdrift.functions import text as T
from leakdrift.functions import windows as W
from leakdrift.operators import rules as R

FINDING = ["doc_id", "file_path", "value", "secret_type", "detector_name", "start_position", "end_position", "line_number", "column_number", "stage", "seq", "base_confidence"]


TOKEN = r"[\p{IsAlphabetic}\p{N}\-_+/=]+"
BASE64 = r"[A-Za-z0-9+/]{20,}={0,2}"
#: Whole tokens of 10 code points or more, which worth_a_look() asks for: shorter ones, most words of a text, are no matches.
LONG_TOKEN = rf"(?<!{TOKEN[:-1]}){TOKEN[:-1]}{{10,}}+"


def tagged(found: Column, seq: int, name: str) -> Column:
    """Spans with the number and name of the regex that found them."""
    return F.transform(found, lambda m: F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("name"), m.alias("m")))


def library_spans(patterns: list[L.SecretPattern], low: Column) -> Column:
    """Tagged matches of all patterns in the column content, whose lower-case text is given."""
    return T.spans_of_all(F.col("content"), low, [(p.name, p.regex, p.needs) for p in patterns])


def with_context(found: Column, content: Column) -> Column:
    """Tagged spans with the two lines before and after theirs, from lines that are cut once for each text."""

    def of_lines(lines: Column) -> Column:
        def one(x: Column) -> Column:
            first = F.greatest(F.lit(1), x["m"]["line"] - 2)
            return F.struct(x.alias("x"), F.array_join(F.slice(lines, first, x["m"]["line"] + 3 - first), " ").alias("context"))

        return F.transform(found, one)

    return F.when(F.size(found) > 0, T.let(F.split(content, "\r?\n"), of_lines))


def located(rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows with an array `found` of tagged spans to one row each, with its place and its context, two lines before and after."""
    rows = rows.select("doc_id", "file_path", with_context(F.col("found"), F.col("content")).alias("found"))
    # Of an outer generator no condition on `found` is derived, which would have all spans worked out once more.
    rows = rows.select("doc_id", "file_path", F.explode_outer("found").alias("y")).where("y is not null").select("doc_id", "file_path", "y.x", "y.context")
    return rows.select(
        "doc_id", "file_path", "x.seq", "x.name", "x.m.value", F.col("x.m.start").alias("start_position"), F.col("x.m.end").alias("end_position"),
        F.col("x.m.line").alias("line_number"), F.col("x.m.col").alias("column_number"), "context", *[f"x.{c}" for c in more],
    )


def typed(rows: DataFrame, patterns: list[L.SecretPattern]) -> DataFrame:
    types = F.array(*[F.struct(F.lit(p.secret_type).alias("t"), F.lit(p.confidence).alias("c")) for p in patterns])
    return rows.withColumn("p", F.get(types, F.col("seq"))).select("*", F.col("p.t").alias("secret_type"), F.col("p.c").alias("base_confidence")).drop("p")


def with_low(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "file_path", "content", F.lower("content").alias("low"))


def pattern_matches(docs: DataFrame, patterns: list[L.SecretPattern] = L.PATTERNS) -> DataFrame:
    """Every match of every pattern, overlapping ones of different patterns too, with the pattern's type and confidence."""
    rows = with_low(docs).withColumn("found", library_spans(patterns, F.col("low")))
    return typed(located(rows), patterns)


def patterns_of_type(secret_type: str, patterns: list[L.SecretPattern] = L.PATTERNS) -> list[L.SecretPattern]:
    return [p for p in patterns if p.secret_type == secret_type]


def scored(rows: DataFrame) -> DataFrame:
    """Adds entropy, composite confidence, level and severity to matches that have a context."""
    v = F.col("value")
    entropy = F.when(F.octet_length("value").between(8, 1000), T.entropy(v)).otherwise(0.0)
    # Generators keep scores from being worked out again wherever they are used.
    rows = rows.select("*", F.inline_outer(F.array(F.struct(entropy.alias("entropy_score"), T.adjusted(F.col("base_confidence"), v, F.col("context")).alias("adjusted")))))
    score = T.rounded(T.composite(F.col("adjusted"), v, F.col("entropy_score"), F.col("file_path")))
    rows = rows.select("*", F.explode_outer(F.array(score)).alias("confidence")).drop("adjusted")
    return rows.withColumn("confidence_level", T.level(F.col("confidence"))).withColumn("severity", T.severity(F.col("secret_type")))


def worth_a_look(value: Column) -> Column:
    """What an entropy candidate must have at least; the cheap conditions first, so that few values are measured."""
    single = value.rlike(r"\A([0-9]*|[A-Z]*|[a-z]*)\z")
    return F.octet_length(value).between(8, 1000) & ~single & (F.length(value) >= 10) & (T.charset_size(value) >= 10)


def overlaps(m: Column, taken: Column) -> Column:
    s, e = m["start"], m["end"]
    return F.exists(taken, lambda x: ((s >= x["start"]) & (s < x["end"])) | ((e > x["start"]) & (e <= x["end"])))


def base64_shaped(value: Column) -> Column:
    n = F.octet_length(value)
    return (n % 4 == 0) | ((n % 4 == 2) & value.endswith("==")) | ((n % 4 == 3) & value.endswith("="))


def entropy_kind(v: Column, charset: Column) -> Column:
    return (
        F.when(v.startswith("AKIA"), "aws_access_key").when(v.startswith("sk_") | v.startswith("pk_"), "api_key")
        .when(v.rlike(r"\A[0-9a-fA-F]{40}\z"), "sha1_hash_or_token").when(v.rlike(r"\A[0-9a-fA-F]{64}\z"), "sha256_hash_or_token")
        .when(T.class_count(v) == 4, "high_entropy_password").when(charset > 50, "high_entropy_token").otherwise("high_entropy_string")
    )


def entropy_holds() -> Column:
    """Which entropy candidates of stages 2 and 3 hold, by their column e: runs that look like secrets, base64 runs of
    which the entropy alone is sure enough."""
    v = F.col("value")
    token = F.col("e.likely") & ~T.false_positive(v) & (F.col("e.charset") >= 10) & ((F.col("e.shannon") <= 5.5) | v.rlike(r"\A[ -~]*\z"))
    return F.when(F.col("stage") == 2, token).otherwise(F.col("e.confidence") > 0.6)


def staged(found: Column, stage: int) -> Column:
    """Tagged spans with the number of the stage that found them, and a confidence where they bring their own."""
    sure = (lambda x: x["confidence"]) if stage == 1 else (lambda x: F.lit(None).cast("double"))
    return F.transform(found, lambda x: F.struct(x["seq"].alias("seq"), x["name"].alias("name"), x["m"].alias("m"), F.lit(stage).alias("stage"), sure(x).alias("own")))


def entropy_spans(content: Column, taken: Column) -> Column:
    """Tagged and staged spans of tokens and base64 runs that overlap none of the taken spans."""

    def free(found: Column) -> Column:
        return T.let(taken, lambda t: F.filter(found, lambda m: ~overlaps(m, t)))

    token = free(T.spans(content, LONG_TOKEN, keep=worth_a_look))
    run = free(T.spans(content, BASE64, keep=base64_shaped))
    return F.concat(staged(tagged(token, 0, "entropy"), 2), staged(tagged(run, 0, "base64"), 3))


def entropy_candidates(docs: DataFrame) -> DataFrame:
    """All likely secrets by entropy (stage 2) and base64 runs (stage 3) of the texts, whatever patterns find."""
    rows = located(docs.withColumn("found", entropy_spans(F.col("content"), F.array().cast(T.SPAN))), ("stage",))
    rows = rows.withColumn("e", F.explode_outer(F.array(T.analyse(F.col("value"))))).where(entropy_holds())
    kind = entropy_kind(F.col("value"), F.col("e.charset"))
    return rows.select("*", kind.alias("secret_type"), F.col("e.confidence").alias("base_confidence")).drop("e")


CONTEXTUAL = {k: rf"""(?i)({k}[:\s=]+["']?)({r})["']?""" for k, r in L.CONTEXTUAL.items()}


def contextual_spans(content: Column, low: Column) -> Column:
    return T.spans_of_all(content, low, [(k, r, (k,)) for k, r in CONTEXTUAL.items()], group=2)


def contextual_holds() -> Column:
    v, k, n = F.col("value"), F.col("name"), F.octet_length("value")
    good = ~T.any_part(F.lower(v), L.HELP_WORDS) & ((k != "password") | (T.class_count(v) >= 2))
    return good & (~k.isin("api_key", "token") | (n >= 20)) & ((k != "secret") | (n >= 12))


def contextual_confidence() -> Column:
    """The confidence of a value after a keyword, which is final."""
    v, k = F.col("value"), F.col("name")
    sure = 0.6 + F.when(k.isin("password", "private_key"), 0.15).when(k.isin("api_key", "token", "secret"), 0.1).otherwise(0.0)
    sure = sure + T.class_count(v) * 0.05 + F.when(F.octet_length(v) > 30, 0.1).otherwise(0.0) + F.when(T.entropy(v) > 4.0, 0.1).otherwise(0.0)
    return F.least(F.lit(0.95), sure)


def contextual(docs: DataFrame) -> DataFrame:
    """Values that follow a keyword as `password`; `name` is the keyword."""
    rows = with_low(docs)
    rows = located(rows.withColumn("found", contextual_spans(F.col("content"), F.col("low")))).where(contextual_holds())
    return rows.select("*", F.lit("contextual_pattern").alias("secret_type"), contextual_confidence().alias("base_confidence"))


def first_of_span(rows: DataFrame) -> DataFrame:
    """One finding for each (doc_id, start, end): the earliest stage's, then the earliest pattern's."""
    order = Window.partitionBy("doc_id", "start_position", "end_position").orderBy("stage", "seq")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def scan_content(docs: DataFrame, patterns: list[L.SecretPattern] = L.PATTERNS, rules: list | None = None) -> DataFrame:
    """Patterns, rules, entropy and base64 where neither has a span, then keywords; one finding for each span.

    All stages of a text are arrays of one row, so that nothing is joined and only findings are shuffled, to leave one
    for each span. Texts that are null or empty have no findings; spans of documents with the same doc_id are one;
    empty tables have none; extra columns are not looked at. No Python worker runs.
    """
    content, low = F.col("content"), F.col("low")
    own = F.struct(library_spans(patterns, low).alias("p"), R.rule_spans(rules or [], content, F.col("file_path")).alias("r"), contextual_spans(content, low).alias("k"))
    rows = with_low(docs).select("doc_id", "file_path", "content", F.inline_outer(F.array(own)))
    taken = F.concat(F.transform("p", lambda x: x["m"]), F.transform("r", lambda x: x["m"]))
    rows = rows.withColumn("e", entropy_spans(content, taken))
    every = F.concat(staged(F.col("p"), 0), staged(F.col("r"), 1), F.col("e"), staged(F.col("k"), 4))
    found = located(rows.withColumn("found", every), ("stage", "own"))
    # A generator keeps a value's measures from being repeated wherever they are used.
    stage, v = F.col("stage"), F.col("value")
    known = F.get(F.array(*[F.struct(F.lit(p.secret_type).alias("t"), F.lit(p.confidence).alias("c")) for p in patterns]), F.col("seq"))
    found = found.select("*", F.inline_outer(F.array(F.struct(T.analyse(v).alias("e"), known.alias("p")))))
    found = found.where(F.when(stage.isin(2, 3), entropy_holds()).when(stage == 4, contextual_holds()).otherwise(True))
    kind = F.when(stage == 0, F.col("p.t")).when(stage == 1, "custom_rule").when(stage == 4, "contextual_pattern").otherwise(entropy_kind(v, F.col("e.charset")))
    sure = F.when(stage == 0, F.col("p.c")).when(stage == 1, F.col("own")).when(stage == 4, contextual_confidence()).otherwise(F.col("e.confidence"))
    found = found.select("*", F.inline_outer(F.array(F.struct(kind.alias("secret_type"), sure.alias("base_confidence"))))).drop("e", "p", "own")
    found = scored(found)
    # What stands after a keyword has a confidence of its own.
    found = found.withColumn("confidence", F.when(stage == 4, T.rounded(F.col("base_confidence"))).otherwise(F.col("confidence")))
    found = found.withColumn("confidence_level", T.level(F.col("confidence")))
    found = first_of_span(found)
    return found.withColumn("is_truncated", F.octet_length("value") > 50).withColumn("value", T.truncated(F.col("value")))


def post_process(found: DataFrame, least: float = 0.3, low: bool = False, most: int = 0, parts: int = 32) -> DataFrame:
    """Minimum confidence, ignored values, order by confidence, the first `most` (0: all), equal neighbours once.

    A finding goes where the one before it in the whole order has the same path and value, whatever `most` is. Findings
    are range-sorted; each is held against the one before it in its range, and a range's first against the last of the
    ranges before, of which there is one row each: no task sees all findings. Ties are broken by document and place.
    """
    rows = found.where(F.col("confidence") >= (least if low else max(least, 0.5)))
    rows = rows.where(~F.col("value").rlike("|".join(L.IGNORED_VALUES)))
    key = F.struct((-F.col("confidence")).alias("c"), "doc_id", "start_position", "end_position", "secret_type")
    rows = rows.withColumn("_k", key).withColumn("_v", F.struct("file_path", "value"))
    if most:
        rows = rows.orderBy("_k").limit(most)
        before = F.lag("_v").over(Window.orderBy("_k"))
        return rows.withColumn("_b", before).where(~F.col("_b").eqNullSafe(F.col("_v"))).drop("_k", "_v", "_b")
    cuts = F.sort_array(F.array_distinct(F.percentile_approx("confidence", [i / parts for i in range(1, parts)], 1000)))
    cut = rows.agg(F.coalesce(cuts, F.array().cast("array<double>")).alias("_cuts"))
    # One row of a fixed number of cuts is broadcast. Equal confidences share a range.
    rows = rows.crossJoin(F.broadcast(cut)).withColumn("_r", F.size(F.filter("_cuts", lambda c: c > F.col("confidence")))).drop("_cuts")
    ends = rows.groupBy("_r").agg(F.max_by("_v", "_k").alias("_e"))
    ends = ends.select((F.lead("_r").over(Window.orderBy("_r"))).alias("_r"), "_e")
    rows = rows.withColumn("_b", F.lag("_v").over(Window.partitionBy("_r").orderBy("_k")))
    rows = rows.join(F.broadcast(ends), "_r", "left").withColumn("_b", F.coalesce("_b", "_e"))
    return rows.where(~F.col("_b").eqNullSafe(F.col("_v"))).drop("_k", "_v", "_b", "_r", "_e")


def scan_files(files: DataFrame, patterns: list[L.SecretPattern] = L.PATTERNS, rules: list | None = None) -> tuple[DataFrame, DataFrame]:
    """files (file_path, size_bytes, content, skip_reason) to a row for each file, and the findings of those that are scanned.

    (file_path, size_bytes, n_findings, skipped, skip_reason). Files that the skip rules leave out, or that could not be
    read, have a reason and no findings; a null content without a reason has none either.
    """
    reason = F.coalesce("skip_reason", T.skip_reason(F.col("file_path"), F.col("size_bytes")))
    files = files.withColumn("skip_reason", reason)
    docs = files.where("skip_reason is null").select(F.xxhash64("file_path").alias("doc_id"), "file_path", "content")
    found = scan_content(docs, patterns, rules)
    counts = found.groupBy("file_path").agg(F.count("*").alias("_n"))
    rows = files.join(counts, "file_path", "left")
    results = rows.select("file_path", "size_bytes", F.coalesce("_n", F.lit(0)).alias("n_findings"), F.col("skip_reason").isNotNull().alias("skipped"), "skip_reason")
    return results, found


def hook_lines(docs: DataFrame) -> DataFrame:
    """The commit hook: its patterns on each line; 1-based line, 0-based byte column."""
    rows = docs.select("doc_id", F.posexplode(F.split("content", "\n")).alias("i", "content"))
    # Every match of the patterns has one of these.
    rows = rows.where(F.col("content").rlike("(?i)akia|key|password|token|secret"))
    found = F.concat(*[tagged(T.spans(F.col("content"), r), k, n) for k, (n, r) in enumerate(L.HOOK_PATTERNS.items())])
    rows = rows.select("doc_id", (F.col("i") + 1).alias("line_number"), F.explode(found).alias("x"))
    return rows.select("doc_id", "line_number", F.col("x.m.start").alias("col_bytes"), F.col("x.name").alias("name"), F.col("x.m.value").alias("value"))


#: Lines of a text that are looked at for what may be encoded, and bytes from which they are.
LOOKED_AT, LONG = 100, 20


def content_warnings(docs: DataFrame) -> DataFrame:
    """Files with at least one warning, and the warnings: size, binary contents, what looks like secrets, and the name.

    Of a null content only the name is looked at.
    """
    text, size = F.col("content"), F.octet_length("content")
    nuls = size - F.octet_length(F.replace(text, F.lit("\x00"), F.lit("")))
    highest = W.highest_line_entropy(F.substring_index(text, "\n", LOOKED_AT), LONG)
    encoded = F.coalesce(F.round("_h", 9) > 4.0, F.lit(False))
    found = [(size > L.MAX_CHECKED_BYTES, L.TOO_LARGE), (nuls > F.floor(size / 100), L.BINARY)]
    found += [(text.rlike(r), f"{n} detected in file content") for n, r in L.WARNINGS.items()]
    found += [(encoded, L.ENCODED), (T.any_part(F.lower("file_path"), L.SUSPICIOUS_NAMES), L.SUSPICIOUS)]
    out = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in found]))
    # A condition on what an outer generator makes stays behind it, so that the warnings are worked out once.
    rows = docs.withColumn("_h", highest).select("doc_id", "file_path", F.explode_outer(F.array(out)).alias("w"))
    return rows.where(F.size("w") > 0).select("doc_id", "file_path", F.array_join("w", "; ").alias("warnings"), F.size("w").alias("n_warnings"))


def by_type(found: DataFrame, secret_type: str) -> DataFrame:
    return found.where(F.col("secret_type") == secret_type)


def is_valid_finding() -> Column:
    """Access keys are taken for valid; of other types those of a confidence over 0.8."""
    return F.col("secret_type").isin("AWS Access Key", "GitHub Token") | (F.col("confidence") > 0.8)


def mark_ignored(found: DataFrame, suppressed: DataFrame) -> DataFrame:
    """found with is_ignored: whether (file_path, value) is in the table of suppressed ones, however often."""
    keys = suppressed.select("file_path", "value").distinct().withColumn("_s", F.lit(True))
    return found.join(keys, ["file_path", "value"], "left").withColumn("is_ignored", F.coalesce("_s", F.lit(False))).drop("_s")


def percent(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.bround((value * 100).cast("decimal(20,9)"), digits).cast("double"))


def summary() -> Column:
    """One line that says what was found where."""
    return F.concat(
        F.col("secret_type"), F.lit(" in "), F.col("file_path"), F.lit(" (line "), F.col("line_number").cast("string"), F.lit(", confidence: "),
        percent(F.col("confidence"), 1), F.lit("%)"),
    )


def csv_rows(found: DataFrame) -> DataFrame:
    """The report's columns as text: File, Type, Line, Confidence (of 100, two digits), Value. Writers quote what needs it."""
    return found.select(
        F.col("file_path").alias("File"), F.col("secret_type").alias("Type"), F.col("line_number").cast("string").alias("Line"),
        percent(F.col("confidence"), 2).alias("Confidence"), F.col("value").alias("Value"),
    )


def risk_totals(found: DataFrame) -> DataFrame:
    """One row: all findings, those of high and of medium risk, and the files with any. Zeros where there are none."""
    c = F.col("confidence")
    return found.agg(F.count("*").alias("total"), F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_distinct("file_path").alias("files"))


def scan_status(found: DataFrame) -> DataFrame:
    """One row that says what a scan found."""
    c = F.col("confidence")
    rows = found.agg(F.count("*").alias("total"), F.count_if(c >= 0.7).alias("high"), F.count_if((c >= 0.4) & (c < 0.7)).alias("medium"))
    n = lambda k: F.col(k).cast("string")
    some = F.concat(F.lit("Scan complete: "), n("total"), F.lit(" findings ("), n("high"), F.lit(" high, "), n("medium"), F.lit(" medium confidence)"))
    some = F.concat(some, F.when(F.col("high") > 0, " | High confidence findings require attention!").otherwise(""))
    return rows.withColumn("message", F.when(F.col("total") == 0, "Scan complete: No secrets detected").otherwise(some))


def report(found: DataFrame, options: dict) -> DataFrame:
    """One row for each file with findings: a JSON object of the options, the findings by place, and their counts.

    A report of everything in one object would be one task's; the files' objects are lines of one.
    """
    columns = ["value", "secret_type", "line_number", "column_number", "start_position", "end_position", "confidence", "confidence_level", "severity"]
    one = F.struct("start_position", "end_position", "secret_type", F.struct(*columns).alias("finding"))
    rows = found.groupBy("file_path").agg(F.array_sort(F.collect_list(one)).alias("_f"), F.count("*").alias("total"), F.count_if(F.col("confidence") >= 0.7).alias("high_confidence"))
    echo = F.struct(*[F.lit(v).alias(k) for k, v in options.items()]).alias("options")
    stats = F.struct("total", "high_confidence").alias("stats")
    return rows.select("file_path", F.to_json(F.struct("file_path", echo, F.transform("_f", lambda x: x["finding"]).alias("findings"), stats)).alias("report"))


def json_rows(found: DataFrame) -> DataFrame:
    """One JSON object for each finding."""
    return found.select("doc_id", F.to_json(F.struct(*[c for c in found.columns if c != "doc_id"])).alias("finding"))
