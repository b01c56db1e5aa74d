"""Column functions on texts and candidate values: spans, entropy, character classes, paths. No Python workers."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakdrift.functions import library as L

SPAN = "array<struct<value:string,start:bigint,end:bigint,line:int,col:int>>"


def let(value: Column, body) -> Column:  # noqa: ANN001
    """Binds a computed value to a lambda variable, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


PLACE = "struct<b:bigint,n:int,t:int>"
#: Parts of a text that are added up at once; their sums are carried from block to block.
BLOCK = 128
#: Matches of a text that are placed one by one at most.
FEW = 8


def extent(text: Column) -> Column:
    """Bytes, newlines and the code points after the last newline of a text."""
    tail = F.length(F.substring_index(text, "\n", -1))
    return F.struct(F.octet_length(text).cast("bigint").alias("b"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("n"), tail.alias("t")).cast(PLACE)


def after(x: Column, y: Column) -> Column:
    """The extent of two texts, one behind the other."""
    tail = F.when(y["n"] > 0, y["t"]).otherwise(x["t"] + y["t"])
    return F.struct((x["b"] + y["b"]).alias("b"), (x["n"] + y["n"]).alias("n"), tail.alias("t")).cast(PLACE)


def running(parts: Column) -> Column:
    """The extents up to and with each part. Costs a block's length for each part, and the parts for each block."""
    zero = F.struct(F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("n"), F.lit(0).alias("t")).cast(PLACE)
    none = F.array().cast(f"array<{PLACE}>")

    def within(k: Column) -> Column:
        block = F.slice(parts, k * BLOCK + 1, F.lit(BLOCK))
        return F.aggregate(block, none, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, after(F.element_at(acc, -1), x)).otherwise(x))))

    def carried(acc: Column, block: Column) -> Column:
        before = F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(zero)
        return F.concat(acc, let(before, lambda z: F.transform(block, lambda x: after(z, x))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), within)
    return F.when(F.size(parts) > 0, F.aggregate(blocks, none, carried)).otherwise(none)


def span(value: Column, place: Column) -> Column:
    """A value where so much comes before it: byte span, 1-based line and code-point column."""
    return F.struct(
        value.alias("value"), place["b"].alias("start"), (place["b"] + F.octet_length(value)).alias("end"), (place["n"] + 1).alias("line"), (place["t"] + 1).alias("col"),
    )


def spans(text: Column, regex: str, group: int = 0, keep=None) -> Column:  # noqa: ANN001
    """All leftmost matches that don't overlap: value, byte span, 1-based line and code-point column.

    With group=2 the regex is (before)(value)after, and value, span and place are the second group's. `keep` is a
    condition on the value. A text of more than a few matches is measured once between them, however many there are. Null
    texts and texts without match have an empty array and cost one search.
    """
    found = let(parts_of(text, regex, group), lambda m: placed(text, m, group, keep)).cast(SPAN)
    return F.when(text.rlike(regex), found).otherwise(F.array().cast(SPAN))


def parts_of(text: Column, regex: str, group: int = 0, *more: Column) -> Column:
    """What spans are made of: the text between the matches, the matches, and with a group what it and the one before it are."""
    pattern = F.lit(regex)
    parts = {"gaps": F.split(text, regex, -1), "whole": F.regexp_extract_all(text, pattern, F.lit(0))}
    if group:
        parts |= {"lead": F.regexp_extract_all(text, pattern, F.lit(1)), "value": F.regexp_extract_all(text, pattern, F.lit(group))}
    return F.struct(*more, *[c.alias(k) for k, c in parts.items()])


def placed(text: Column, m: Column, group: int = 0, keep=None) -> Column:  # noqa: ANN001
    """The spans of parts_of() a text."""
    values = m["value"] if group else m["whole"]
    places = F.sequence(F.lit(0), F.size(values) - 1)
    measured = F.struct(F.transform(m["gaps"], extent).alias("g"), F.transform(m["whole"], extent).alias("w"))
    step = lambda e: lambda i: F.when(i > 0, after(F.get(e["w"], i - 1), F.get(e["g"], i))).otherwise(F.get(e["g"], i))
    ends = let(measured, lambda e: running(F.transform(places, step(e))))

    def one(place: Column, i: Column) -> Column:
        if not group:
            return let(place, lambda p: span(F.get(values, i), p))
        both = F.struct(place.alias("x"), extent(F.coalesce(F.get(m["lead"], i), F.lit(""))).alias("y"))
        return let(both, lambda p: let(after(p["x"], p["y"]), lambda q: span(F.get(values, i), q)))

    def alone(i: Column) -> Column:
        parts = F.concat(F.slice(m["gaps"], 1, i + 1), F.slice(m["whole"], 1, i))
        return let(F.left(text, F.length(F.array_join(parts, ""))), extent)

    some = F.filter(places, lambda i: keep(F.get(values, i))) if keep else places
    # A few values are placed by a pass over the text each, which is short; of many all parts are measured.
    return let(some, lambda s: F.when(F.size(s) <= FEW, F.transform(s, lambda i: one(alone(i), i))).otherwise(let(ends, lambda e: F.transform(s, lambda i: one(F.get(e, i), i)))))


def spans_of_all(text: Column, low: Column, patterns: list[tuple[str, str, tuple[str, ...]]], group: int = 0) -> Column:
    """Tagged spans (seq, name, m) of several patterns (name, regex, strings of which a text with a match has one).

    What is done with matches stands once in the plan, however many patterns there are.
    """

    def parts(k: int, name: str, regex: str, needs: tuple[str, ...]) -> Column:
        some = text.rlike(regex)
        if needs:
            some = reduce(lambda a, b: a | b, [low.contains(x) for x in needs]) & some
        return F.when(some, parts_of(text, regex, group, F.lit(k).alias("seq"), F.lit(name).alias("name")))

    every = F.array_compact(F.array(*[parts(k, *p) for k, p in enumerate(patterns)]))
    tagged = lambda m: F.transform(placed(text, m, group).cast(SPAN), lambda s: F.struct(m["seq"].alias("seq"), m["name"].alias("name"), s.alias("m")))
    return F.flatten(F.transform(every, tagged))


def word_spans(text: Column, word: str, radius: int) -> Column:
    """Every occurrence of a word in any case, overlapping ones too: its surroundings of `radius` code points and their span.

    The text is cut before each occurrence, and measured between the beginnings of the surroundings, once in all.
    """
    regex = f"(?i)(?={re.escape(word)})" if word.isascii() else f"(?iu)(?={re.escape(word)})"
    k = len(word)

    def placed(pieces: Column) -> Column:
        # The occurrences are the beginnings of all pieces, but the first's only where the text begins with the word.
        first = F.when(text.rlike(f"\\A{regex}"), 0).otherwise(1)
        places = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: i >= first)
        last = lambda s, n: F.substr(s, F.greatest(F.length(s) - n + 1, F.lit(1)))
        heads, tails = F.transform(pieces, lambda p: F.left(p, F.lit(k + radius))), F.transform(pieces, lambda p: last(p, F.lit(radius)))

        def surroundings(cut: Column) -> Column:
            def one(i: Column) -> Column:
                back = F.greatest(i - radius, F.lit(0))
                before = F.when(i > 0, last(F.array_join(F.slice(cut["tails"], back + 1, i - back), ""), F.lit(radius))).otherwise(F.lit(""))
                inside = F.left(F.array_join(F.slice(cut["heads"], i + 1, F.lit(k + radius)), ""), F.lit(k + radius))
                return F.struct(before.alias("before"), F.concat(before, inside).alias("all"), i.alias("i"))

            return F.transform(places, one)

        def spanned(found: Column) -> Column:
            def gap(x: Column, j: Column) -> Column:
                past = F.when(j > 0, F.concat(F.get(found, j - 1)["before"], F.get(pieces, x["i"] - 1))).otherwise(F.when(x["i"] > 0, F.get(pieces, F.lit(0))).otherwise(F.lit("")))
                return extent(let(past, lambda p: F.left(p, F.length(p) - F.length(x["before"]))))

            return let(running(F.transform(found, gap)), lambda ends: F.transform(found, lambda x, j: span(x["all"], F.get(ends, j))))

        cut = let(F.struct(heads.alias("heads"), tails.alias("tails")), surroundings)
        return let(cut, spanned)

    found = let(F.split(text, regex, -1), placed).cast(SPAN)
    return F.when(text.rlike(regex), found).otherwise(F.array().cast(SPAN))


def entropy(value: Column) -> Column:
    """Shannon entropy: shares are counts of code points by the length in bytes, summed in code-point order."""
    chars = F.array_sort(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")))
    size = F.octet_length(value).cast("double")

    def add(acc: Column, c: Column) -> Column:
        p = (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / size
        return acc - p * F.log2(p)

    return F.aggregate(chars, F.lit(0.0), add)


def charset_size(value: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")))


def normalized_entropy(shannon: Column, charset: Column) -> Column:
    return F.when(charset > 1, shannon / F.log2(charset.cast("double"))).otherwise(F.lit(0.0))


def class_count(value: Column) -> Column:
    """How many of lower case, upper case, digit and other there are."""
    return reduce(lambda a, b: a + b, [value.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")])


def any_part(value: Column, parts: list[str]) -> Column:
    return value.rlike("|".join(re.escape(p) for p in parts))


def count_parts(value: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [value.contains(p).cast("int") for p in parts])


def natural_language(value: Column) -> Column:
    return count_parts(F.lower(value), L.COMMON_WORDS) >= 2


@dataclass(frozen=True)
class Thresholds:
    """What a value must have at least to be a likely secret; longer or shorter ones in bytes aren't looked at."""

    shortest: int = 8
    longest: int = 1000
    shannon: float = 3.5
    normalized: float = 0.6
    charset: int = 8


# The three presets.
DEFAULT = Thresholds()
API_KEYS = Thresholds(10, 200, 4.0, 0.7, 10)
TOKENS = Thresholds(20, 500, 4.5, 0.75, 16)


def likely_secret(value: Column, shannon: Column, normal: Column, charset: Column, at: Thresholds = DEFAULT) -> Column:
    """The thresholds, and neither prose, nor one kind of character, nor a common value."""
    single = value.rlike(r"\A([0-9]*|[A-Z]*|[a-z]*)\z")
    common = any_part(F.lower(value), L.NON_SECRETS)
    enough = (shannon >= at.shannon) & (normal >= at.normalized) & (charset >= at.charset)
    return enough & ~natural_language(value) & ~single & ~common


def entropy_confidence(value: Column, shannon: Column, normal: Column, charset: Column) -> Column:
    """How sure the entropy alone makes of a value: by entropy, alphabet, length and classes; less for prose and common values."""
    n, k = F.octet_length(value), class_count(value)
    sure = F.least(shannon / 6, F.lit(0.4)) + 0.3 * normal + F.least(charset / 62, F.lit(0.2))
    sure = sure + F.when(n >= 20, 0.1).when(n >= 12, 0.05).otherwise(0.0) + F.when(k >= 3, 0.1).otherwise(0.0)
    sure = sure - F.when(natural_language(value), 0.3).otherwise(0.0) - F.when(any_part(F.lower(value), L.NON_SECRETS), 0.4).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))


def analyse(value: Column, at: Thresholds = DEFAULT) -> Column:
    """(shannon, normalized, charset, likely, confidence) of a value; zeros and false outside the lengths and for null."""

    def struct(h: Column, normal: Column, charset: Column, likely: Column, sure: Column) -> Column:
        named = zip(("shannon", "normalized", "charset", "likely", "confidence"), (h, normal, charset, likely, sure), strict=True)
        return F.struct(*[c.alias(k) for k, c in named])

    def full(x: Column) -> Column:
        normal = normalized_entropy(x["h"], x["n"])
        return struct(x["h"], normal, x["n"], likely_secret(value, x["h"], normal, x["n"], at), entropy_confidence(value, x["h"], normal, x["n"]))

    none = struct(F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(False), F.lit(0.0))
    measured = let(F.struct(entropy(value).alias("h"), charset_size(value).alias("n")), full)
    return F.when(F.octet_length(value).between(at.shortest, at.longest), measured).otherwise(none)


def sequential(value: Column) -> Column:
    """At least 4 code points that all rise, or all fall, by one."""
    n = F.length(value)
    steps = F.transform(F.sequence(F.lit(2), n), lambda i: F.ascii(F.substr(value, i, F.lit(1))) - F.ascii(F.substr(value, i - 1, F.lit(1))))
    return F.when(n >= 4, F.forall(steps, lambda d: d == 1) | F.forall(steps, lambda d: d == -1)).otherwise(F.lit(False))


def false_positive(value: Column) -> Column:
    same = (F.octet_length(value) >= 8) & value.rlike(r"(?s)\A(.)\1*\z")
    return any_part(F.lower(value), L.FALSE_PARTS) | same | sequential(value)


def truncated(value: Column) -> Column:
    return F.when(F.octet_length(value) > 50, F.concat(F.left(value, F.lit(47)), F.lit("..."))).otherwise(value)


def level(confidence: Column) -> Column:
    return (
        F.when(confidence < 0.3, "VeryLow").when(confidence < 0.5, "Low").when(confidence < 0.7, "Medium")
        .when(confidence < 0.9, "High").otherwise("VeryHigh")
    )


def severity(secret_type: Column) -> Column:
    pairs = [F.lit(x) for kv in L.SEVERITY.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), secret_type), F.lit(5))


def extension(path: Column) -> Column:
    """Lower-case extension of the file's name; '' where it has none, as `.env`."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^.+\.([^.]*)$", 1))


def skip_reason(path: Column, size: Column) -> Column:
    """Why the walk leaves a file out; null where it is scanned."""
    ext = extension(path)
    chain = F.when(size > L.MAX_FILE_BYTES, F.concat(F.lit("File too large: "), size.cast("string"), F.lit(" bytes")))
    chain = chain.when(ext.isin(L.EXCLUDED_EXTENSIONS), F.concat(F.lit("Extension in exclude list: "), ext))
    for part in L.EXCLUDED_PARTS:
        chain = chain.when(F.lower(path).contains(part), f"Path contains excluded component: {part}")
    return chain


def adjusted(base: Column, value: Column, context: Column) -> Column:
    """Less for words of tests and for comments, more for words of configurations; within 0 and 1."""
    low, own = F.lower(context), F.lower(value)
    out = base
    for w in L.TEST_WORDS:
        out = out - F.when(low.contains(w) | own.contains(w), 0.2).otherwise(0.0)
    out = out - F.when(context.rlike(r"\A\s*(//|#|/\*)"), 0.1).otherwise(0.0)
    for w in L.CONFIG_WORDS:
        out = out + F.when(low.contains(w), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def pattern_adjusted(name: Column, base: Column, value: Column, context: Column) -> Column:
    """The confidence of a pattern's match by the pattern's own words; an option, which the scan doesn't use by itself."""
    low, own = F.lower(context), F.lower(value)
    out = base
    for pattern, words in L.CONTEXT_WORDS.items():
        for w in words:
            out = out + F.when((name == pattern) & low.contains(w), 0.1).otherwise(0.0)
    for pattern, words in L.IGNORE_WORDS.items():
        for w in words:
            out = out - F.when((name == pattern) & (low.contains(w) | own.contains(w)), 0.2).otherwise(0.0)
    out = out - F.when(any_part(own, L.NO_SECRET_WORDS), 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def composite(adjusted_base: Column, value: Column, shannon: Column, path: Column) -> Column:
    """The confidence of a finding: entropy, length, classes, kind of file and false positives as factors, in order."""
    n, k, ext = F.octet_length(value), class_count(value), extension(path)
    has_ext = F.substring_index(path, "/", -1).rlike(r"^.+\.[^.]*$")
    out = adjusted_base * F.when((shannon > 0) & (shannon < 2.5), 0.7).when(shannon > 4.5, 1.1).otherwise(1.0)
    out = out * F.when(n < 8, 0.6).when((n > 40) & (n < 100), 1.05).when(n > 200, 0.8).otherwise(1.0)
    out = out * F.when(k >= 3, 1.1).when(k == 1, 0.7).otherwise(1.0)
    kind = F.when(~has_ext, 1.0).when(ext.isin(L.CONFIG_EXTENSIONS), 1.2).when(ext.isin(L.SOURCE_EXTENSIONS), 1.0)
    out = out * kind.when(ext.isin(L.DOC_EXTENSIONS), 0.7).when(path.contains("test"), 0.5).otherwise(1.0)
    out = out * F.when(false_positive(value), 0.3).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def human_size(size: Column) -> Column:
    """Bytes in the largest unit of 1024 that isn't under 1; ties of the one decimal go to the even digit."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        part = F.bround(size.cast("decimal(38,0)") / F.lit(1024**k).cast("decimal(20,0)"), 1)
        out = F.when(size >= 1024**k, F.concat(F.format_string("%.1f", part.cast("double")), F.lit(f" {unit}"))).otherwise(out)
    return out


def rounded(score: Column) -> Column:
    """Six digits; 0.51 keeps decimal ties, which scores are full of, off the boundary."""
    return F.floor(score * 1e6 + 0.51) / 1e6


def base64_of(value: Column) -> Column:
    """Base64 in one line; Spark's own breaks it after 76 characters."""
    return F.translate(F.base64(value), "\r\n", "")
