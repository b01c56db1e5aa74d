"""Quality rules under weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakdrift.llm.common import let, table, words, written

#: Windows of so many words count as repeated.
WINDOW = 8


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the array of word hashes, each word once."""
    starts = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - window),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]),
    )

    def covered(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = let(
            pairs,
            lambda p: F.filter(
                p,
                lambda x, i: F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False)),
            ),
        )
        places = F.sort_array(F.transform(same, lambda x: x["i"]))
        return let(
            places,
            lambda at: F.aggregate(
                F.transform(at, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - x, F.lit(window)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    zero = F.lit(0).cast("long")
    return F.when(F.size(hashes) <= window, zero).otherwise(
        let(starts, lambda s: F.when(F.size(F.array_distinct(s)) == F.size(s), zero).otherwise(covered(s)))
    )


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to the base counts of each document, over its whole text; null texts have none.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as the operator's contract has them, and for the
    rules n_lines (with a word), n_upper (capital letters) and n_marks (exclamation marks).
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    one = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("w"), lines.alias("lines"))
    one = one.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_marks"),
        let(F.transform("w", lambda x: F.xxhash64(x)), lambda h: repeated_words(h)).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return one.withColumn("base_failed", failed)


def rules() -> dict[str, tuple[Column | None, Column]]:
    """Each rule: when it votes for quality (None: never) and when against; otherwise it abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1).cast("long"))
    symbols, marks = F.col("n_symbols") / n, F.col("n_marks") / n
    capitals = F.col("n_upper") / F.greatest("word_chars", F.lit(1).cast("long"))
    lines = F.greatest("n_lines", F.lit(1).cast("long"))
    mean = F.col("word_chars") / n
    return {
        "symbols": (None, symbols >= 0.1),
        "repeats": (None, F.col("n_repeat_words") / n >= 0.2),
        "dup_lines": (None, F.col("n_dup_lines") / lines >= 0.3),
        "capitals": (None, capitals >= 0.3),
        "marks": (None, marks >= 0.2),
        "word_length": ((mean >= 3) & (mean <= 10), (mean < 2) | (mean > 14)),
        "prose": ((symbols < 0.02) & (marks < 0.02) & (capitals < 0.1), (symbols >= 0.3) | (marks >= 0.5)),
    }


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, weight: float = 20.0) -> dict:
    """Expectation-maximisation over the counted vote patterns, of which there are 3 ** rules at most.

    Estimates the share of good documents and, for each rule, how often it votes for, against or abstains on good
    and on bad documents, given the class independently of the others. Starts from the votes themselves: any vote
    against makes a bad document likely. Pseudo-votes of the given weight (bad documents draw votes against, good
    ones don't) keep rules that hardly vote from extremes; a rule that comes out the wrong way round is evened out.
    """
    total = sum(n for _, n in patterns)
    if not total:
        return {}
    post = {v: 0.1 if -1 in v else 0.95 for v, _ in patterns}
    prior_good, prior_bad = {1: 0.45, 0: 0.5, -1: 0.05}, {1: 0.2, 0: 0.5, -1: 0.3}
    fit: dict = {}
    for _ in range(rounds):
        good = sum(n * post[v] for v, n in patterns)
        tables = []
        for j in range(len(patterns[0][0])):
            g, b = {}, {}
            for x in (1, 0, -1):
                ng = sum(n * post[v] for v, n in patterns if v[j] == x)
                nb = sum(n * (1 - post[v]) for v, n in patterns if v[j] == x)
                g[x] = (ng + weight * prior_good[x]) / (good + weight)
                b[x] = (nb + weight * prior_bad[x]) / (total - good + weight)
            for x, wrong in ((1, g[1] < b[1]), (-1, g[-1] > b[-1])):
                if wrong:
                    g[x] = b[x] = (g[x] + b[x]) / 2
            tables.append({x: round(math.log(g[x] / b[x]), 9) for x in (1, 0, -1)})
        share = min(0.99, max(0.01, good / total))
        new = {"odds": round(math.log(share / (1 - share)), 9), "votes": tables}
        if new == fit:
            break
        fit = new
        for v, _ in patterns:
            odds = fit["odds"] + sum(t[x] for t, x in zip(tables, v, strict=True))
            post[v] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return fit


def posterior(fit: dict, names: list[str]) -> Column:
    """Probability of quality from the votes, under the fitted share and vote tables."""
    odds = F.lit(fit.get("odds", 0.0))
    for k, t in zip(names, fit.get("votes", []), strict=False):
        odds = odds + F.when(F.col(k) == 1, t[1]).when(F.col(k) == -1, t[-1]).otherwise(t[0])
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """(doc_id, text) to counts, votes, posterior `quality` and `kept`, a row for each row.

    kept is false where the base rules fail and else says whether the posterior is at least `keep`. Empty and
    null texts fail the base rules. Rows that repeat get the same verdict. Extra columns are not looked at.
    """
    found = written(measures(docs))
    votes = rules()
    names = list(votes)
    voted = found.select("*", *[F.when(no, -1).when(F.lit(False) if yes is None else yes, 1).otherwise(0).alias(k) for k, (yes, no) in votes.items()])
    patterns = voted.where("not base_failed").groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names)
    fit = fit_votes([(tuple(row)[:-1], row["n"]) for row in patterns.collect()])
    voted = voted.withColumn("quality", posterior(fit, names))
    return voted.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*base, F.round("quality", 6).alias("quality"))
