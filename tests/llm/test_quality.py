"""The verdict of the quality rules: votes by plain Python, expectation-maximisation by arrays of all documents."""

import re
from collections import Counter

import numpy as np

from leakdrift.llm import quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOTES = (1, 0, -1)


def plain_votes(text):
    """Votes of a text, or None where the base rules fail."""
    w = WORD.findall(text)
    n, chars = len(w), sum(map(len, w))
    grams = Counter(tuple(w[k : k + 8]) for k in range(n - 7))
    repeated = len({k + i for k in range(n - 7) if grams[tuple(w[k : k + 8])] > 1 for i in range(8)})
    if n < 20 or 100 * repeated > 30 * n:
        return None
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols, marks = len(re.findall(r"[#*$%&|<>]", text)) / n, text.count("!") / n
    capitals, mean = sum(c.isupper() for c in text) / chars, chars / n
    dup = (len(lines) - len(set(lines))) / max(1, len(lines))
    votes = [(False, symbols >= 0.1), (False, repeated / n >= 0.2), (False, dup >= 0.3), (False, capitals >= 0.3), (False, marks >= 0.2)]
    votes.append((3 <= mean <= 10, mean < 2 or mean > 14))
    votes.append((symbols < 0.02 and marks < 0.02 and capitals < 0.1, symbols >= 0.3 or marks >= 0.5))
    return [-1 if no else 1 if yes else 0 for yes, no in votes]


def array_em(v, rounds=50, weight=20.0):
    """Posterior probability of quality of each row of votes."""
    hot = np.stack([v == x for x in VOTES], 2).astype(float)
    post = np.where((v == -1).any(1), 0.1, 0.95)
    good, bad = np.array([0.45, 0.5, 0.05]), np.array([0.2, 0.5, 0.3])
    for _ in range(rounds):
        g = (np.einsum("d,dru->ru", post, hot) + weight * good) / (post.sum() + weight)
        b = (np.einsum("d,dru->ru", 1 - post, hot) + weight * bad) / (len(v) - post.sum() + weight)
        for k, wrong in ((0, g[:, 0] < b[:, 0]), (2, g[:, 2] > b[:, 2])):
            even = (g[:, k] + b[:, k]) / 2
            g[wrong, k], b[wrong, k] = even[wrong], even[wrong]
        share = np.clip(post.mean(), 0.01, 0.99)
        post = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + np.einsum("dru,ru->d", hot, np.log(g / b)))))
    return post


def test_the_verdict_is_that_of_all_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    votes = {i: plain_votes(t) for i, t in texts.items()}
    ids = [i for i, v in votes.items() if v is not None]
    want = dict(zip(ids, array_em(np.array([votes[i] for i in ids])), strict=True))
    got = {r.doc_id: r for r in quality.op8_quality_rules(spark, SF).collect()}
    assert {i for i, r in got.items() if r.base_failed} == {i for i, v in votes.items() if v is None}
    for i, q in want.items():
        assert abs(got[i].quality - q) < 1e-4 and (abs(q - 0.5) < 1e-3 or got[i].kept == (q >= 0.5))


def test_accuracies_are_recovered():
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.7
    right, speaks = np.array([0.9, 0.8, 0.7, 0.85]), np.array([0.9, 0.6, 0.8, 0.5])
    truth = np.where(good, 1, -1)[:, None]
    v = np.where(rng.random((4000, 4)) < speaks, np.where(rng.random((4000, 4)) < right, truth, -truth), 0)
    patterns = sorted(Counter(map(tuple, v.tolist())).items())
    fit = quality.fit_votes(patterns)
    odds = np.array([fit["odds"] + sum(t[x] for t, x in zip(fit["votes"], row, strict=True)) for row in v.tolist()])
    majority = ((v.sum(1) > 0) == good).mean()
    assert ((odds > 0) == good).mean() > max(0.88, majority) and quality.fit_votes([]) == {}
