"""Toxicity by a classifier chain of linear models over hashed words and word beginnings."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakdrift.llm.common import shuffled_join, small_batches, table

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Features are hashed to so many places.
SPACE_BITS = 20
#: Labelled documents that a model is fitted on at most, those of the smallest hashes of their ids.
SAMPLE = 8_000
#: Features that each category's model sees, those that tell it best.
SELECTED = 256
REMEMBERED = 200_000


def token_features(token: str) -> list[int]:
    """Hashed ids of a lower-case token and of its beginnings of 3 to 6 characters."""
    mask = (1 << SPACE_BITS) - 1
    parts = [b"=" + token.encode("utf-8", "replace")]
    parts += [b"^" + token[:k].encode("utf-8", "replace") for k in range(3, 7) if len(token) > k]
    return [zlib.crc32(p) & mask for p in parts]


def text_features(text: str | None, known: dict[str, list[int]]) -> np.ndarray:
    found: set[int] = set()
    for token in set(TOKEN.findall((text or "").lower())):
        ids = known.get(token)
        if ids is None:
            if len(known) >= REMEMBERED:
                known.clear()
            ids = known[token] = token_features(token)
        found.update(ids)
    return np.fromiter(found, dtype="<u4", count=len(found))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 12) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def telling(docs: list[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
    """Ids of the features whose share of documents differs most between the classes, in standard errors."""
    size = 1 << SPACE_BITS
    in_pos = np.zeros(size)
    in_neg = np.zeros(size)
    for ids, label in zip(docs, y, strict=True):
        (in_pos if label else in_neg)[ids] += 1
    n_pos, n_neg = max(1, y.sum()), max(1, len(y) - y.sum())
    share = (in_pos + in_neg) / (n_pos + n_neg)
    error = np.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_neg)) + 1e-9
    z = np.abs(in_pos / n_pos - in_neg / n_neg) / error
    z[in_pos + in_neg < 3] = 0
    order = np.argsort(-z, kind="stable")[:most]
    return np.sort(order[z[order] > 4.5])


def marked(docs: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Which of the features each document has."""
    place = np.full(1 << SPACE_BITS, -1, dtype=np.int32)
    place[ids] = np.arange(len(ids))
    x = np.zeros((len(docs), len(ids)))
    for k, f in enumerate(docs):
        at = place[f]
        x[k, at[at >= 0]] = 1
    return x


def fit_chain(docs: list[np.ndarray], labels: dict[str, np.ndarray], folds: int = 3, most: int = SELECTED) -> list[dict]:
    """Models of the categories in their order; NaN labels are left out of their category.

    Each model sees its selected features and the probabilities of all earlier categories. For the rows that it is
    trained on these are out-of-fold: from models whose features and weights did not see the row. At scoring they come from the models
    fitted on all rows. A category with one class only gets a model that always says that class.
    """
    fold = np.arange(len(docs)) % folds
    chain: list[dict] = []
    earlier = np.zeros((len(docs), 0))
    for name, y in labels.items():
        known = ~np.isnan(y)
        hard = np.where(known, y, 0).astype(int)
        rows = np.flatnonzero(known)

        def fitted(rows: np.ndarray, hard: np.ndarray = hard, earlier: np.ndarray = earlier) -> tuple[np.ndarray, np.ndarray]:
            """Features chosen and weights fitted on these rows only."""
            ids = telling([docs[k] for k in rows], hard[rows], most) if len(rows) else np.zeros(0, dtype=np.int64)
            if len(rows) == 0 or hard[rows].min() == hard[rows].max():
                w = np.zeros(len(ids) + earlier.shape[1] + 1)
                w[-1] = 30.0 if len(rows) and hard[rows][0] else -30.0
                return ids, w
            return ids, logistic(np.hstack([marked([docs[k] for k in rows], ids), earlier[rows]]), hard[rows])

        out = np.zeros(len(docs))
        for k in range(folds):
            ids, w = fitted(rows[fold[rows] != k])
            own = np.flatnonzero(fold == k)
            out[own] = predict(w, np.hstack([marked([docs[i] for i in own], ids), earlier[own]]))
        ids, w = fitted(rows)
        chain.append({"name": name, "ids": ids, "w": w})
        earlier = np.hstack([earlier, out[:, None]])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE) -> list[dict]:
    """Fits a chain on at most `sample` labelled documents (doc_id, text), chosen by the hash of the id.

    labels may hold an id more than once (the largest label counts) or ids without document (not used).
    """
    marks = labels.where("doc_id is not null").select("doc_id", *[c.cast("double").alias(k) for k, c in categories.items()])
    marks = marks.groupBy("doc_id").agg(*[F.max(k).alias(k) for k in categories])
    # Only ids that have a document, so that no others use up the sample.
    marks = shuffled_join(marks, docs.select("doc_id"), "doc_id", "left_semi")
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @F.pandas_udf("binary")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            yield pd.Series([text_features(t, known).tobytes() for t in batch], dtype=object)

    # Of rows that repeat an id one counts, so that no more rows than ids come to the driver.
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").groupBy("doc_id", *categories).agg(F.min("text").alias("text"))
    rows = rows.select("doc_id", *categories, hashed("text").alias("f"))
    got = sorted(rows.collect(), key=lambda r: (r["doc_id"], bytes(r["f"])))
    features = [np.frombuffer(bytes(r["f"]), dtype="<u4") for r in got]
    values = {k: np.array([np.nan if r[k] is None else r[k] for r in got], dtype=float) for k in categories}
    return fit_chain(features, values)


def scorer(chain: list[dict]):  # noqa: ANN201
    """A column function: text to a struct of each category's probability; null texts are empty."""
    place: dict[int, list[tuple[int, float]]] = {}
    for k, m in enumerate(chain):
        for i, w in zip(m["ids"].tolist(), m["w"][: len(m["ids"])].tolist(), strict=True):
            place.setdefault(i, []).append((k, w))
    tails = [m["w"][len(m["ids"]) :].tolist() for m in chain]
    names = [m["name"] for m in chain]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = np.zeros((len(batch), len(names)))
            for row, text in enumerate(batch):
                hits: set[int] = set()
                for token in set(TOKEN.findall((text or "").lower())):
                    ids = known.get(token)
                    if ids is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        ids = known[token] = tuple(i for i in token_features(token) if i in place)
                    if ids:
                        hits.update(ids)
                sums = [0.0] * len(names)
                for i in sorted(hits):
                    for k, w in place[i]:
                        sums[k] += w
                before: list[float] = []
                for k, tail in enumerate(tails):
                    z = sums[k] + tail[-1] + sum(w * p for w, p in zip(tail, before, strict=False))
                    before.append(1 / (1 + float(np.exp(-min(30.0, max(-30.0, z))))))
                out[row] = before
            yield pd.DataFrame(out, columns=names)

    return score


def categories() -> dict[str, Column]:
    """The chain's order over the table `labels`: unfit writing first, then toxicity."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def with_scores(docs: DataFrame, labels: DataFrame, reject: float = 0.5) -> DataFrame:
    """docs with a struct `scores` of probabilities and `rejected` (toxic at `reject` or more), row by row.

    Null and empty texts are scored as texts without words. Without labelled documents nothing is rejected. Columns of
    docs with these two names are replaced; all others stay. Repeated rows have the same scores, an empty table none.
    """
    small_batches(docs.sparkSession)
    score = scorer(train(docs, labels, categories()))
    found = docs.withColumn("scores", score("text"))
    return found.withColumn("rejected", F.col("scores.toxic") >= reject)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_scores(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", *[F.round(f"scores.{k}", 6).alias(f"p_{k}") for k in categories()], "rejected")
