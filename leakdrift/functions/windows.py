"""Entropy of all windows of a text, from counts of symbols that are moved along a run in place of cutting each window."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leakdrift.functions import library as L
from leakdrift.functions import text as T

#: A window never crosses one of these.
DELIMITERS = r"""[ \t\n\x0b\f\r"'(){}\[\]<>]+"""
MEASURES = "struct<shannon:double,normalized:double,charset:int,likely:boolean,confidence:double>"
FOUND = f"array<struct<text:string,e:{MEASURES}>>"
#: Code points of a run whose counts are held at once, besides a window's length.
STRETCH = 8192


def low_enough(window: str) -> tuple[bool, bool]:
    """Whether a window is prose, and whether it is a common value."""
    low = window.lower()
    return sum(w in low for w in L.COMMON_WORDS) >= 2, any(p in low for p in L.NON_SECRETS)


def run_windows(run: str, shortest: int, longest: int, at: T.Thresholds) -> Iterator[tuple[str, float, float, int, float]]:
    """(window, entropy, normalised, symbols, confidence) of the likely secrets among a run's windows, by length and place.

    The counts of a window are the difference of two running counts, so that a length costs one step for each place and
    symbol; only windows that are sure enough by their numbers become strings.
    """
    codes = np.array([ord(c) for c in run], dtype=np.int64)
    symbols, index = np.unique(codes, return_inverse=True)
    sizes = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
    kinds = np.stack([(codes >= a) & (codes <= b) for a, b in ((97, 122), (65, 90), (48, 57))])
    kinds = np.concatenate([kinds, ~kinds.any(0, keepdims=True)]).astype(np.int64)
    zero = np.zeros(1, dtype=np.int64)
    octets = np.concatenate([zero, np.cumsum(sizes)])
    classes = np.concatenate([np.zeros((4, 1), dtype=np.int64), np.cumsum(kinds, axis=1)], axis=1)
    counts = np.zeros((len(run) + 1, len(symbols)), dtype=np.int32)
    counts[np.arange(1, len(run) + 1), index] = 1
    np.cumsum(counts, axis=0, out=counts)
    for k in range(shortest, min(len(run), longest) + 1):
        size = (octets[k:] - octets[:-k]).astype(np.float64)
        shannon, n = np.zeros(len(size)), np.zeros(len(size), dtype=np.int64)
        for s in range(len(symbols)):
            c = counts[k:, s] - counts[:-k, s]
            some = np.flatnonzero(c)
            p = c[some] / size[some]
            shannon[some] -= p * np.log2(p)
            n[some] += 1
        normal = np.where(n > 1, shannon / np.log2(np.maximum(n, 2).astype(np.float64)), 0.0)
        own = classes[:, k:] - classes[:, :-k]
        kind = (own > 0).sum(0)
        sure = np.minimum(shannon / 6, 0.4) + 0.3 * normal + np.minimum(n / 62, 0.2)
        sure = sure + np.where(size >= 20, 0.1, np.where(size >= 12, 0.05, 0.0)) + np.where(kind >= 3, 0.1, 0.0)
        single = (own[:3] == k).any(0)
        good = (shannon >= at.shannon) & (normal >= at.normalized) & (n >= at.charset) & ~single & (np.minimum(sure, 1.0) > 0.7) & (size >= at.shortest) & (size <= at.longest)
        for i in np.flatnonzero(good).tolist():
            yield run[i : i + k], float(shannon[i]), float(normal[i]), int(n[i]), float(min(1.0, sure[i]))


def text_windows(text: str, shortest: int, longest: int, at: T.Thresholds) -> list[tuple[str, dict]]:
    """Each different window once, the surest first, those that tie by their text."""
    found: dict[str, dict] = {}
    # So many different symbols are needed for the entropy that is asked for.
    fewest = max(at.charset, 2 ** (at.shannon - 1e-9))
    for run in dict.fromkeys(r for r in re.split(DELIMITERS, text) if len(r) >= shortest and len(set(r)) >= fewest):
        # Stretches overlap by what a window can reach, so that each window lies in one.
        for start in range(0, max(1, len(run) - shortest + 1), STRETCH):
            for window, h, normal, n, sure in run_windows(run[start : start + STRETCH + longest - 1], shortest, longest, at):
                if window not in found and not any(low_enough(window)):
                    found[window] = {"shannon": h, "normalized": normal, "charset": n, "likely": True, "confidence": sure}
    return sorted(found.items(), key=lambda x: (-x[1]["confidence"], x[0].encode()))


def secret_windows(text: Column, shortest: int, longest: int, at: T.Thresholds = T.DEFAULT) -> Column:
    """FOUND of a column of texts; null texts have none."""

    @F.pandas_udf(FOUND)
    def windows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"text": w, "e": e} for w, e in text_windows(t, shortest, longest, at)] if t else [] for t in batch], dtype=object)

    return windows(text)


#: Code points that are counted at once, if a value doesn't have more, and counts of symbols that are held at once.
POINTS, CELLS = 200_000, 1_000_000


def entropies(values: list[str]) -> np.ndarray:
    """The Shannon entropy of each value as functions.text.entropy() has it: counts of code points by the bytes, summed in their order."""
    parts, begin, size = [np.zeros(0)], 0, 0
    for i, v in enumerate(values):
        size += len(v)
        if size >= POINTS or i == len(values) - 1:
            parts.append(counted(values[begin : i + 1]))
            begin, size = i + 1, 0
    return np.concatenate(parts)


def counted(values: list[str]) -> np.ndarray:
    """The entropies of values that are held at once."""
    out = np.zeros(len(values))
    codes = np.frombuffer("".join(values).encode("utf-32-le"), dtype=np.uint32)
    if not len(codes):
        return out
    lengths = np.array([len(v) for v in values], dtype=np.int64)
    ends = np.cumsum(lengths)
    seen = np.bincount(codes) > 0
    symbols, index = np.flatnonzero(seen), (np.cumsum(seen) - 1)[codes]
    octets = np.where(symbols < 0x80, 1, np.where(symbols < 0x800, 2, np.where(symbols < 0x10000, 3, 4)))
    n = len(symbols)
    step = max(1, CELLS // n)
    for a in range(0, len(values), step):
        own = lengths[a : a + step]
        first, last = ends[a] - lengths[a], ends[a + len(own) - 1]
        counts = np.bincount(np.repeat(np.arange(len(own)) * n, own) + index[first:last], minlength=len(own) * n).reshape(len(own), n)
        rows, columns = np.nonzero(counts)
        p = counts[rows, columns] / (counts @ octets)[rows]
        out[a : a + len(own)] = -np.bincount(rows, weights=p * np.log2(p), minlength=len(own))
    return out


def many_entropies(text: Column) -> Column:
    """The entropy of each value of a long column, by batches in Python workers: some ten times as fast as in expressions. Null for null."""

    @F.pandas_udf("double")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = batch.notna()
            found = pd.Series(np.nan, index=batch.index, dtype="Float64")
            found[known] = entropies(batch[known].tolist())
            yield found

    return measured(text)


def highest_line_entropy(text: Column, longer: int) -> Column:
    """The highest entropy of a text's lines of more than so many bytes, without carriage returns at their ends; null where there is none."""

    @F.pandas_udf("double")
    def highest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            cut = [[x for x in (y.rstrip("\r") for y in t.split("\n")) if len(x) > longer or len(x.encode()) > longer] if t else [] for t in batch]
            every = entropies([x for lines in cut for x in lines])
            ends = np.cumsum([len(lines) for lines in cut])
            yield pd.Series([float(every[e - len(lines) : e].max()) if lines else None for lines, e in zip(cut, ends, strict=True)], index=batch.index, dtype="Float64")

    return highest(text)
