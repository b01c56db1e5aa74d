"""Periodic runs of words: a suffix automaton whose link tree a link-cut tree recolours with last occurrences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakdrift.llm.common import small_batches, table, words

#: A run has so many words at least, and so many times its period.
LEAST, TIMES = 6, 4

RUNS = "array<struct<start:long,length:long,period:long>>"


class Automaton:
    """The suffix automaton of a sequence of small integers: lengths and suffix links of its states, and prefix states."""

    def __init__(self, seq: list[int], symbols: int) -> None:
        self.length, self.link, self.prefix = [0], [-1], []
        length, link = self.length, self.link
        # One table for all states: state * symbols + symbol to state. What a clone inherits is kept by its symbols.
        to: dict[int, int] = {}
        out: list[list[int]] = [[]]
        last = 0
        for c in seq:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            out.append([])
            p = last
            while p >= 0 and p * symbols + c not in to:
                to[p * symbols + c] = new
                out[p].append(c)
                p = link[p]
            if p >= 0:
                q = to[p * symbols + c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    out.append(list(out[q]))
                    for s in out[q]:
                        to[clone * symbols + s] = to[q * symbols + s]
                    while p >= 0 and to.get(p * symbols + c) == q:
                        to[p * symbols + c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            self.prefix.append(new)
            last = new


class LinkCut:
    """Preferred paths of a tree as splay trees by depth; a path has one colour, kept where its splay tree has its root."""

    def __init__(self, parent: list[int]) -> None:
        n = len(parent)
        #: Parents within a splay tree, or of the whole path where the node is its splay tree's root; -1 at the end.
        self.up = list(parent)
        self.left, self.right = [-1] * n, [-1] * n
        self.colour = [-1] * n

    def splay(self, x: int) -> None:
        """x becomes its splay tree's root, and gets the path's colour."""
        up, left, right = self.up, self.left, self.right
        p = up[x]
        if p < 0 or (left[p] != x and right[p] != x):
            return
        top = p
        while (g := up[top]) >= 0 and (left[g] == top or right[g] == top):
            top = g
        self.colour[x] = self.colour[top]
        while True:
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                self.rotate(p if (left[p] == x) == (left[g] == p) else x)
            self.rotate(x)

    def rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b >= 0:
            up[b] = p
        up[p], up[x] = x, g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def access(self, v: int, colour: int) -> Iterator[tuple[int, int]]:
        """Gives the path from v to the root one colour; yields each colour it had, with the deepest node that had it."""
        up, right, shade = self.up, self.right, self.colour
        last, x = -1, v
        while x >= 0:
            self.splay(x)
            yield shade[x], x
            if right[x] >= 0:
                shade[right[x]] = shade[x]
            right[x] = last
            last, x = x, up[x]
        self.splay(v)
        shade[v] = colour


def runs_of(seq: list[int], symbols: int, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs, by start and then period.

    When the word i is appended, the suffixes on one coloured segment of its path last ended at j, and the longest of
    them has as many words as the prefixes up to i and j have in common at their ends. So the words up to i have the
    period i - j over these and i - j words more, no shorter period fits if that many occurred again, and no word before
    them extends it. A run shows at each of its words from the (least or times * period)-th on; its last one is its end.
    """
    auto = Automaton(seq, symbols)
    tree, length = LinkCut(auto.link), auto.length
    ends: dict[tuple[int, int], int] = {}
    for i, v in enumerate(auto.prefix):
        for j, x in tree.access(v, i):
            if j >= 0:
                d, common = i - j, length[x]
                if common + d >= least and common >= (times - 1) * d:
                    ends[i - d - common + 1, d] = i
    return [(s, e - s + 1, d) for (s, d), e in sorted(ends.items())]


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of at least six words and four periods can be: stretches whose triples of words occur three times.

    In such a run each three neighbouring words stand there again a period later or earlier, three times in all. Words
    outside of these stretches are in no run, so that a text is cut at them and nothing else is left out.
    """
    if len(ids) < LEAST:
        return []
    some = np.int64(ids.max()) + 1
    if some < 2_000_000:
        key = (ids[:-2] * some + ids[1:-1]) * some + ids[2:]
    else:
        pair = np.unique(ids[:-1] * some + ids[1:], return_inverse=True)[1].astype(np.int64)
        key = pair[:-1] * some + ids[2:]
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    step = np.diff(np.concatenate([[0], (n[at] >= TIMES - 1).astype(np.int8), [0]]))
    found = zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)
    return [(s, e + 2) for s, e in found if e + 2 - s >= LEAST]


def text_runs(ws: list[bytes]) -> list[tuple[int, int, int]]:
    """The runs of a text's words."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in ws), dtype=np.int64, count=len(ws))
    out = []
    for s, e in stretches(ids):
        some, seq = np.unique(ids[s:e], return_inverse=True)
        out += [(s + start, n, d) for start, n, d in runs_of(seq.tolist(), len(some))]
    return sorted((s, n, d) for s, n, d in out)


def kept_words(ws: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run contains after its first period, joined by one space."""
    step = np.zeros(len(ws) + 1, dtype=np.int64)
    for s, n, d in runs:
        step[s + d] += 1
        step[s + n] -= 1
    keep = np.cumsum(step[:-1]) == 0 if runs else None
    return b" ".join(ws if keep is None else [w for w, k in zip(ws, keep.tolist(), strict=True) if k]).decode("utf-8", "replace")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_words, runs, collapsed), one row for each row.

    Words are what ASCII white space leaves. `runs` are all maximal stretches of words of a smallest period q that have
    at least six words and four periods, by start and period: array of (start, length, period). `collapsed` has the
    words that no run contains after its first period. Every text is read as a whole; a task holds one text's automaton
    at a time, some 400 bytes for each word that can be in a run. Null and empty texts have no runs and an empty
    collapsed text; repeated rows and null ids are rows of their own; empty tables have none; extra columns, whatever
    their names, are not looked at.
    """
    small_batches(docs.sparkSession)
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from leakdrift.llm.periods import kept_words, text_runs

        for batch in batches:
            sizes, every, kept = [], [], []
            for text in batch["text"].to_pylist():
                ws = (text or "").encode("utf-8", "replace").split()
                runs = text_runs(ws)
                sizes.append(len(ws))
                every.append([{"start": s, "length": n, "period": d} for s, n, d in runs])
                kept.append(kept_words(ws, runs))
            columns = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(every, pa.list_(run)), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    docs = docs.select("doc_id", "text")
    schema = docs.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.array().cast(RUNS).alias("runs"), F.lit("").alias("collapsed")).schema
    return docs.mapInArrow(found, schema)


def planted(text: Column, doc_id: Column) -> Column:
    """Every tenth id's text, its words from one on repeated with a period: both follow from the id's CRC-32."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("long")
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda k: F.get(w, (a + F.pmod(k, p)).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")).otherwise(F.lit(""))

    whole = F.element_at(F.transform(F.array(words(text)), repeated), 1)
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.isNotNull(), whole).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs)
    more = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda b, r: F.when(more(r, b), r).otherwise(b))
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
