"""Near-duplicate documents: MinHash bands find candidates, odd sketches rank them, full sets confirm links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakdrift.llm.common import connected_components, least_of_component, shuffled_join, sized_semi_join, small_batches, table, with_hubs, with_links, written

#: MinHash samples; BANDS * ROWS of them make the bands. At a similarity of 0.8 a pair shares no band with
#: probability (1 - 0.8 ** 4) ** 28 = 4e-7.
SAMPLES, BANDS, ROWS = 128, 28, 4
#: Bits of an odd sketch.
BITS = 512
#: Pairs whose sketches say less than this are no candidates: at a similarity of 0.8 the estimate's standard
#: error over 128 samples is 0.04 with the folding, so 0.6 is five of them below.
FLOOR = 0.6
#: Documents of a bucket that one task compares at once.
CHUNK = 1024
#: Buckets of so many documents at most are compared together, and rows that one call compares, about.
SMALL, FRAME = 48, 16_384
#: The same where the rows have their documents' full sets.
FULL_FRAME = 4096

#: Words whose hashes a task remembers: some 120 bytes each.
REMEMBERED = 200_000

FEATURES = "n_shingles long, f1 long, f2 long, bands array<int>, sketch binary"


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, width: int, known: Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `width` words, lower-cased in A-Z; shorter texts are one shingle."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter((known[w] for w in ws), dtype=np.uint64, count=len(ws))
    k = min(width, len(h))
    s = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(s)


def fingerprint(s: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of a set, as signed integers."""
    with np.errstate(over="ignore"):
        sums = [s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s ^ np.uint64(77))) if len(s) else np.uint64(0)]
    return np.array(sums, dtype=np.uint64).view(np.int64)


def minhashes(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    low = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(s), 2048):
        np.minimum(low, (s[k : k + 2048, None] * factors).min(0), out=low)
    return low


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: each flips the bit that its place and value hash to."""
    at = mix64(low ^ mix64(np.arange(len(low), dtype=np.uint64))) % np.uint64(BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8))


def estimate(flips: np.ndarray) -> np.ndarray:
    """Similarity from the population count of two sketches' XOR."""
    share = np.minimum(2 * flips / BITS, 0.999)
    return 1 + np.log(1 - share) * BITS / (4 * SAMPLES)


def featured(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text) to doc_id, set size, 128-bit fingerprint of the set, band keys and odd sketch."""
    factors = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)

    @F.pandas_udf(FEATURES)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Words()
        for batch in batches:
            rows = []
            for text in batch:
                s = shingle_set(text, width, known)
                low = minhashes(s, factors)
                with np.errstate(over="ignore"):
                    keys = low[: BANDS * ROWS].reshape(BANDS, ROWS)
                    band = np.zeros(BANDS, dtype=np.uint64)
                    for k in range(ROWS):
                        band = mix64(band * np.uint64(31) + keys[:, k])
                signed = fingerprint(s)
                rows.append((len(s), signed[0], signed[1], (band >> np.uint64(32)).astype(np.uint32).view(np.int32), odd_sketch(low).tobytes()))
            yield pd.DataFrame(rows, columns=["n_shingles", "f1", "f2", "bands", "sketch"])

    return docs.select("doc_id", of("text").alias("f")).select("doc_id", "f.*")


def load(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, band keys and sketches (as 64-bit words) of a group's rows."""
    sketch = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint64).reshape(len(rows), -1)
    return rows["rep"].to_numpy(), np.stack(rows["bands"].to_numpy()), sketch


def candidates(band: int, bands: tuple[np.ndarray, np.ndarray], sketches: tuple[np.ndarray, np.ndarray], allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (of the left and right side) that may be similar, and the estimates; pairs of an earlier common band are left to it."""
    out = []
    for k in range(0, len(bands[0]), 256):
        flips = np.zeros((min(256, len(bands[0]) - k), len(bands[1])), dtype=np.int64)
        for w in range(sketches[0].shape[1]):
            flips += np.bitwise_count(sketches[0][k : k + 256, w, None] ^ sketches[1][None, :, w])
        good = estimate(flips) >= FLOOR
        if allowed is not None:
            good &= allowed[k : k + 256]
        r, c = np.nonzero(good)
        if band and len(r):
            first = ~np.concatenate([(bands[0][k + r[q : q + 65536], :band] == bands[1][c[q : q + 65536], :band]).any(1) for q in range(0, len(r), 65536)])
            r, c = r[first], c[first]
        out.append((k + r, c, estimate(flips[r, c])))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


PAIRS = "a long, b long"


def runs(rows: pd.DataFrame, key: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The rows sorted by the key and rep, and where each key's run starts and ends."""
    rows = rows.sort_values([*key, "rep"], kind="stable").reset_index(drop=True)
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[key].to_numpy()[1:] != rows[key].to_numpy()[:-1]).any(1)
    start = np.flatnonzero(new)
    return rows, start, np.append(start[1:], len(rows))


def small_pairs(start: np.ndarray, size: np.ndarray, band: np.ndarray, bands: np.ndarray, sketch: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates of many small buckets at once: bucket, both rows and estimate, of rows in different components."""
    for s in np.unique(size):
        x, y = np.triu_indices(int(s), 1)
        own = np.flatnonzero(size == s)
        step = max(1, 200_000 // max(1, len(x)))
        for k in range(0, len(own), step):
            at = own[k : k + step]
            r, c = (start[at][:, None] + x).ravel(), (start[at][:, None] + y).ravel()
            bucket = np.repeat(at, len(x))
            some = comp[r] != comp[c]
            r, c, bucket = r[some], c[some], bucket[some]
            est = estimate(np.bitwise_count(sketch[r] ^ sketch[c]).astype(np.int64).sum(1))
            some = est >= FLOOR
            r, c, bucket, est = r[some], c[some], bucket[some], est[some]
            before = (bands[r] == bands[c]) & (np.arange(bands.shape[1]) < band[r][:, None])
            some = ~before.any(1)
            yield bucket[some], r[some], c[some], est[some]


def kruskal(bucket: np.ndarray, r: np.ndarray, c: np.ndarray, est: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Which of the pairs make the maximum spanning forest of each bucket's components."""
    root: dict[tuple[int, int], tuple[int, int]] = {}

    def find(x: tuple[int, int]) -> tuple[int, int]:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    order = np.argsort(-est, kind="stable")
    for k, b, p, q in zip(order.tolist(), bucket[order].tolist(), comp[r[order]].tolist(), comp[c[order]].tolist(), strict=True):
        x, y = find((b, p)), find((b, q))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append(k)
    return np.array(out, dtype=np.int64)


def found_in(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates of sorted rows' buckets (band, value, chunk): bucket, both rows and estimate, of different components."""
    rows, start, end = rows
    _, bands, sketch = load(rows)
    comp, band, size = rows["comp"].to_numpy(), rows["band"].to_numpy(), end - start
    small = size <= SMALL
    yield from small_pairs(start, np.where(small, size, 0), band, bands, sketch, comp)
    for k in np.flatnonzero(~small):
        at = slice(start[k], end[k])
        own = comp[at]
        allowed = np.triu(own[:, None] != own[None, :], 1)
        r, c, est = candidates(int(band[start[k]]), (bands[at], bands[at]), (sketch[at], sketch[at]), allowed)
        yield np.full(len(r), k), start[k] + r, start[k] + c, est


def forests(rows: pd.DataFrame) -> pd.DataFrame:
    """The maximum spanning forest of each bucket's estimates: fewer pairs than documents."""
    rows = runs(rows, ["band", "value", "chunk"])
    ids, comp = rows[0]["rep"].to_numpy(), rows[0]["comp"].to_numpy()
    found = [tuple(v[kruskal(*f, comp)] for v in f) for f in found_in(rows)]
    r, c = (np.concatenate([f[i] for f in found]) for i in (1, 2))
    return pd.DataFrame({"a": ids[r], "b": ids[c]}).drop_duplicates()


class Joined:
    """Links that join components, found among candidates by their full sets, the likeliest first."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.root: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.root.setdefault(x, x) != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def alike(self, p: np.ndarray, q: np.ndarray) -> bool:
        n, m = len(p), len(q)
        if 100 * min(n, m) < self.percent * max(n, m):
            return False
        both = len(np.intersect1d(p, q, assume_unique=True))
        return 100 * both >= self.percent * (n + m - both)

    def add(self, rows: pd.DataFrame, r: np.ndarray, c: np.ndarray, est: np.ndarray) -> None:
        ids, comp = rows["rep"].to_numpy(), rows["comp"].to_numpy()
        sets = [np.frombuffer(s, dtype=np.uint64) for s in rows["s"]]
        order = np.argsort(-est, kind="stable")
        for p, q in zip(r[order].tolist(), c[order].tolist(), strict=True):
            x, y = self.find(int(comp[p])), self.find(int(comp[q]))
            if x != y and self.alike(sets[p], sets[q]):
                self.root[max(x, y)] = min(x, y)
                self.links.append((int(ids[p]), int(ids[q])))

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(self.links, columns=["a", "b"], dtype="int64")


def joining(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """All candidates of buckets between components, held against the full sets where they are: links only leave."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows, start, end = runs(rows, ["band", "value", "chunk"])
        joined = Joined(percent)
        for _, r, c, est in found_in((rows, start, end)):
            joined.add(rows, r, c, est)
        return joined.frame()

    return work


def crossing(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The same for pairs of two chunks' documents, of many pairs of chunks (band, value, ours, theirs)."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows, start, end = runs(rows, ["band", "value", "ours", "theirs"])
        all_ids, all_bands, all_sketch = load(rows)
        everything = {k: rows[k].to_numpy() for k in ("band", "comp", "minor", "left", "right")}
        joined = Joined(percent)
        for k in range(len(start)):
            at = slice(start[k], end[k])
            ids, bands, sketch = all_ids[at], all_bands[at], all_sketch[at]
            band, comp, minor, is_left, is_right = (v[at] for v in everything.values())
            left, right = np.flatnonzero(is_left), np.flatnonzero(is_right)
            if len(left) and len(right):
                allowed = (comp[left, None] != comp[None, right]) & ~(minor[None, right] & (ids[left, None] >= ids[None, right]))
                r, c, est = candidates(int(band[0]), (bands[left], bands[right]), (sketch[left], sketch[right]), allowed)
                joined.add(rows, start[k] + left[r], start[k] + right[c], est)
        return joined.frame()

    return work


def in_frames(rows: DataFrame, key: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], size: int) -> DataFrame:
    """Deals the keys to frames of about `size` rows by a hash, so that a call of `work` has many small keys."""
    rows = written(rows)
    n = max(1, -(-rows.count() // size))
    return rows.groupBy(F.pmod(F.xxhash64(*key), F.lit(n)).alias("frame")).applyInPandas(lambda frame: work(frame), PAIRS)


KEY = ["n_shingles", "f1", "f2"]


def full_sets(reps: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(rep, s): the full sets of the classes, sorted, as bytes, made again from a text that has the class's fingerprint.

    Several texts can have a class's least id; those of other classes are left out by their fingerprints.
    """

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words()
        for batch in batches:
            found = [shingle_set(t, width, known) for t in batch["text"]]
            signed = np.array([fingerprint(s) for s in found], dtype=np.int64).reshape(-1, 2)
            out = {"doc_id": batch["doc_id"], "s": [s.tobytes() for s in found], "n_shingles": [len(s) for s in found], "f1": signed[:, 0], "f2": signed[:, 1]}
            yield pd.DataFrame(out)

    wanted = shuffled_join(classes, reps, "rep", "left_semi").select("rep", F.col("least").alias("doc_id"), *KEY)
    # No null id has a class. Of a function over batches no condition is moved before the join, as it is of a column's.
    found = sized_semi_join(docs.select("doc_id", "text"), wanted.select("doc_id").distinct(), "doc_id")
    found = found.mapInPandas(sets, "doc_id long, s binary, n_shingles long, f1 long, f2 long")
    return shuffled_join(found, wanted, ["doc_id", *KEY]).dropDuplicates(["rep"]).select("rep", "s")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    need = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    full = written(full_sets(need, classes, docs, width))
    one = shuffled_join(pairs, full.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a")
    one = shuffled_join(one, full.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    return written(one.where(alike("sa", "sb")).select("a", "b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, component_id, kept), one row for each row.

    Documents with equal sets are one class, which a number stands for. Classes that share a band meet in
    buckets; a bucket's odd sketches are compared in blocks, and its maximum spanning forest of estimates is
    confirmed on full sets. What is confirmed makes components. A second forest joins the components of buckets
    that were too large for one block, by some documents of each; then every candidate pair that still lies in two
    components is held against the full sets where the pair is found, so that no link is lost which could change a
    component, only such links leave a task, and no group is expanded into all its pairs. Texts without words are linked with nothing. Rows that share a doc_id count as documents
    of their own with a common id; a null id is linked with nothing. Extra columns are not looked at.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    found = written(featured(docs, width))
    real = found.where("n_shingles > 0 and doc_id is not null")
    # Numbers are fixed once they are written.
    first = [F.first(c).alias(c) for c in ("bands", "sketch")]
    grouped = real.groupBy(*KEY).agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *first)
    classes = written(grouped.withColumn("rep", F.monotonically_increasing_id()))
    reps = classes.select("rep", "bands", "sketch")
    slots = reps.select("rep", F.posexplode("bands").alias("band", "value"))
    full = slots.groupBy("band", "value").agg(F.count("*").alias("size")).where("size > 1")
    slots = shuffled_join(slots, full, ["band", "value"]).withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    slots = written(slots.withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks").cast("int")).drop("size"))
    members = written(shuffled_join(reps, slots.select("rep").distinct(), "rep", "left_semi"))

    def labelled(parts: DataFrame | None) -> DataFrame:
        if parts is None:
            return slots.withColumn("comp", F.col("rep"))
        return shuffled_join(slots, parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")

    def open_buckets(rows: DataFrame) -> DataFrame:
        """The rows of buckets that hold more than one component."""
        mixed = rows.groupBy("band", "value").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("band", "value")
        return shuffled_join(rows, mixed, ["band", "value"], "left_semi")

    # Forests within chunks.
    bucket = ["band", "value", "chunk"]
    pairs = in_frames(shuffled_join(labelled(None), members, "rep"), bucket, forests, FRAME)
    links = confirmed(written(pairs.distinct()), classes, docs, width, percent)
    # Forests over some documents of each component, for buckets of more than one chunk.
    parts, large = connected_components(links), not slots.where("chunks > 1").isEmpty()
    if large:
        rows = open_buckets(labelled(parts).where("chunks > 1"))
        turn = F.row_number().over(Window.partitionBy("band", "value", "chunk", "comp").orderBy(F.xxhash64("rep")))
        rows = rows.withColumn("turn", turn).where(F.col("turn") <= 8)
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("comp", "turn"), F.ceil(F.col("chunks") / 8).cast("int")))
        pairs = in_frames(shuffled_join(rows, members, "rep"), bucket, forests, FRAME)
        parts = connected_components(with_links(parts, confirmed(written(pairs.distinct()), classes, docs, width, percent)))
    # Everything that still lies in different components: what isn't in a bucket's largest one meets all others.
    rows = written(open_buckets(labelled(parts)))
    full = full_sets(rows.select("rep").distinct(), classes, docs, width)
    members = written(shuffled_join(members, full, "rep"))
    whole = in_frames(shuffled_join(rows.where("chunks = 1"), members, "rep"), bucket, joining(percent), FULL_FRAME)
    if large:
        rows = rows.where("chunks > 1")
        sizes = rows.groupBy("band", "value", "comp").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("band", "value").agg(F.max_by("comp", F.struct("n", "comp")).alias("big"))
        rows = shuffled_join(rows, largest, ["band", "value"]).withColumn("minor", F.col("comp") != F.col("big"))
        minors = rows.where("minor").groupBy("band", "value").agg(F.collect_set("chunk").alias("ours"))
        right = shuffled_join(rows, minors, ["band", "value"]).withColumn("ours", F.explode("ours"))
        right = right.select("band", "value", "ours", F.col("chunk").alias("theirs"), "rep", "comp", "minor", F.lit(False).alias("left"), F.lit(True).alias("right"))
        left = rows.where("minor").withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        left = left.select("band", "value", F.col("chunk").alias("ours"), "theirs", "rep", "comp", "minor", F.lit(True).alias("left"), F.lit(False).alias("right"))
        pairs = in_frames(shuffled_join(left.unionByName(right), members, "rep"), ["band", "value", "ours", "theirs"], crossing(percent), FULL_FRAME)
        whole = whole.unionByName(pairs)
    links = written(whole)
    if not links.isEmpty():
        parts = connected_components(with_links(parts, links))
    n_rows = real.count()
    names = classes.select(F.col("rep").alias("node"), "least")
    parts = least_of_component(written(parts), names, n_rows).withColumnRenamed("node", "rep")
    named = written(shuffled_join(classes, parts, "rep", "left").select(*KEY, "n", F.coalesce("component", "least").alias("component_id")))
    out = with_hubs(real.select("doc_id", *KEY), named, KEY, n_rows).select("doc_id", "n_shingles", "component_id")
    alone = found.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
