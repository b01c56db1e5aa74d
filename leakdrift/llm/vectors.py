"""Near-duplicate vectors by PCA-ordered tiles: leading dimensions first, the rest bounded by suffix norms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakdrift.llm.common import connected_components, least_of_component, table, with_hubs, written

#: Vectors of a block, which one task compares with another block, and of a tile within it.
BLOCK, TILE = 4096, 512
#: Strips along the first axis whose five numbers are sent to every task at most; more are joined by a shuffle.
STRIPS = 1_000_000
#: Dimensions after which the bound is looked at.
STEPS = (8, 16, 32)
#: Slack for rounding in bounds; every link is confirmed on the vectors themselves.
SLACK = 1e-9


def usable(v):  # noqa: ANN001, ANN201
    """True for vectors that are not null or zero and hold finite components only."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def principal_axes(rows: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the second moments of all unit vectors, largest first; partitions sum before the shuffle."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()).astype(np.float64)
                x /= np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) * np.abs(x).max(1, keepdims=True)
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(dim), "row": list(total)})

    parts = rows.select("v").mapInPandas(moments, "i long, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    m = np.zeros((dim, dim))
    for r in cells.collect():
        m[r["i"], r["j"]] = r["x"]
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]


def tile_links(a: np.ndarray, b: np.ndarray, least: float, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose product may reach `least`; rotated unit vectors, leading dimensions first.

    After each step what is left of a pair's product is at most the product of the norms of the dimensions to come.
    Rows and columns without any pair that can still reach `least` leave the tile, and the tile stops when none is.
    """
    dim = a.shape[1]
    rows, cols = np.arange(len(a)), np.arange(len(b))
    done = 0
    total = np.zeros((len(a), len(b)))
    for k in [s for s in steps if s < dim] + [dim]:
        total += a[rows, done:k] @ b[cols, done:k].T
        done = k
        rest = np.outer(np.linalg.norm(a[rows, k:], axis=1), np.linalg.norm(b[cols, k:], axis=1))
        alive = total + rest >= least - SLACK
        keep_r, keep_c = alive.any(1), alive.any(0)
        if not keep_r.any():
            return rows[:0], cols[:0]
        if done < dim and (keep_r.mean() < 0.7 or keep_c.mean() < 0.7):
            rows, cols = rows[keep_r], cols[keep_c]
            total = total[np.ix_(keep_r, keep_c)]
    at = np.nonzero(total >= least - SLACK)
    return rows[at[0]], cols[at[1]]


def forest(pairs: np.ndarray) -> np.ndarray:
    """Links of a spanning forest of the pairs, so that a task sends no more links than it has vectors."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs.tolist():
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def compare(axes: np.ndarray, cosine: float, steps: tuple[int, ...] = STEPS):  # noqa: ANN201
    """The work of one task: all pairs of two blocks. Rows: vector, copies of its partners; and links to join them."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["v"].to_numpy()).astype(np.float64)
        top = np.abs(x).max(1, keepdims=True)
        x = x / top
        norm = np.sqrt((x * x).sum(1))
        unit = x / norm[:, None]
        turned = unit @ axes
        ids, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
        left, right = np.flatnonzero(rows["left"].to_numpy()), np.flatnonzero(rows["right"].to_numpy())
        same = int(key[0]) == int(key[1])
        if same:
            right = left
        # Tiles follow the leading axes, so that a tile's vectors lie close together.
        left, right = (w[np.lexsort((ids[w], turned[w, 1] if turned.shape[1] > 1 else ids[w], np.round(turned[w, 0], 1)))] for w in (left, right))
        degree = np.zeros(len(rows), dtype=np.int64)
        pairs = []
        reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
        boxes = lambda w: [(w[k : k + TILE], turned[w[k : k + TILE]].min(0), turned[w[k : k + TILE]].max(0)) for k in range(0, len(w), TILE)]
        tiles_l, tiles_r = boxes(left), boxes(right)
        for i, (wl, lo, hi) in enumerate(tiles_l):
            for wr, lo_r, hi_r in tiles_r[i if same else 0 :]:
                gap = np.maximum(0, np.maximum(lo - hi_r, lo_r - hi))
                if np.sqrt((gap * gap).sum()) > reach:
                    continue
                r, c = tile_links(turned[wl], turned[wr], cosine, steps)
                r, c = wl[r], wr[c]
                if wl is wr or (same and wl[0] == wr[0]):
                    r, c = r[r < c], c[r < c]
                if not len(r):
                    continue
                exact = np.concatenate([(x[r[k : k + 65536]] * x[c[k : k + 65536]]).sum(1) for k in range(0, len(r), 65536)]) / (norm[r] * norm[c])
                r, c = r[exact >= cosine], c[exact >= cosine]
                np.add.at(degree, r, copies[c])
                np.add.at(degree, c, copies[r])
                pairs.append(forest(np.stack([ids[r], ids[c]], 1)))
        some = np.flatnonzero(degree)
        links = forest(np.concatenate(pairs)) if pairs else np.zeros((0, 2), dtype=np.int64)
        return pd.DataFrame(
            {
                "rep": np.concatenate([ids[some], links[:, 0]]),
                "links": np.concatenate([degree[some], np.zeros(len(links), dtype=np.int64)]),
                "other": np.concatenate([ids[some], links[:, 1]]),
            }
        )

    return run


def block_pairs(reps: DataFrame, axes: np.ndarray, cosine: float, block: int) -> DataFrame:
    """Vectors of every two blocks that can hold a link. Blocks are ranges along the first axis, hot ranges salted.

    Every block is sent to each block from its own number on, as far as the first axis lets a link be.
    """
    lead = F.aggregate(
        F.zip_with("v", F.array(*[F.lit(float(w)) for w in axes[:, 0]]), lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, x: s + x
    )
    top = F.array_max(F.transform("v", lambda x: F.abs(x).cast("double")))
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: F.pow(x.cast("double") / F.col("top"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
    placed = reps.withColumn("top", top).withColumn("at", lead / (F.col("top") * norm)).drop("top")
    n = max(1, -(-placed.count() // block))
    placed = placed.repartitionByRange(n, "at") if n > 1 else placed.coalesce(1)
    placed = written(placed.withColumn("strip", F.spark_partition_id()))
    # Four numbers of each strip, not its vectors, are all that the driver sees and sends back.
    heads = placed.groupBy("strip").agg(F.count("*").alias("size"), F.min("at").alias("lo"), F.max("at").alias("hi")).toPandas().sort_values(["lo", "strip"])
    # Neighbouring ranges make a strip until it has a block's vectors, however many ranges there are.
    size = heads["size"].to_numpy()
    number = np.unique((np.cumsum(size) - size) // block, return_inverse=True)[1]
    joined = heads.groupby(number).agg(size=("size", "sum"), lo=("lo", "min"), hi=("hi", "max"))
    many = np.maximum(1, -(-joined["size"].to_numpy() // (2 * block)))
    first = np.cumsum(many) - many
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6
    lo, hi = joined["lo"].to_numpy(), joined["hi"].to_numpy()
    # Strips are ranges in order, so the strips that a link can reach are neighbours of each other.
    start = np.searchsorted(hi, lo - reach, side="left")
    end = np.searchsorted(lo, hi + reach, side="right") - 1
    columns = {"first": first, "many": many, "from": first[start], "to": (first + many - 1)[end]} if len(heads) else {c: np.zeros(0) for c in ("first", "many", "from", "to")}
    strips = pd.DataFrame({"strip": heads["strip"].to_numpy(), **{c: v[number] for c, v in columns.items()}})
    strips = reps.sparkSession.createDataFrame(strips.astype("int64"), "strip long, first long, many long, from long, to long")
    placed = placed.join(F.broadcast(strips) if len(heads) <= STRIPS else strips, "strip")
    placed = placed.withColumn("block", F.col("first") + F.pmod(F.xxhash64("rep"), "many"))
    placed = placed.withColumn("partner", F.explode(F.sequence("from", "to")))
    return placed.select(
        F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"), "rep", "copies", "v",
        (F.col("block") <= F.col("partner")).alias("left"), (F.col("block") >= F.col("partner")).alias("right"),
    )


def near_vectors(vectors: DataFrame, cosine: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(vec_id, embedding) to (vec_id, n_links, component_id, kept), one row for each row.

    Equal vectors are compared once, as a class with its count; every other pair of usable vectors of the same
    length is compared unless the leading axes rule it out. Vectors that are null, zero or hold null or non-finite
    components link with nothing. Rows with the same vec_id are vectors of their own with a common id; null ids
    get no links. Labels and extra columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").alias("v"))
    rows = rows.withColumn("ok", F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False)))
    # Numbers stand for classes, fixed once they are written: several vectors can have a common id.
    grouped = rows.where("ok").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = written(grouped.withColumn("rep", F.monotonically_increasing_id()))
    found = None
    for (dim,) in classes.select(F.size("v")).distinct().orderBy(F.size("v")).collect():
        reps = classes.where(F.size("v") == dim)
        axes = principal_axes(reps, dim)
        pairs = block_pairs(reps, axes, cosine, block)
        one = pairs.groupBy("i", "j").applyInPandas(compare(axes, cosine), "rep long, links long, other long")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "rep long, links long, other long")
    found = written(found)
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    n_rows = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    parts = connected_components(found.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    names = classes.select(F.col("rep").alias("node"), "least")
    parts = least_of_component(written(parts), names, n_rows).withColumnRenamed("node", "rep")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    by_class = classes.join(degree, "rep", "left").join(parts, "rep", "left")
    by_class = written(by_class.select("v", F.col("copies").alias("n"), n_links, F.coalesce("component", "least").alias("component_id")))
    out = with_hubs(rows.where("ok").select("vec_id", "v"), by_class, ["v"], n_rows).drop("v")
    rest = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
