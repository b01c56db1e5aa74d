"""Merkle manifest of a dataset: blocks of leaves swap subtree roots in a butterfly exchange, so each gets its upper proofs."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakdrift.llm.common import table, written

#: Leaves of a block, about: the largest power of the fanout that isn't above. A block is what one partition has of a tree.
BLOCK = 8192
#: Rows of headers (of trees, of partitions) that are sent to every task at most; more are joined by a shuffle.
HEADERS = 100_000
#: Rounds of the exchange whose plans are run together.
ROUNDS = 6

STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def netstring(value: Column) -> Column:
    """Length in bytes, colon, value; a dash for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return digest(*[netstring(c) for c in columns])


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda h, step: digest(step["left"], h, step["right"]))


def siblings_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def sized(df: DataFrame) -> DataFrame:
    """df to be sent to every task where it has few rows; its rows hold a bounded number of short values."""
    return F.broadcast(df) if df.limit(HEADERS + 1).count() <= HEADERS else df


def placed(leaves: DataFrame, tree: list[str], order: list[str], block: int) -> DataFrame:
    """leaves with `nth`, the number within its tree in the given order, `block`, and the tree's `n` leaves.

    Leaves are range-sorted by tree and order, however they are spread over trees; equal leaves may lie in several
    ranges. Numbers come from the ranges' counts, of which there are no more than ranges and trees.
    """
    salt = F.monotonically_increasing_id().alias("_salt")
    rows = leaves.select("*", salt).repartitionByRange(*tree, *order, "_salt").sortWithinPartitions(*tree, *order)
    rows = written(rows.drop("_salt").select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")))
    counts = rows.groupBy(*tree, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*tree).orderBy("_range")
    counts = counts.withColumn("_before", F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"))
    counts = written(counts.withColumn("n", F.sum("_n").over(Window.partitionBy(*tree))))
    rows = rows.alias("rows").join(sized(counts).alias("counts"), equal_keys("rows", "counts", [*tree, "_range"]))
    rows = rows.select("rows.*", F.col("counts._before") + F.col("_at") - F.col("counts._first"), "counts.n")
    rows = rows.toDF(*rows.columns[:-2], "nth", "n").drop("_range", "_at")
    return rows.withColumn("block", F.floor(F.col("nth") / block))


def depth(n: Column, fanout: int) -> Column:
    """How often `fanout` nodes become one until one remains: by whole numbers, no logarithms."""
    powers = []
    while not powers or powers[-1] < 2**62 // fanout:
        powers.append((powers[-1] if powers else 1) * fanout)
    return F.size(F.filter(F.array(F.lit(1), *[F.lit(p) for p in powers[:-1]]), lambda p: p < n))


def levels_of(hashes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of each level, the leaves first."""
    out = [hashes]
    for _ in range(levels):
        below = out[-1]
        out.append([hashlib.sha256("".join(below[k : k + fanout]).encode()).hexdigest() for k in range(0, len(below), fanout)])
    return out


def block_roots(blocks: DataFrame, tree: list[str], fanout: int, levels: Column) -> DataFrame:
    """(tree, block, h): the root of each block's subtree."""
    schema = blocks.select(*tree, "block", F.col("leaf").alias("h")).schema

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("nth")
        root = levels_of(rows["leaf"].to_pylist(), rows["_levels"][0].as_py(), fanout)[-1]
        return rows.slice(0, 1).select([*tree, "block"]).append_column("h", pa.array(root, pa.string()))

    rows = blocks.select(*tree, "block", "nth", "leaf", levels.alias("_levels"))
    return rows.groupBy(*tree, "block").applyInArrow(work, schema)


def butterfly(roots: DataFrame, tree: list[str], fanout: int) -> DataFrame:
    """(tree, block, h, n_blocks) to (tree, block, root, upper): each block's way from its root to its tree's root.

    In round r the `fanout` blocks whose numbers differ in the r-th digit alone swap the roots of the subtrees of
    fanout ** r blocks that they lie in. Each hashes the ancestor itself, as do all blocks of the subtree, so that after
    the last round every block holds all its siblings and the root, and nothing has to be sent down. Numbers without a
    block take part with no root, so that each group has all its members, and none more than `fanout`.
    """
    rounds = depth(F.col("n_blocks"), fanout).cast("int")
    state = roots.withColumn("rounds", rounds)
    # Each of the first fanout ** (rounds - 1) blocks stands for the missing numbers that differ from its own in the last digit.
    half = F.pow(F.lit(float(fanout)), F.col("rounds") - 1).cast("long")
    none = state.where((F.col("rounds") > 0) & (F.col("block") < half)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(fanout - 1))))
    none = none.withColumn("block", F.col("block") + F.col("k") * half).where(F.col("block") >= F.col("n_blocks"))
    none = none.select(*tree, "block", F.lit(None).cast("string").alias("h"), "n_blocks", "rounds")
    state = written(state.unionByName(none).withColumn("upper", F.array().cast(f"array<{STEP}>")))
    most = state.agg(F.coalesce(F.max("rounds"), F.lit(0))).first()[0]
    for r in range(most):
        width = fanout**r
        digit = F.floor(F.col("block") / width) % fanout
        group = (F.col("block") - digit * width).alias("_group")
        member = F.struct(digit.alias("d"), "block", "h", "upper")
        met = state.where(F.col("rounds") > r).groupBy(*tree, "n_blocks", "rounds", group).agg(F.array_sort(F.collect_list(member)).alias("m"))
        met = met.select(*tree, "n_blocks", "rounds", "m", F.explode("m").alias("x"))
        hashes = lambda keep: F.array_join(F.transform(F.filter("m", keep), lambda y: F.coalesce(y["h"], F.lit(""))), "")
        step = F.struct(hashes(lambda y: y["d"] < F.col("x.d")).alias("left"), hashes(lambda y: y["d"] > F.col("x.d")).alias("right"))
        every = F.array_join(F.transform("m", lambda y: F.coalesce(y["h"], F.lit(""))), "")
        parent = F.when(every != "", F.sha2(every, 256))
        met = met.select(*tree, F.col("x.block").alias("block"), parent.alias("h"), "n_blocks", "rounds", F.concat("x.upper", F.array(step)).alias("upper"))
        state = met.unionByName(state.where(F.col("rounds") <= r))
        if r % ROUNDS == ROUNDS - 1:
            state = written(state)
    return state.where(F.col("block") < F.col("n_blocks")).select(*tree, "block", F.col("h").alias("root"), "upper")


def proofs(blocks: DataFrame, uppers: DataFrame, tree: list[str], keep: list[str], roots: list[str], fanout: int, levels: Column) -> DataFrame:
    """The columns `keep` of blocks and `roots` of uppers, and each leaf's proof: its siblings in the block, then `upper`."""
    rows = blocks.withColumn("_levels", levels)
    schema = blocks.select(*keep, *[F.lit("").alias(r) for r in roots], F.array().cast(f"array<{STEP}>").alias("proof")).schema

    def work(rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows = rows.sort_by("nth")
        nodes = levels_of(rows["leaf"].to_pylist(), rows["_levels"][0].as_py(), fanout)
        above = upper["upper"][0].as_py()
        own = range(len(rows))
        lefts, rights = [], []
        for k, level in enumerate(nodes[:-1]):
            places = [i // fanout**k for i in own]
            first = [p - p % fanout for p in places]
            lefts.append(["".join(level[f:p]) for f, p in zip(first, places, strict=True)])
            rights.append(["".join(level[p + 1 : f + fanout]) for f, p in zip(first, places, strict=True)])
        lefts += [[s["left"]] * len(rows) for s in above]
        rights += [[s["right"]] * len(rows) for s in above]
        # Level by level into leaf by leaf.
        deep = len(lefts)
        flat = [pa.array([side[k][i] for i in own for k in range(deep)], pa.string()) for side in (lefts, rights)]
        steps = pa.StructArray.from_arrays(flat, ["left", "right"])
        proof = pa.ListArray.from_arrays(pa.array([i * deep for i in range(len(rows) + 1)], pa.int32()), steps)
        out = rows.select(keep)
        for r in roots:
            out = out.append_column(r, pa.array([upper[r][0].as_py()] * len(rows), pa.string()))
        return out.append_column("proof", proof)

    return rows.groupBy(*tree, "block").cogroup(uppers.groupBy(*tree, "block")).applyInArrow(work, schema)


def equal_keys(left: str, right: str, keys: list[str]) -> Column:
    """The keys of two aliases agree, nulls too."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def exchanged(leaves: DataFrame, tree: list[str], order: list[str], fanout: int, block: int) -> tuple[DataFrame, DataFrame, Column]:
    """Leaves dealt to blocks, the blocks with their tree's root and their way to it, and the levels within a block."""
    if fanout < 2:
        raise ValueError("a node needs two children at least")
    inner = 1
    while fanout ** (inner + 1) <= block:
        inner += 1
    block = fanout**inner
    rows = written(placed(leaves, tree, order, block))
    levels = F.when(F.col("n") > block, F.lit(inner)).otherwise(depth(F.col("n"), fanout)).cast("int")
    sizes = rows.select(*tree, "block", F.ceil(F.col("n") / block).cast("long").alias("n_blocks")).distinct()
    roots = block_roots(rows, tree, fanout, levels).alias("r").join(sizes.alias("s"), equal_keys("r", "s", [*tree, "block"]))
    return rows, written(butterfly(roots.select("r.*", "s.n_blocks"), tree, fanout)), levels


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree: str = "lang", order: str = "doc_id", also: tuple[Column, ...] = (), fanout: int = 2, block: int = BLOCK) -> DataFrame:
    """A tree of the rows of each value of `tree`, by `order`, and one of the trees: (order, leaf, subroot, root, proof, also).

    A leaf is the SHA-256 of the columns as netstrings; a node is that of its children's hex digests, `fanout` of them
    or what is left at the end of a level, even one. Subroots are leaves of the upper tree, by `tree`, null first and
    then in the order of UTF-8 bytes. A proof has a step for each level from the leaf over the subroot to the root: the
    siblings' hashes to the left, and those to the right. Rows with the same or no `order` (null comes first) stand by
    their leaves, and `also` are columns worked out of a row. One row for each row; null columns are dashes; an empty
    table has none; other columns, whatever their names, aren't looked at.
    """
    rows = docs.select(F.col(order).alias("order"), F.col(tree).alias("tree"), leaf(*[F.col(c) for c in columns]).alias("leaf"), *also)
    leaves = written(rows)
    names = [c for c in leaves.columns if c not in ("order", "tree", "leaf")]
    rows, uppers, levels = exchanged(leaves, ["tree"], ["order", "leaf"], fanout, block)
    subroots = uppers.groupBy("tree").agg(F.first("root").alias("leaf")).withColumn("one", F.lit(0))
    found, tops, top_levels = exchanged(subroots, ["one"], ["tree"], fanout, block)
    top = written(proofs(found, tops, ["one"], ["tree"], ["root"], fanout, top_levels))
    uppers = uppers.alias("l").join(sized(top).alias("t"), equal_keys("l", "t", ["tree"]))
    uppers = uppers.select("l.tree", "block", F.col("l.root").alias("subroot"), F.col("t.root").alias("root"), F.concat("upper", "proof").alias("upper"))
    out = proofs(rows, uppers, ["tree"], ["order", "leaf", *names], ["subroot", "root"], fanout, levels)
    return out.withColumnRenamed("order", order)


def tampered_leaf() -> Column:
    """The leaf of a row whose n_chars is one more, for ids whose CRC-32 is divisible by seven; else its own, as null."""
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    changed = leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    return F.when(chosen & F.col("n_chars").isNotNull(), changed).alias("tampered")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(table(spark, sf_dir, "documents"), also=(tampered_leaf(),))
    back = folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    found = found.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), back.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
