"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts, repeated epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakdrift.llm.common import shuffled_join, table, written

#: Each source's random order is dealt to this many equal ranges of the key.
RANGES = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source, source_size) to (source, source_size, target), by water filling.

    Sources in code-point order, null last, get the weights in turn. The total of share times all sizes is dealt
    by weight; where a source would get over most times its size it stops there, and the excess goes to the
    others by weight until none is above. Sources without words get 0. Sources are pre-aggregated, one row each.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    level = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # At the final level x each target is min(cap, x * weight). Sorted by the level at which each source fills,
    # x of a prefix of full sources is (total - their caps) / (the others' weights); the first that fits is largest.
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = level.withColumn("x", (F.sum("source_size").over(every) * F.lit(share) - full) / free)
    level = level.withColumn("fits", F.when(F.col("x") * F.col("weight") <= F.col("cap"), F.col("x")))
    level = level.withColumn("x", F.max("fits").over(every))
    return level.select(
        "source", "source_size", F.coalesce(F.least("cap", F.col("x") * F.col("weight")), "cap").alias("target")
    )


def mix(
    docs: DataFrame,
    size: Column,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    ranges: int = RANGES,
) -> DataFrame:
    """(doc_id, source, ...) to (doc_id, source, size, source_size, target, taken), one row for each document.

    Every document gets a hash-random key of its id, its size and the seed. Within each source the keys are
    sorted by range; prefix sums of the ranges' totals and of the rows within a range give each document's place
    in the source. The mix takes whole epochs, then cuts the last one at exactly the source's target rounded to
    a whole number: the document at the cut gives its first words only. Rows that repeat count as documents of
    their own. A null source is a source; null texts have size 0 and take 0. Extra columns are not looked at.
    A hot source is spread over all ranges.
    """
    rows = docs.select("doc_id", "source", size.alias("size"))
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size"))
    rows = rows.withColumn("part", F.shiftrightunsigned("key", 40).bitwiseAND((1 << 24) - 1) * ranges / (1 << 24))
    rows = written(rows.withColumn("part", F.floor("part").cast("int")))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    sizes = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part_size").over(ahead), F.lit(0).cast("long")))
    parts = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    parts = parts.select("p.source", "part", "ahead", "source_size", "target")
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size")
    rows = rows.withColumn("start", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    same = F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.part") == F.col("p.part"))
    rows = rows.alias("r").join(parts.alias("p"), same)
    budget, total = F.round("target").cast("long"), F.greatest("source_size", F.lit(1).cast("long"))
    epochs = F.floor(budget / total).cast("long")
    left = budget - epochs * total - F.col("ahead") - F.col("start")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(left, F.col("size")))
    return rows.select("doc_id", "r.source", "size", "source_size", "target", taken.alias("taken"))


def mix_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself, with the columns of docs: a document is there once for each epoch that takes it whole.

    The document at a source's cut is there with its first words as they stand in the text. Documents without
    words are taken with every whole epoch of their source. Other columns, whatever their names, are passed on; repeated
    rows are documents of their own, a null id or source is one like others, an empty table gives an empty one.
    """
    columns = docs.columns
    more = [c for c in columns if c not in ("doc_id", "source", "text")]
    # Columns that are only passed on go as one, so that their names meet none of ours.
    docs = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in more] or [F.lit(0)]).alias("_more"))
    keyed = docs.withColumn("_size", word_count(F.col("text")))
    plan = mix(keyed, F.col("_size"), **options)
    plan = plan.groupBy("doc_id", "source", "size").agg(
        F.array_sort(F.collect_list("taken")).alias("takes"), F.first("target").alias("target"),
        F.first("source_size").alias("source_size"),
    )
    # Rows that share id, source and size differ in nothing that the plan knows: the n-th row gets the n-th take.
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "_size").orderBy(F.xxhash64("text")))
    k, p = keyed.withColumn("_nth", nth).alias("k"), plan.alias("p")
    same = [F.col(f"k.{a}").eqNullSafe(F.col(f"p.{b}")) for a, b in (("doc_id", "doc_id"), ("source", "source"), ("_size", "size"))]
    rows = shuffled_join(k, p, same[0] & same[1] & same[2]).withColumn("_taken", F.element_at("p.takes", F.col("k._nth")))
    size = F.greatest(F.col("k._size"), F.lit(1).cast("long"))
    whole = F.when(F.col("k._size") > 0, F.floor(F.col("_taken") / size)).otherwise(
        F.floor(F.col("p.target") / F.greatest("p.source_size", F.lit(1).cast("long")))
    ).cast("int")
    cut = (F.col("_taken") - whole * F.col("k._size")).cast("int")
    # The shortest prefix with so many words.
    head = F.concat(
        F.regexp_extract(F.col("k.text"), r"^[ \t-\r]*", 0),
        F.array_join(F.slice(F.regexp_extract_all(F.col("k.text"), F.lit(r"[^ \t-\r]+[ \t-\r]*"), F.lit(0)), 1, cut), ""),
    )
    copies = F.concat(
        F.array_repeat(F.struct(F.col("k.text").alias("text")), whole),
        F.when((cut > 0) & (F.col("k._size") > 0), F.array(F.struct(head.alias("text")))).otherwise(F.array().cast("array<struct<text:string>>")),
    )
    rows = rows.select("k.doc_id", "k.source", "k._more", F.explode(copies).alias("_copy"))
    own = {"doc_id": F.col("doc_id"), "source": F.col("source"), "text": F.col("_copy.text").alias("text")}
    return rows.select(*[own[c] if c in own else F.col(f"_more.`{c}`") for c in columns])


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


