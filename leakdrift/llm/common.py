"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE = r"[ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; one of our own only on a single machine, where none is named, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="leakdrift-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes a table to the shared folder and reads it back.

    Lost executors cost nothing that was written; the folder is deleted when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/leakdrift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that Spark sends to a Python worker at once where the session says nothing else: whole texts can be long.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of a batch for Python workers, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a computed value to a lambda variable, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shuffled_join(df: DataFrame, other: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """df joined with other, with neither sent to every task, whatever sizes Spark expects.

    It sizes a table by its files, compressed, and what an explode makes by the row before it, so that under its
    threshold there may be tables of a hundred times that, which would go through the driver.
    """
    return df.join(other.hint("merge"), on, how)


#: Ids that are sent to every task at most; more of them are joined by a shuffle.
BROADCAST_IDS = 500_000


def sized_semi_join(df: DataFrame, ids: DataFrame, key: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """Rows of df whose key is in ids, without moving df as long as the ids are few."""
    small = ids.limit(bound + 1).count() <= bound
    return df.join(F.broadcast(ids), key, "left_semi") if small else shuffled_join(df, ids, key, "left_semi")


#: Nodes with more rows than this, and more than a thousandth of all rows, are hubs; there are fewer than 1,000 of them.
HUB_ROWS, HUBS = 256, 1_000


def with_least(rows: DataFrame, least: DataFrame, n_rows: int) -> DataFrame:
    """rows of (u, v) with u's m of least (u, m, n), where n counts the rows that least was made of, at most n_rows.

    The m of hubs are sent to every task, fewer than HUBS whatever the links are, so that no task has all of a hub's rows.
    """
    if n_rows <= HUB_ROWS:  # there can be no hub
        return shuffled_join(rows, least, "u").select("u", "v", "m")
    # No m is null; that it is said here makes both of the plan's joins with hubs one broadcast.
    hubs = least.where(F.col("m").isNotNull() & (F.col("n") > max(HUB_ROWS, n_rows // HUBS)))
    hubs = F.broadcast(hubs.select("u", F.col("m").alias("hub")))
    rows = rows.join(hubs, "u", "left")
    rest = shuffled_join(rows.where("hub is null"), least, "u").select("u", "v", "m")
    return rest.unionByName(rows.where("hub is not null").select("u", "v", F.col("hub").alias("m")))


def with_hubs(rows: DataFrame, small: DataFrame, key: list[str], n_rows: int) -> DataFrame:
    """rows joined with `small` (key, n, more), which has one row for each key and says how many of n_rows rows have it.

    What keys with very many rows get is sent to every task, fewer than HUBS of them whatever the rows are.
    """
    more = [c for c in small.columns if c not in key and c != "n"]
    hubs = small.where(F.col("n") > max(HUB_ROWS, n_rows // HUBS)).select(*key, F.struct(*more).alias("_hub"))
    both = rows.join(F.broadcast(hubs), key, "left")
    rest = shuffled_join(both.where("_hub is null").drop("_hub"), small.select(*key, *more), key)
    return rest.unionByName(both.where("_hub is not null").select("*", "_hub.*").select(*rest.columns))


def least_of_component(parts: DataFrame, names: DataFrame, n_rows: int) -> DataFrame:
    """(node, component) of components to (node, component): the least `least` of names (node, least) in each of them."""
    rows = parts.select(F.col("component").alias("u"), F.col("node").alias("v"))
    least = shuffled_join(parts, names, "node").groupBy(F.col("component").alias("u")).agg(F.min("least").alias("m"), F.count("*").alias("n"))
    return with_least(rows, least, n_rows).select(F.col("v").alias("node"), F.col("m").alias("component"))


def with_links(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): links that join the components (node, component) as they are, and more links; fewer rounds than from the start."""
    return parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links.select("a", "b"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links of any ordered type to (node, component): the smallest node that each reaches.

    Alternates large-star and small-star steps (Kiveris et al. 2014), each a grouped minimum and a join, until
    nothing changes; needs O(log^2 n) rounds, and more than max_rounds are an error. Self-links and nulls are
    ignored. A hub with very many links is pre-aggregated in the minimum, and its rows stay where they are. In what has
    settled no row repeats.
    """
    edges = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    count, state = edges.count(), None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of u moves to the smallest node that u knows.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = with_least(both.where("v > u"), least, 2 * count)
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        # Small star: u and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_least(large, least, count)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Rows may repeat, but there are never more than before: each u has one of v = m at least, which become one.
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))))
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(new) == state:
            break
        count, state = new[0], tuple(new)
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
