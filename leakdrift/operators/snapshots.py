"""Tables with keys that are kept as versions: changes are merged, and a pointer is moved to the new version at once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The file that names the version that counts.
POINTER = "CURRENT"


def latest(changes: DataFrame, keys: list[str], order: list[str], deleted: Column | None = None) -> DataFrame:
    """The last row of each key by `order`, without keys whose last row is a deletion.

    Rows of a key are pre-aggregated, so that a key with very many changes is no task of its own. Rows that tie in
    `order` are decided by their other columns.
    """
    columns = changes.columns
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    rest = [c for c in columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    rows = changes.select(*keys, row.alias("_row"), gone.alias("_gone"))
    rows = rows.groupBy(*keys).agg(F.max(F.struct("_row", "_gone")).alias("_last")).where("not _last._gone")
    return rows.select(*keys, F.col("_last._row").alias("_r")).select(*keys, "_r.*").select(*columns)


def merged(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str], deleted: str = "deleted") -> DataFrame:
    """current with changes (the same columns and `deleted`): the last of a key's rows by `order` wins, deletions take it away.

    Changes that are merged a second time change nothing. `current` has no deletions.
    """
    rows = current.withColumn(deleted, F.lit(False)).unionByName(changes)
    return latest(rows, keys, order, F.col(deleted)).drop(deleted)


def replaced(current: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """current, with the rows of `other` instead of those with the same keys: a restored backup, members by their id."""
    return current.join(other.select(*keys).distinct(), keys, "left_anti").unionByName(other)


class Versions:
    """A folder with one table for each version, and a file that names the one that counts.

    A version is written whole before the pointer moves, and the pointer is replaced by renaming: readers see the old
    table or the new one. A writer that is lost leaves a version that nobody reads; writing it again replaces it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, name: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):  # noqa: ANN202
        return self._at(POINTER).getFileSystem(self.conf)

    def version(self) -> int | None:
        """The number of the version that counts."""
        if not self._files().exists(self._at(POINTER)):
            return None
        return int(self.spark.read.text(f"{self.path}/{POINTER}").first()[0])

    def current(self) -> DataFrame | None:
        number = self.version()
        return None if number is None else self.spark.read.parquet(f"{self.path}/v={number}")

    def commit(self, rows: DataFrame, number: int) -> bool:
        """Makes `rows` the table's version `number`; nothing is done where that or a later one counts already."""
        known = self.version()
        if known is not None and known >= number:
            return False
        rows.write.mode("overwrite").parquet(f"{self.path}/v={number}")
        part = self._at(f".{POINTER}-{uuid.uuid4().hex}")
        out = self._files().create(part)
        out.write(bytearray(f"{number}\n".encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else self._files().getUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(part, self._at(POINTER), options)
        return True

    def merge(self, changes: DataFrame, keys: list[str], order: list[str], number: int, deleted: str = "deleted") -> bool:
        """Merges changes into the version that counts, as version `number`; a number that counts already isn't merged again."""
        known = self.version()
        if known is not None and known >= number:
            return False
        now = self.current()
        now = changes.drop(deleted).limit(0) if now is None else now
        return self.commit(merged(now, changes, keys, order, deleted), number)
