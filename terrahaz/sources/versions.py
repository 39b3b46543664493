"""Parquet tables that change by partition: copy on write under a version pointer.

``data/held=N`` holds the files that version N wrote, in folders by partition;
``pointer/version=N`` lists which partitions are read from which of them.  A
version counts once its pointer is written whole, so a job that dies in between
leaves the version before in place, and the next run writes over what it left.
Partitions that a change does not touch are neither read nor written.  One writer
at a time; partition columns must have few values (days, versions, buckets), since
their list passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELD, BATCH = "_held", "_batch"


def _folders(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, path) of the folders ``...=number`` below a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    found = [s.getPath() for s in files.listStatus(at) if s.isDirectory()]
    return sorted((int(p.getName().split("=")[1]), p.toString()) for p in found)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def among(columns: list[str], rows: list[tuple]) -> Column:
    """The rows' values as literals, nested so that every column prunes folders by itself."""
    if not rows:
        return F.lit(False)
    first, rest = columns[0], columns[1:]
    if not rest:
        known = [r[0] for r in rows if r[0] is not None]
        parts = [F.col(first).isin(known)] if known else []
        return reduce(Column.__or__, parts + [F.col(first).isNull()] * any(r[0] is None for r in rows))
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r[1:])
    alike: dict = {}  # values of the first column with the same rest share one test
    for value, tails in groups.items():
        alike.setdefault(tuple(sorted(tails, key=repr)), []).append((value,))
    return reduce(Column.__or__, [among([first], values) & among(rest, list(tails)) for tails, values in alike.items()])


def spread(df: DataFrame, folders: list[str], order: list[str]) -> DataFrame:
    """The rows of a folder together and sorted, in one pass over ``df``.

    Spark measures the shuffled partitions: one that exceeds the advisory size,
    because its folder is large, is split among tasks, and small ones are merged.
    """
    return df.hint("rebalance", *[F.col(c) for c in folders]).sortWithinPartitions(*folders, *order)


@dataclass(frozen=True)
class VersionedTable:
    """``schema`` names all columns, the partition columns included; files are sorted by ``order``."""

    spark: SparkSession
    path: str
    schema: T.StructType
    partitions: list[str]
    order: tuple[str, ...] = ()

    @staticmethod
    def schema_of(spark: SparkSession, path: str) -> T.StructType:
        """The columns of a table that holds files, partition columns last."""
        rows = spark.read.parquet(f"{path}/data")
        return rows.drop(HELD).schema

    def version(self) -> int:
        """The newest committed version, 0 before the first."""
        done = [n for n, folder in _folders(self.spark, f"{self.path}/pointer") if _exists(self.spark, f"{folder}/_SUCCESS")]
        return max(done, default=0)

    def _pointer_schema(self) -> T.StructType:
        return T.StructType([*[T.StructField(c, self.schema[c].dataType) for c in self.partitions], T.StructField(HELD, T.LongType()), T.StructField(BATCH, T.LongType())])

    def pointer(self) -> DataFrame:
        """Partition values, the version that holds the files (0: a mark without files) and the last batch."""
        n = self.version()
        schema = self._pointer_schema()
        return self.spark.read.schema(schema).parquet(f"{self.path}/pointer/version={n}") if n else self.spark.createDataFrame([], schema)

    def last_batch(self) -> int | None:
        return self.pointer().agg(F.max(BATCH)).first()[0]

    def held(self, only: Column | None = None) -> list[tuple]:
        """(partition values..., version) of the files to read, one a partition and version."""
        rows = self.pointer().where(F.col(HELD) > 0)
        return [tuple(r) for r in (rows if only is None else rows.where(only)).select(*self.partitions, HELD).collect()]

    def read(self, only: Column | None = None) -> DataFrame:
        """The rows of the partitions that ``only``, a condition on partition columns, lets through."""
        held = self.held(only)
        if not held:
            return self.spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema.fields, T.StructField(HELD, T.LongType())])
        folders = [f"{self.path}/data/{HELD}={n}" for n in sorted({h[-1] for h in held})]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders)
        return rows.where(among([HELD, *self.partitions], [(h[-1], *h[:-1]) for h in held])).select(*self.schema.names)

    def _commit(self, rows: DataFrame, kept: list[tuple], batch: int | None) -> int:
        n = self.version() + 1
        folder = f"{self.path}/data/{HELD}={n}"
        rows = spread(rows.select(*self.schema.names), self.partitions, list(self.order))
        rows.write.mode("overwrite").partitionBy(*self.partitions).parquet(folder)
        present = self.spark.read.schema(self.schema).parquet(folder).select(*self.partitions).distinct()
        mark = [(*[None] * len(self.partitions), 0, batch)]
        lines = self.spark.createDataFrame([(*k, None) for k in kept] + mark, self._pointer_schema())
        present = present.select(*self.partitions, F.lit(n).cast("long").alias(HELD), F.lit(None).cast("long").alias(BATCH))
        lines.unionByName(present).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pointer/version={n}")
        return n

    def replace(self, rows: DataFrame, only: Column, batch: int | None = None) -> int:
        """Next version: the partitions that ``only`` lets through hold ``rows`` instead, or vanish."""
        gone = set(self.held(only))
        return self._commit(rows, [h for h in self.held() if h not in gone], batch)

    def merge(self, incoming: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> int:
        """Next version: every partition that ``incoming`` has rows of becomes ``combine(stored, incoming)``."""
        incoming = incoming.persist()
        try:
            only = self.touched(incoming)
            return self.replace(combine(self.read(only), incoming), only, batch)
        finally:
            incoming.unpersist()

    def touched(self, rows: DataFrame) -> Column:
        """Condition on the partitions that ``rows`` lie in."""
        return among(self.partitions, [tuple(r) for r in rows.select(*self.partitions).distinct().collect()])

    def add(self, rows: DataFrame, batch: int | None = None, most: int = 2,
            combine: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Next version with ``rows`` beside what is stored.

        A partition is read from at most ``most`` versions: one that would exceed
        them is written anew whole, through ``combine`` if given.  A batch number
        that is already committed changes nothing.
        """
        last = self.last_batch() if batch is not None else None
        if last is not None and last >= batch:
            return self.version()
        rows = rows.persist()
        try:
            files: dict = {}
            for h in self.held(self.touched(rows)):
                files.setdefault(h[:-1], []).append(h)
            full = [p for p, hs in files.items() if len(hs) >= most]
            only = among(self.partitions, full)
            result = rows
            if full:
                whole = self.read(only).unionByName(rows.where(only).select(*self.schema.names))
                result = (whole if combine is None else combine(whole)).unionByName(
                    rows.where(~F.coalesce(only, F.lit(False))).select(*self.schema.names))
            return self._commit(result, [h for h in self.held() if h[:-1] not in set(full)], batch)
        finally:
            rows.unpersist()

    def vacuum(self, keep: int = 2) -> None:
        """Drops the files that none of the newest ``keep`` versions reads."""
        done = [n for n, folder in _folders(self.spark, f"{self.path}/pointer") if _exists(self.spark, f"{folder}/_SUCCESS")][-keep:]
        if not done:
            return
        schema, live = self._pointer_schema(), set()
        for n in done:
            live |= {r[0] for r in self.spark.read.schema(schema).parquet(f"{self.path}/pointer/version={n}").select(HELD).distinct().collect()}
        newest = max(done)
        for part, named in (("data", live), ("pointer", set(done))):
            for n, folder in _folders(self.spark, f"{self.path}/{part}"):
                if n not in named and n <= newest:
                    at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                    at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
