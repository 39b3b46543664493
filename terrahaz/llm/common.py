"""Helpers the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrahaz.session import shared_folder

BLANKS = r"[\x20\x09-\x0D]+"


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage is cut, a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Words between blanks; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash_cell(cells: int, *keys: Column) -> Column:
    """A cell 0..cells-1 by hash; equal keys share a cell."""
    return F.pmod(F.xxhash64(*keys), F.lit(cells)).cast("int")


def numbered(df: DataFrame, group: list[str], cell: str, order: list[Column], out: str) -> DataFrame:
    """Gapless numbers from 0 within each group, without bringing a group into one task.

    Rows are numbered inside (group, cell); the cells' row counts, a table of at
    most groups x cells rows, give each cell its offset.
    """
    keys = [*group, cell]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - F.lit(1)
    return (df.withColumn("_at", within).join(offsets, keys)
            .withColumn(out, (F.col("_at") + F.col("_before")).cast("long")).drop("_at", "_before"))


def text_key() -> dict[str, Column]:
    """``_id`` and ``_th`` identify a text of a document, null ids and texts included.

    Rows repeated word for word share them, so what is found for the pair can be
    joined back to rows without multiplying any.
    """
    return {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")),
            "_th": F.xxhash64(F.col("text"))}


def keyed(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(*[c.alias(n) for n, c in text_key().items()], *columns)


def free_name(base: str, docs: DataFrame) -> str:
    """``base``, lengthened until no column of ``docs`` has that name in any case."""
    taken = {c.lower() for c in docs.columns}
    while base.lower() in taken:
        base += "_"
    return base


def matched(docs: DataFrame, keyed_rows: DataFrame, how: str) -> tuple[DataFrame, list[str], dict[str, str]]:
    """Joins rows to a frame with ``_id`` and ``_th``, under names that ``docs`` does not have.

    Returns the join, the names of the key, and what the frame's other columns are called in it.
    """
    names = {c: free_name(c, docs) for c in keyed_rows.columns}
    key = [names["_id"], names["_th"]]
    rows = docs.withColumns({names[n]: c for n, c in text_key().items()})
    return rows.join(keyed_rows.withColumnsRenamed(names), key, how), key, names


def without(docs: DataFrame, keys: DataFrame, rows: int = 200_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose text key is not among ``keys`` (a stored frame of ``_id``, ``_th``)."""
    left, key, _ = matched(docs, bounded_broadcast(keys.select("_id", "_th"), rows), "left_anti")
    return left.drop(*key)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Marks a stored frame for broadcasting if it has at most ``rows`` rows; else the join is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
