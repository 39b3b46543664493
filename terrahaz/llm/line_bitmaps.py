"""Line dedup that returns bitmaps instead of text.

Every line becomes a 128-bit hash of its key with its document and position.
The hashes are range-partitioned and sorted by hash, document and position, so
that a task streams over them and sees the documents of a line, and its first
occurrence, one after another.  A line may stand in a third of all documents:
each hash is therefore split by document into slices, the ranges cut between
slices too, and the slices' counts and first occurrences, at most one row per
hash and slice, are put together afterwards.  Of every document that loses
lines the operator returns the run lengths of its keep bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrahaz.llm.block_repeats import checked_broadcast
from terrahaz.llm.common import ascii_lower, documents, hash_cell, keyed, written

#: stripped from both ends of a line: space and the controls 09 to 0D
EDGES = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    """Lines between line feeds; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(EDGES)))


def hashed_lines(docs: DataFrame, min_chars: int, slices: int) -> DataFrame:
    """high, low (hash of the key), slice, _id, _th, pos of every line whose key has ``min_chars`` code points."""
    lines = keyed(docs, F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.select("_id", "_th", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("high"), F.xxhash64(F.lit(1), "key").alias("low"),
                       hash_cell(slices, F.col("_id"), F.col("_th")).alias("slice"), "_id", "_th", "pos")


def common_lines(lines: DataFrame, min_documents: int, parts: int) -> DataFrame:
    """high, low, slice, first (struct _id, _th, pos) of the hashes that stand in ``min_documents`` documents."""
    spread = lines.repartitionByRange(parts, "high", "low", "slice")
    stream = Window.partitionBy("high", "low", "slice").orderBy("_id", "_th", "pos")
    document = F.struct("_id", "_th")
    opening = (spread.withColumn("before", F.lag(document).over(stream))
               .where(F.col("before").isNull() | (F.col("before") != document)))
    slices = opening.groupBy("high", "low", "slice").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "_th", "pos")).alias("first"))
    whole = Window.partitionBy("high", "low")
    return (slices.select("high", "low", "slice", F.sum("n").over(whole).alias("n"), F.min("first").over(whole).alias("first"))
            .where(F.col("n") >= min_documents).drop("n"))


def keep_bitmaps(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """_id, _th, n_dropped, runs: the keep bitmaps of the documents that lose lines.

    A line's key is the line without blanks at both ends, A-Z lower-cased.  Lines
    whose key has at least ``min_chars`` code points and stands in at least
    ``min_documents`` documents go, with ``keep_first`` all but the first by
    document and position.  ``runs`` holds the lengths of the bitmap's runs, kept
    and dropped in turn, beginning with kept (which may be 0); the last kept run
    is left out.  (``_id``, ``_th``) is ``common.text_key``: rows with one id and
    one text are one document, null ids count as an id.  Null and empty texts
    are one empty line, which goes only if ``min_chars`` is 0.  Long texts are
    split within one row; an empty table gives an empty result; other columns
    are not looked at.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = written(hashed_lines(docs, min_chars, parts), "line-hashes")
    dropped = lines.join(common_lines(lines, min_documents, parts), ["high", "low", "slice"])
    if keep_first:
        dropped = dropped.where(F.struct("_id", "_th", "pos") != F.col("first"))
    dropped = dropped.select("_id", "_th", "pos").distinct()
    order = Window.partitionBy("_id", "_th").orderBy("pos")
    runs = (dropped.withColumn("island", F.col("pos") - F.row_number().over(order))
            .groupBy("_id", "_th", "island").agg(F.min("pos").alias("begin"), F.count(F.lit(1)).cast("int").alias("length"))
            .withColumn("gap", F.col("begin") - F.coalesce(F.lag(F.col("begin") + F.col("length")).over(
                Window.partitionBy("_id", "_th").orderBy("begin")), F.lit(0))))
    return written(runs.groupBy("_id", "_th").agg(
        F.sum("length").cast("long").alias("n_dropped"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("begin", "gap", "length"))),
                              lambda r: F.array(r["gap"], r["length"]))).alias("runs")), "line-bitmaps")


def kept_lines(lines: Column, runs: Column) -> Column:
    """The lines whose bit is set in a bitmap given by its runs."""
    mask = F.flatten(F.transform(runs, lambda n, k: F.array_repeat(k % 2 == 0, n)))
    pairs = F.zip_with(lines, mask, lambda line, keep: F.struct(line.alias("line"), F.coalesce(keep, F.lit(True)).alias("keep")))
    return F.transform(F.filter(pairs, lambda p: p["keep"]), lambda p: p["line"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept (the remaining lines joined by line feeds)."""
    rows = keyed(docs, "doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        checked_broadcast(bitmaps, "runs"), ["_id", "_th"], "left")
    return rows.select("doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
                       F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
                       F.when(F.col("runs").isNull(), F.col("text"))
                       .otherwise(F.array_join(kept_lines(lines_of(F.col("text")), F.col("runs")), "\n")).alias("kept"))


def op11_line_bitmaps(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return apply_bitmaps(docs, keep_bitmaps(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH docs AS (
    SELECT row_number() OVER () AS rid, dense_rank() OVER (ORDER BY doc_id, text) AS doc, doc_id,
           string_split(coalesce(text, ''), chr(10)) AS lines
    FROM documents
), split AS (
    SELECT rid, doc, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs
), keys AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM split
), common AS (
    SELECT key FROM keys WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc) >= 10
), kept AS (
    SELECT rid, count(*) AS n_lines, count(c.key) AS n_dropped,
           string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL) AS text
    FROM keys LEFT JOIN common c USING (key) GROUP BY rid
)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(text, '')) AS kept_sha256
FROM docs JOIN kept USING (rid)
"""
