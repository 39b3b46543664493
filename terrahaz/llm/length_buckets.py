"""Packing into optimal length buckets.

A dynamic program over the global histogram of lengths chooses the bucket
boundaries with the least padding; inside each bucket, batches of a fixed
number of rows fill a token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrahaz.llm.common import documents, hash_cell, numbered, written

BETWEEN_RUNS = r"[^\p{L}\p{M}\p{N}]+"
SIGN = r"[^\p{L}\p{M}\p{N}\s]"
MAX_LEN = 2048
BUCKETS = 16
BUDGET = 65_536
CELLS = 256


def token_count(text: Column) -> Column:
    """Runs of letters and digits, and single other signs."""
    whole = F.coalesce(text, F.lit(""))
    runs = F.size(F.array_remove(F.split(whole, BETWEEN_RUNS), ""))
    return (runs + F.size(F.split(whole, SIGN, -1)) - F.lit(1)).cast("long")


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds, ascending, of at most ``buckets`` buckets with the least padding in total.

    best[k][j]: least padded tokens for the j smallest lengths in k buckets.
    Each row of the table is one vector operation per length; fewer buckets win
    ties, then lower boundaries.
    """
    n = len(lengths)
    if not n:
        return []
    size, count = np.asarray(lengths, np.float64), np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts, total = [], []
    for _ in range(min(buckets, n)):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0.0
        for j in range(1, n + 1):
            cost = best[:j] + (count[j] - count[:j]) * size[j - 1]
            cut[j] = int(np.argmin(cost))
            now[j] = cost[cut[j]]
        best = now
        cuts.append(cut)
        total.append(best[n])
    k = int(np.argmin(total))
    bounds, j = [], n
    while j > 0:
        bounds.append(int(lengths[j - 1]))
        j = int(cuts[k][j])
        k -= 1
    return sorted(bounds)


def pieces_of(docs: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Documents cut into spans of at most ``max_len`` tokens: doc_id, piece, start, n_tokens."""
    n = F.col("n_doc")
    starts = F.sequence(F.lit(0).cast("long"), n - 1, F.lit(max_len).cast("long"))
    return (docs.select("doc_id", token_count(F.col("text")).alias("n_doc"))
            .where(n > 0)
            .select("doc_id", "n_doc", F.posexplode(starts).alias("piece", "start"))
            .select("doc_id", "piece", "start", F.least(F.lit(max_len).cast("long"), n - F.col("start")).alias("n_tokens")))


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, max_len: int = MAX_LEN) -> DataFrame:
    """Every piece of every document with its bucket and batch.

    Returns doc_id, piece, start, n_tokens, bucket, bucket_len, batch, row,
    padding.  A batch holds ``budget // bucket_len`` rows (one at least) of one
    bucket, each padded to bucket_len; only a bucket's last batch can be
    smaller.  The histogram has at most ``max_len`` rows, whatever the input;
    with so many buckets and lengths the program on the driver is bounded.
    Documents without tokens (null, empty, blank) give no piece; repeated rows
    give pieces of their own; an empty table gives an empty result; other
    columns are not looked at.
    """
    if not 1 <= max_len <= 65_536 or budget < max_len:
        raise ValueError("max_len must lie in 1..65536 and the budget must hold one row")
    pieces = written(pieces_of(docs, max_len), "packing-pieces")
    histogram = sorted((r["n_tokens"], r["n"]) for r in
                       pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect())
    bounds = best_boundaries([h[0] for h in histogram], [h[1] for h in histogram], buckets)
    ladder = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    bucket = F.size(F.filter(ladder, lambda b: b < F.col("n_tokens")))
    placed = (pieces.withColumn("bucket", bucket)
              .withColumn("bucket_len", F.coalesce(F.try_element_at(ladder, F.col("bucket") + 1), F.col("n_tokens")))
              .withColumn("cell", hash_cell(CELLS, F.col("doc_id"), F.col("piece"))))
    order = [F.col("doc_id"), F.col("piece"), F.col("n_tokens")]
    out = numbered(placed, ["bucket"], "cell", order, "at")
    rows = F.floor(F.lit(budget) / F.col("bucket_len"))
    return out.select("doc_id", "piece", "start", "n_tokens", "bucket", "bucket_len",
                      F.floor(F.col("at") / rows).alias("batch"), (F.col("at") % rows).alias("row"),
                      (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))


def op4_length_buckets(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
