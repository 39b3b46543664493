"""Looking up a batch's keys in a large store.

Two things known about the batch cut the store before anything is shuffled: its
calendar days, as literals, so that folders kept by day are pruned while
planning, and a Bloom filter of its keys, tested row by row in the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, HASHES = 16, 4
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 25  # at most 4 MB; fuller filters only let more pass


def _places(keys: list[str], bits: int) -> list[Column]:
    one = F.pmod(F.xxhash64(*keys), F.lit(bits))
    two = F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(bits))
    return [F.pmod(one + i * two, F.lit(bits)) for i in range(HASHES)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def bloom_filter(batch: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, int]:
    """One row ``words``: the bits of a filter for ``rows`` keys, 64 a number; and how many bits it has."""
    bits = min(max(LEAST_BITS, 1 << (BITS_PER_KEY * rows - 1).bit_length()), MOST_BITS)
    hits = batch.select(F.explode(F.array(*_places(keys, bits))).alias("place"))
    words = hits.groupBy(F.shiftright("place", 6).alias("id")).agg(F.bit_or(_bit(F.col("place"))).alias("word"))
    every = batch.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    ordered = every.agg(F.sort_array(F.collect_list(F.struct("id", "word"))).alias("all"))
    return ordered.select(F.col("all.word").alias("words")), bits


def may_hold(words: Column, keys: list[str], bits: int) -> Column:
    """False only for keys that the filter never saw."""
    tests = [F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(_bit(p)) != 0 for p in _places(keys, bits)]
    return reduce(Column.__and__, tests)


def stored_candidates(batch: DataFrame, stored: DataFrame, keys: list[str], moment: str = "time_utc") -> DataFrame:
    """Rows of ``stored`` on the batch's days that may have a key of the batch.

    Runs one job over the batch, for its days (which pass through the driver)
    and its size.  A store kept by ``day`` has its folders named in the plan.
    """
    known = batch.agg(F.collect_set(F.to_date(moment)).alias("days"), F.count(F.lit(1)).alias("n")).first()
    dated = stored if "day" in stored.columns else stored.withColumn("day", F.to_date(moment))
    words, bits = bloom_filter(batch, keys, max(known["n"], 1))
    return dated.where(F.col("day").isin(known["days"])).where(may_hold(words.scalar(), keys, bits))
