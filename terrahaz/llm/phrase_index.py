"""Benchmark decontamination with a positional inverted index.

Corpus frequencies of all benchmark terms come first.  Each benchmark window
names its rarest terms; the postings (term, document, position) of those terms
are stored.  Lists are intersected after subtracting each term's offset in the
item, the rarest first, so what remains are alignments of an item with a
document.  Only documents with such an alignment are read again, to compare the
remaining words.  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrahaz.llm.common import ascii_lower, bounded_broadcast, documents, keyed, without, written

BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
RAREST = 2
SMALL = 200_000


def raw_terms(text: Column) -> Column:
    """Words (ASCII letters, digits and all signs beyond ASCII) as they stand; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def folded(term: Column) -> Column:
    """A-Z in lower case; most words are so already, and are only compared."""
    return F.when(F.lower(term) == term, term).otherwise(ascii_lower(term))


def terms_of(text: Column) -> Column:
    return F.transform(raw_terms(text), folded)


def items_of(benchmark: DataFrame, window: int) -> DataFrame:
    """One row per different item: iid, item, terms, span (words of its windows)."""
    terms = F.col("terms")
    return (benchmark.select(F.col("item_id").cast("string").alias("item"), terms_of(F.col("text")).alias("terms"))
            .where((F.size(terms) > 0) & F.col("item").isNotNull()).distinct()
            .withColumn("span", F.least(F.size(terms), F.lit(window))).withColumn("iid", F.xxhash64("item", "terms")))


def term_frequencies(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Occurrences in the whole corpus of every benchmark term."""
    vocabulary = bounded_broadcast(items.select(F.explode("terms").alias("term")).distinct(), SMALL)
    held = docs.select(F.explode(raw_terms(F.col("text"))).alias("raw")).select(folded(F.col("raw")).alias("term")).join(vocabulary, "term")
    return held.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def anchors_of(items: DataFrame, frequencies: DataFrame, rarest: int) -> DataFrame:
    """For every window of every item its ``rarest`` terms: iid, begin, place, term.

    A window is left out if one of its terms does not occur in the corpus.
    """
    places = items.select("iid", F.size("terms").alias("size"), "span", F.posexplode("terms").alias("place", "term"))
    counted = places.join(frequencies, "term", "left")
    windows = counted.select(
        "iid", "place", "term", "n",
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("place") - F.col("span") + 1),
                             F.least(F.col("place"), F.col("size") - F.col("span")))).alias("begin"))
    one = Window.partitionBy("iid", "begin")
    ranked = windows.select("*", F.row_number().over(one.orderBy(F.col("n").asc_nulls_first(), "place")).alias("rank"),
                            F.min(F.coalesce("n", F.lit(0))).over(one).alias("least"))
    return ranked.where((F.col("rank") <= rarest) & (F.col("least") > 0)).drop("n", "rank", "least")


def postings_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings of the given terms: term, _id, _th, at."""
    tokens = keyed(docs, "text").select("_id", "_th", F.posexplode(raw_terms(F.col("text"))).alias("at", "raw"))
    tokens = tokens.select("_id", "_th", "at", folded(F.col("raw")).alias("term"))
    return tokens.join(bounded_broadcast(terms, SMALL), "term")


def alignments_of(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Offset-adjusted intersection: alignments (iid, _id, _th, shift) that hold all anchors of some window.

    A list's rows are first folded to one per alignment and item word; the item's
    windows are looked at in what is left.
    """
    words = anchors.select("iid", "term", "place").distinct()
    lists = postings.join(bounded_broadcast(words, SMALL), "term")
    met = (lists.groupBy("_id", "_th", "iid", (F.col("at") - F.col("place")).alias("shift"))
           .agg(F.collect_set("place").alias("met")))
    windows = anchors.groupBy("iid", "begin").agg(F.array_sort(F.collect_set("place")).alias("need"))
    needs = windows.groupBy("iid").agg(F.collect_set("need").alias("needs"))
    held = F.exists("needs", lambda need: F.size(F.array_except(need, F.col("met"))) == 0)
    return met.join(bounded_broadcast(needs, SMALL), "iid").where(held).select("_id", "_th", "iid", "shift")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """Every occurrence of a benchmark window: _id, _th, item, at (first word), span."""
    items = written(items_of(benchmark, window), "phrase-items")
    anchors = written(anchors_of(items, term_frequencies(docs, items), rarest), "phrase-anchors")
    postings = written(postings_of(docs, anchors.select("term").distinct()), "phrase-postings")
    aligned = bounded_broadcast(written(alignments_of(postings, anchors), "phrase-alignments"), SMALL)
    # read the aligned documents again and compare all words
    hits = keyed(docs, "text").join(aligned, ["_id", "_th"]).join(bounded_broadcast(items, SMALL), "iid")
    first = F.greatest(F.lit(0), -F.col("shift"))
    compared = (hits.dropDuplicates(["_id", "_th", "iid", "shift"])
                .select("_id", "_th", "item", "span", (F.col("shift") + first).alias("base"),
                        F.slice("terms", first + 1, F.size("terms")).alias("a"),
                        F.slice(terms_of(F.col("text")), F.greatest(F.lit(0), F.col("shift")) + 1, F.size("terms") - first).alias("b"))
                .select("_id", "_th", "item", "span", "base",
                        F.array_join(F.zip_with("a", "b", lambda x, y: F.when(x == y, "1").otherwise("0")), "").alias("same")))
    begins = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("same") - F.col("span"))),
                      lambda i: F.substr(F.col("same"), i + 1, F.col("span")) == F.repeat(F.lit("1"), F.col("span")))
    return compared.select("_id", "_th", "item", "span", F.explode(begins).alias("i"), "base").select(
        "_id", "_th", "item", "span", (F.col("base") + F.col("i")).alias("at"))


def proximity_matches(docs: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """Occurrences of two terms (columns first, second) at most ``distance`` words apart: _id, _th, first, second, at, other.

    Positions are dealt into cells of ``distance`` + 1 words; only equal and neighbouring cells are joined.
    """
    terms = pairs.select(F.explode(F.array("first", "second")).alias("term")).distinct()
    postings = written(postings_of(docs, terms).distinct(), "proximity-postings")
    width = distance + 1
    left = postings.join(pairs.distinct().withColumnRenamed("first", "term"), "term").select(
        "_id", "_th", F.col("term").alias("first"), "second", "at", F.explode(F.array(
            *[F.floor(F.col("at") / width) + d for d in (-1, 0, 1)])).alias("cell"))
    right = postings.select("_id", "_th", F.col("term").alias("second"), F.col("at").alias("other"),
                            F.floor(F.col("at") / width).alias("cell"))
    near = F.abs(F.col("at") - F.col("other"))
    return left.join(right, ["_id", "_th", "second", "cell"]).where((near <= distance) & (near > 0)).drop("cell")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, _id, _th.

    A word is hit inside any occurrence of a window of ``window`` item words (all
    words of a shorter item).  Contaminated: a hit, and at least a twentieth of
    the words hit.  Null and empty texts have no words and no hits; items without
    words or id never match; repeated rows get the same answer each; empty
    tables on either side give no hits; other columns are not looked at.
    """
    matches = written(phrase_matches(docs, benchmark, window), "phrase-matches")
    covered = (matches.select("_id", "_th", F.explode(F.sequence("at", F.col("at") + F.col("span") - 1)).alias("word")).distinct()
               .groupBy("_id", "_th").agg(F.count(F.lit(1)).alias("n_hit")))
    named = (matches.select("_id", "_th", "item").distinct().groupBy("_id", "_th")
             .agg(F.array_sort(F.collect_list("item")).alias("items")))
    found = covered.join(named, ["_id", "_th"])
    rows = keyed(docs, "doc_id", F.size(raw_terms(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(found, ["_id", "_th"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "_id", "_th")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all columns."""
    bad = written(contamination(docs, benchmark).where("contaminated").select("_id", "_th").distinct(), "contaminated")
    return without(docs, bad)


def op9_phrase_index(spark, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("_id", "_th")


SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), b as (
  select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), bw as (
  select distinct item, least(13, len(ws)) as span, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') as g
  from (select *, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as i from b where len(ws) > 0)
), spans as (select distinct span from bw), dw as (
  select doc_id, i, span, array_to_string(ws[i:i + span - 1], ' ') as g
  from (select doc_id, ws, span, unnest(range(1, len(ws) - span + 2)) as i from d, spans where len(ws) >= span)
), m as (select doc_id, item, i, span from dw join bw using (span, g)),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + span)) as p from m) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
      from (select distinct doc_id, item from m) group by doc_id)
select d.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""
