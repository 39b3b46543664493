"""Quality rules that clean line by line before judging the document.

Each line is judged on punctuation, navigation and boilerplate; failing lines
are removed; a document that loses too much of its text is rejected.  Built-in
functions only; nothing is exploded, so there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrahaz.llm.common import documents, words_of

SYMBOLS = r"[#*$%&|<>]"
BOILERPLATE = (r"(?i)\b(cookie policy|privacy policy|terms of (use|service)|all rights reserved|copyright|click here|"
               r"sign up|log ?in|subscribe|share this|read more|javascript)\b")
NAVIGATION = r"(\|.*){3}|(>.*){2}|^\s*(home|menu|next|previous|back|top|search)\s*$"
MAX_LOST = 0.5


def occurrences(text: Column, pattern: str) -> Column:
    """How often a one-match-per-place pattern occurs."""
    return F.size(F.split(text, pattern, -1)) - F.lit(1)


def line_fails(line: Column) -> Column:
    """Punctuation: over a tenth of a line's signs are symbols, or a closing run of ``!!``;
    navigation: bars or arrows between short entries, or a lone menu word; boilerplate: a stock phrase."""
    length = F.length(line)
    symbols = occurrences(line, SYMBOLS)
    shouts = occurrences(line, "!!")
    return ((symbols * 10 > length) | (shouts * 20 > length)
            | F.lower(line).rlike(NAVIGATION) | line.rlike(BOILERPLATE))


def judge_lines(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """doc_id, base counts, verdict and the cleaned text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words are counted on
    the whole text (null: no words, no lines).  ``base_failed``: under 50 words,
    or more than half of the words lie in a 3-word window that the text holds
    twice (windows of one text are told apart by 64-bit hashes).  ``kept``: not base_failed, and the lines removed hold at most
    ``max_lost`` of the text's code points.  ``lost_chars``/``line_chars`` and
    ``cleaned`` (remaining lines joined by line ends) are further outputs.
    Repeated rows are judged one by one; an empty table gives an empty result;
    other columns are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", words_of(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"))
    with_word = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("words")
    three = F.when(n >= 3, F.arrays_zip(
        F.slice("words", 1, n - 2).alias("a"), F.slice("words", 2, n - 2).alias("b"), F.slice("words", 3, n - 2).alias("c")))
    counted = base.select(
        "doc_id", "text", "lines", n.cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        occurrences(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(with_word) - F.size(F.array_distinct(with_word))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(F.coalesce(three, F.array()), lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("w"), i.alias("i")))).alias("sorted"),
        F.filter("lines", lambda x: ~line_fails(x)).alias("good"))
    # neighbours in sorted order that hold the same words
    m = F.size("sorted")
    pairs = F.when(m >= 2, F.flatten(F.filter(F.zip_with(
        F.slice("sorted", 1, m - 1), F.slice("sorted", 2, m - 1),
        lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"]))), lambda p: p.isNotNull())))
    marked = counted.select("*", F.sort_array(F.array_distinct(F.coalesce(pairs, F.array().cast("array<int>")))).alias("at"))
    k = F.size("at")
    # windows that begin at ``at``: each covers up to its next neighbour, three words at most
    gaps = F.when(k >= 2, F.zip_with(F.slice("at", 1, k - 1), F.slice("at", 2, k - 1), lambda a, b: F.least(b - a, F.lit(3))))
    covered = F.when(k == 0, F.lit(0)).otherwise(
        F.lit(3) + F.aggregate(F.coalesce(gaps, F.array().cast("array<int>")), F.lit(0), lambda s, x: s + x))
    joined = F.array_join("good", "\n")
    judged = marked.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"),
        F.length("text").cast("long").alias("line_chars"),
        (F.length("text") - F.length(joined)).cast("long").alias("lost_chars"), joined.alias("cleaned"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("*", failed.alias("base_failed"),
                         (~failed & (F.col("lost_chars") <= max_lost * F.col("line_chars"))).alias("kept"))


def op2_line_rules(spark, sf_dir: str) -> DataFrame:
    return judge_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
         string_split(coalesce(text, ''), chr(10)) as lines
  from documents
), win as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)
), dup as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1
), cover as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest([i, i + 1, i + 2]) as p from dup) group by doc_id
), base as (
  select w.doc_id, len(words) as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as n_dup_lines,
         coalesce(c.n_repeat_words, 0) as n_repeat_words,
         length(text) as line_chars,
         length(text) - length(array_to_string(list_filter(lines, lambda x: not (
             (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) * 10 > length(x)
             or len(regexp_extract_all(x, '!!')) * 20 > length(x)
             or regexp_matches(lower(x), '(\|.*){3}|(>.*){2}|^\s*(home|menu|next|previous|back|top|search)\s*$')
             or regexp_matches(x, '(?i)\b(cookie policy|privacy policy|terms of (use|service)|all rights reserved|copyright|click here|sign up|log ?in|subscribe|share this|read more|javascript)\b'))),
           chr(10))) as lost_chars
  from w left join cover c using (doc_id)
), f as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and lost_chars <= 0.5 * line_chars as kept, lost_chars
from f
"""
