"""Line-first quality rules, as DataFrame functions only.

Each line with a word is judged alone: symbols, shouting, navigation bars, boilerplate phrases, lines of many
words without any punctuation, lines of few words repeated, and copies of an earlier line fail. What is left
of the text decides: a document that loses more than `max_lost` percent of its word characters is rejected,
and so is one that fails the base rules (too few words, or too many inside repeated 5-word runs).

Everything happens inside a row, so there is no shuffle and no state, and the columns of a row are built in
stages, each array once. Equal 5-word runs are found by their 64-bit hashes; positions are only tracked in
texts that have any.

Null text: no words, all counts 0, base_failed, not kept. Lines without a word are neither judged nor counted.
Repeated rows and null ids are rows like others; other columns of the table are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import pick

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
NAVIGATION = r"\|[^|]*\||(»|›|::|>>)[^»›:>]*(»|›|::|>>)"
BOILERPLATE = r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept cookies|click here|sign up|log in|subscribe now|newsletter|enable javascript|lorem ipsum|share on (facebook|twitter))\b"
MAX_LOST, MIN_WORDS, MAX_REPEATED = 50, 10, 20


def line_passes(line: Column) -> Column:
    """The rules for one line; each is cheap and needs the line alone."""
    chars = F.length(F.regexp_replace(line, SPACES, ""))
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    words = F.split(F.lower(line), SPACES)
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) * 10 > chars
    marks = F.regexp_count(line, F.lit("!"))
    shouting = (marks >= 3) & (marks * 5 > n)
    bare = (n >= 10) & ~line.rlike(r"[.,;:!?]")
    few = (n >= 10) & (F.size(F.array_distinct(words)) * 10 < n * 3)
    return ~(symbols | shouting | line.rlike(NAVIGATION) | line.rlike(BOILERPLATE) | bare | few)


def measured(docs: DataFrame, text: str = "text", max_lost: int = MAX_LOST) -> DataFrame:
    """docs' rows as struct `row`, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned."""
    empty = F.array().cast("array<string>")
    source = F.col("row")[text]
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = out.select(
        "row",
        F.coalesce(F.filter(F.split(source, SPACES), lambda w: w != ""), empty).alias("words"),
        F.coalesce(F.filter(F.split(source, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), empty).alias("lines"),
    )
    runs = F.transform(F.sequence(F.lit(0), F.size("words") - 5), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(5)]))
    out = out.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(source, F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        "lines",
        F.array_distinct("lines").alias("distinct_lines"),
        F.when(F.size("words") >= 5, runs).alias("runs"),
    )
    repeats = F.size(F.array_distinct("runs")) < F.size("runs")
    out = out.withColumn("tagged", F.when(repeats, F.array_sort(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, at: F.coalesce(x["h"] == F.get("tagged", at)["h"], F.lit(False))
    out = out.withColumn("at", F.array_sort(F.transform(F.filter("tagged", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])))
    # each run covers 5 words; where the next one begins sooner only those up to it are new
    covered = F.aggregate(F.transform("at", lambda p, k: F.coalesce(F.least(F.get("at", k + 1) - p, F.lit(5)), F.lit(5))), F.lit(0).cast("long"), lambda s, x: s + x)
    out = out.select(
        "row", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size("distinct_lines")).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "lines",
        F.filter("distinct_lines", line_passes).alias("good_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    left = F.length(F.regexp_replace(F.array_join("good_lines", ""), SPACES, ""))
    # always true, but not foldable: else a filter on these columns would be pushed below the stages, with all of
    # their arrays computed again for each element
    whole = F.monotonically_increasing_id() >= 0
    return out.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (whole & ~failed & ((F.col("word_chars") - left) * 100 <= max_lost * F.col("word_chars"))).alias("kept"),
        F.when(F.size("lines") == F.size("good_lines"), source).otherwise(F.array_join("good_lines", "\n")).alias("cleaned"),
    )


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_lost: int = MAX_LOST) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned)."""
    out = measured(pick(docs, doc_id, text).toDF("doc_id", "text"), "text", max_lost)
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned")


def passing(docs: DataFrame, text: str = "text", max_lost: int = MAX_LOST) -> DataFrame:
    """The rows of docs that are kept, all columns, with the failing lines taken out of the text."""
    out = measured(docs, text, max_lost).where("kept")
    return out.select(*[F.col("cleaned").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), r AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n
  FROM (SELECT doc_id, i, words[i:i + 4] AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w))
), c AS (
  SELECT doc_id, sum(least(5, coalesce(after - i, 5))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM r WHERE n > 1) GROUP BY doc_id
), g AS (
  SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         list_filter(list_distinct(lines), lambda x: NOT (
           (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) * 10 > length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))
           OR (length(x) - length(replace(x, '!', '')) >= 3 AND (length(x) - length(replace(x, '!', ''))) * 5 > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
           OR regexp_matches(x, '@NAVIGATION@')
           OR regexp_matches(x, '@BOILERPLATE@')
           OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 10 AND NOT regexp_matches(x, '[.,;:!?]'))
           OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 10 AND len(list_distinct(regexp_split_to_array(lower(x), '[\x20\x09-\x0D]+'))) * 10 < len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) * 3))) AS good
  FROM w LEFT JOIN c ON w.doc_id IS NOT DISTINCT FROM c.doc_id
), v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM g)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND (word_chars - length(regexp_replace(array_to_string(good, ''), '[\x20\x09-\x0D]+', '', 'g'))) * 100 <= 50 * word_chars AS kept
FROM v
""".replace("@NAVIGATION@", NAVIGATION).replace("@BOILERPLATE@", BOILERPLATE)
