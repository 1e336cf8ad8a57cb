"""Spelling variants by an even-partition pigeonhole join.

A word of n code points falls into two segments, of n // 2 code points and of the rest. One edit leaves one of them
whole, so of two words one edit apart the longer one (or either, if they are equally long) holds the first segment of
the other at its start, or the second one, shifted by the difference of the lengths, at its end. Words are indexed by
(length, segment) and probed with the substrings at these places for words of equal length and of one code point less;
what meets is verified to be one edit apart and deduplicated.

A segment that many words share (``CROWDED``) would bring all of them together. Its words are split on: of the other
segment, too, one half must be whole, so they meet by the shared segment and that half, and so on, until all but one
code point is shared. The same pigeonhole holds at each step, so no pair is lost, and a word meets at most ``CROWDED``
others by a key, or as many as differ from it in a single place.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut

#: Code points and occurrences of a word that counts; times that a form is more frequent than its variant.
LEAST_CHARS, LEAST_COUNT, FACTOR = 7, 2, 10
#: Code points of a word.
LETTERS = "[A-Za-zÀ-ÿ]"
#: Of so many runs about one loses a code point, as the contract of the query has it; 0 leaves texts as they are.
EVERY = 31
#: Words of a key above which it is split on.
CROWDED = 512


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 0, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """Rows (word, n): the words of all texts with A-Z lower-cased, and their occurrences.

    With ``every``, a run loses a code point where that number divides the CRC-32 of doc_id, colon and run; which one
    is the CRC-32 modulo its length.
    """
    lower = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    found = F.regexp_extract_all(lower, F.lit(f"{LETTERS}{{{least_chars},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("word"))
    if every:
        runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "word")))
        at = (F.col("h") % F.length("word")).cast("int")
        short = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.withColumn("word", F.when(F.col("h") % every == 0, short).otherwise(F.col("word")))
    counted = runs.groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= least_chars) & (F.col("n") >= least_count))


def _spans(rows: DataFrame, word: str, spans: Column, shift) -> DataFrame:
    """``rows`` for each of ``spans`` (begin, end), where an edit may be, with the key: all of the word outside it.

    Spans are those of the indexed word; a word that is longer by ``shift`` has its own end so much further on.
    """
    rows = rows.withColumn("span", F.explode(spans)).withColumns({"begin": F.col("span.begin"), "end": F.col("span.end")}).drop("span")
    rest = F.substring(word, F.col("end") + 1 + shift, F.length(word))
    return rows.withColumn("key", F.xxhash64(F.length(word) - shift, "begin", "end", F.substring(word, F.lit(1), F.col("begin")), rest))


def _halves(begin: Column, end: Column) -> Column:
    """The spans of two segments: where an edit may be if the first one is whole, and if the second one is."""
    half = F.floor((begin + end) / 2).cast("int")
    return F.array(F.struct(half.alias("begin"), end.alias("end")), F.struct(begin.alias("begin"), half.alias("end")))


def _split_on(rows: DataFrame, word: str, crowded: DataFrame, shift) -> DataFrame:
    """``rows`` with the crowded keys replaced by those of both halves of their spans."""
    met = rows.join(crowded, "key", "left").drop("key")
    same = F.array(F.struct("begin", "end"))
    return _spans(met.withColumn("spans", F.when(F.col("crowded"), _halves(F.col("begin"), F.col("end"))).otherwise(same)).drop("begin", "end"), word, F.col("spans"), shift).drop("spans", "crowded")


def near_pairs(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Rows (word, n, other, m): each two rows of ``words`` (word, n) that are one edit apart, once, the shorter or smaller word first."""
    length = F.length("word")
    index = _spans(words.select("word", "n"), "word", _halves(F.lit(0), length), F.lit(0))
    longer = words.select(F.col("word").alias("other"), F.col("n").alias("m"), F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    probes = _spans(longer, "other", _halves(F.lit(0), F.length("other") - F.col("longer")), F.col("longer"))
    while True:
        index, probes = cut(index), cut(probes)
        many = index.where(F.col("end") - F.col("begin") > 1).groupBy("key").agg(F.count("*").alias("words")).where(F.col("words") > crowded)
        many = cut(many.select("key", F.lit(True).alias("crowded")))
        if many.isEmpty():
            break
        index, probes = _split_on(index, "word", many, F.lit(0)), _split_on(probes, "other", many, F.col("longer"))
    met = index.join(probes, "key").where((F.col("longer") == 1) | (F.col("word") < F.col("other")))
    return met.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "m").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) from rows (word, form) without cycles: the last form that each word leads to, by doubling of the steps."""
    known = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = cut(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if known.where("moved").isEmpty():
            return known.select("word", "root")
        known = known.drop("moved")


def spelling_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 0, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, factor: int = FACTOR, crowded: int = CROWDED) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n): every word with the more frequent word it is a variant of.

    Words are runs of letters (``LETTERS``) with A-Z lower-cased, of ``least_chars`` code points and ``least_count``
    occurrences or more. Words are near if one inserted, deleted or replaced code point makes one of the other. A word's
    form is its most frequent near word (of equals the smallest by code points), if that occurs ``factor`` times as
    often or more, else null; its root is where forms lead in the end, or the word itself. Null and empty texts have no
    words; a null doc_id is an empty one; repeated rows count again; other columns are not read; an empty table gives no
    rows.
    """
    words = cut(word_counts(docs, doc_id, text, every, least_chars, least_count))
    pairs = near_pairs(words, crowded)
    near = pairs.select("word", "n", "other", "m").unionByName(pairs.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"), F.first("n").alias("own"))
    frequent = -F.col("best.m") >= factor * F.col("own")
    best = cut(best.select("word", "n_near", F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.m")).alias("form_n")))
    rows = words.join(best, "word", "left").join(roots(best.where("form IS NOT NULL")), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


_LATIN = "".join(map(chr, range(0xC0, 0x100)))
_SIGNS = "".join(map(chr, range(0x21, 0x61))).replace("'", "''")

#: All pairs of words, for small tables: CRC-32 by its table, byte by byte; levenshtein() goes by bytes there, so
#: each letter beyond ASCII becomes a sign first.
SPELLING_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT i AS start, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT start, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY start) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS k, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
                                             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM counted, crc_table
), results AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n, length(word) AS size, translate(word, '{_LATIN}', '{_SIGNS}') AS signs
  FROM results WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM words a JOIN words b ON b.size BETWEEN a.size - 1 AND a.size + 1 AND a.word <> b.word
  WHERE levenshtein(a.signs, b.signs) = 1
), best AS (SELECT word, count(*) AS n_near, min((-m, other)) AS b, any_value(n) AS n FROM near GROUP BY word),
forms AS (SELECT word, b[2] AS form, -b[1] AS form_n FROM best WHERE -b[1] >= 10 * n),
reached AS (
  SELECT word, form AS root, 1 AS k FROM forms UNION ALL SELECT r.word, f.form, k + 1 FROM reached r JOIN forms f ON r.root = f.word
), roots AS (SELECT word, arg_max(root, k) AS root FROM reached GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM words w LEFT JOIN best USING (word) LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
"""
