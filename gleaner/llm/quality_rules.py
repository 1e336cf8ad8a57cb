"""Quality rules with thresholds from mergeable quantile sketches instead of fixed cutoffs.

Every text is measured once; measures are logarithms of smoothed rates, which spread even where most documents have
none of what is counted. A KLL sketch of each measure is built per language and source, sketches of the sources are
merged into one per language and one for all, and a group with few documents takes the thresholds of the next larger
one. A threshold lies TIMES the distance of two quantiles beyond the outer one, so it follows both what is usual in a
group and how far its documents spread; quantiles that far inside hold while a fifth of a group is junk. A document is
kept if no measure lies beyond its group's thresholds. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut, with_runs, words

#: name: (what is counted, of what, and what is added to each): ln((part + a) / (whole + b)); True where low values are refused too.
MEASURES = {
    "symbol_rate": ("n_symbols", "word_chars", 2, 200, False),
    "repeated_line_rate": ("n_dup_lines", "_n_lines", 2, 20, False),
    "repeat_rate": ("n_repeat_words", "n_words", 8, 100, False),
    "stutter_rate": ("_stutters", "n_words", 2, 100, False),
    "capital_rate": ("_upper", "word_chars", 2, 100, False),
    "word_length": ("word_chars", "n_words", 50, 10, True),
}
#: The inner and outer quantile of a high threshold (a low one has their complements), and how many of their distances it lies beyond the outer one.
INNER, OUTER, TIMES = 0.1, 0.8, 1.5
#: Stands for the distance of the quantiles where that is zero: a group whose documents are all alike.
FLOOR = 0.1
#: Documents whose measures agree to so many decimals count once for the thresholds, so that copies do not set them.
ALIKE = 2
#: Documents that a group needs for thresholds of its own.
LEAST_ROWS = 200
#: Size of a sketch; its ranks are then right to about 0.05 %.
SKETCH = 4096


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` with the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the measures."""
    text = F.coalesce(F.col(text), F.lit(""))
    parts = docs.select(
        *keep,
        words(text).alias("_words"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).alias("_upper"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    hashed = parts.select(
        *keep,
        "n_symbols",
        "_upper",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    equal_next = F.zip_with("_hashes", F.slice("_hashes", 2, F.size("_hashes")), lambda a, b: F.when(a == b, True))
    windows = with_runs(hashed.withColumns({"_stutters": F.size(F.array_compact(equal_next)), "_windows": F.col("_hashes")}).drop("_hashes"), "_windows", 8)
    sorted_windows = F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    marked = windows.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), sorted_windows)).drop("_windows")
    n = F.size("_sorted")
    # places whose window equals the one before or after it in sorted order
    same = F.zip_with(
        F.slice("_sorted", 1, n - 1), F.slice("_sorted", 2, n - 1), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"]))
    )
    places = marked.withColumn("_at", F.array_sort(F.array_distinct(F.flatten(F.array_compact(same))))).drop("_sorted")
    covered = F.aggregate(
        F.zip_with(F.slice("_at", 1, F.size("_at") - 1), F.slice("_at", 2, F.size("_at") - 1), lambda a, b: F.least(b - a, F.lit(8))),
        F.lit(8).cast("long"),
        lambda total, step: total + step,
    )
    counted = places.withColumn("n_repeat_words", F.when(F.col("_at").isNotNull(), covered).otherwise(F.lit(0).cast("long"))).drop("_at")
    rate = lambda part, whole, a, b: F.round(F.log((F.col(part) + a) / (F.col(whole) + b)), 6)
    rates = [rate(*how[:4]).alias(name) for name, how in MEASURES.items()]
    return counted.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *rates)


def thresholds(rows: DataFrame, lang: str, source: str, least_rows: int = LEAST_ROWS, sketch: int = SKETCH) -> DataFrame:
    """Rows (lang, source, low_*, high_*, floors): the bounds of each measure, from the group's own sketch or a merged one.

    floors counts the bounds that stand on FLOOR.
    """
    alike = rows.groupBy(lang, source, *[F.round(m, ALIKE).alias(f"_{m}") for m in MEASURES]).agg(*[F.min(m).alias(m) for m in MEASURES])
    # every task sketches its own rows first, so that a hot source sends a few sketches and not its rows
    own = alike.groupBy(lang, source).agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, F.lit(sketch)).alias(m) for m in MEASURES])
    own = cut(own)
    merge = [F.kll_merge_agg_double(m, F.lit(sketch)).alias(f"_{m}") for m in MEASURES]
    by_lang = own.groupBy(F.col(lang).alias("_lang")).agg(F.sum("n").alias("_n"), *merge)
    of_all = own.agg(F.struct(*[F.kll_merge_agg_double(m, F.lit(sketch)).alias(m) for m in MEASURES])).scalar()
    joined = own.join(by_lang, own[lang].eqNullSafe(by_lang["_lang"])).withColumn("_all", of_all)
    places = F.array(*map(F.lit, (INNER, OUTER, 1 - OUTER, 1 - INNER)))
    quantiles = {}
    for m in MEASURES:
        best = F.when(F.col("n") >= least_rows, F.col(m)).when(F.col("_n") >= least_rows, F.col(f"_{m}")).otherwise(F.col(f"_all.{m}"))
        quantiles[m] = F.when(F.kll_sketch_get_n_double(best) > 0, F.kll_sketch_get_quantile_double(best, places))
    read = joined.select(lang, source, *[q.alias(m) for m, q in quantiles.items()])
    bounds, floors = [], []
    for m, (*_, both) in MEASURES.items():
        for name, inner, outer, sign in [("high", 0, 1, 1)] + [("low", 3, 2, -1)] * both:
            distance = sign * (F.col(m)[outer] - F.col(m)[inner])
            bounds.append((F.col(m)[outer] + sign * TIMES * F.when(distance > 0, distance).otherwise(FLOOR)).alias(f"{name}_{m}"))
            floors.append(F.when(distance > 0, 0).otherwise(1))
    return read.select(lang, source, *bounds, sum(floors).alias("floors"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang, source, the counts, the measures, base_failed, kept, reasons.

    base_failed: fewer than 20 words, or over 30 % of the words in 8-word windows that the text holds twice or more.
    kept is false if base_failed; else it is false if a measure lies outside the thresholds of the document's language
    and source, which learn only from rows that pass the base rules; a measure at a threshold is inside. A null text
    has no words and fails; null languages and sources are groups of their own; repeated rows are judged one by one
    and count once for the thresholds; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = measured(rows, ["doc_id", "lang", "source"])
    rows = cut(rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))))
    limits = thresholds(rows.where(~F.col("base_failed")), "lang", "source", least_rows)
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    judged = rows.join(limits, rows["lang"].eqNullSafe(limits["_lang"]) & rows["source"].eqNullSafe(limits["_source"]), "left")
    reasons = [F.when(F.col(m) > F.col(f"high_{m}"), F.lit(f"high {m}")) for m in MEASURES]
    reasons += [F.when(F.col(m) < F.col(f"low_{m}"), F.lit(f"low {m}")) for m, how in MEASURES.items() if how[4]]
    judged = judged.withColumn("reasons", F.array_compact(F.array(F.when(F.col("base_failed"), F.lit("base")), *reasons)))
    out = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *MEASURES, "base_failed"]
    return judged.select(*out, (F.size("reasons") == 0).alias("kept"), "reasons")
