"""License scan by diagonal voting.

Every run of three words of a text is hashed and joined to the places where the license templates hold the same run.
A hit votes for its diagonal, the distance between its place in the text and in the template; neighbouring diagonals
(a word put in or left out) are merged, and what a merged diagonal covers of its template decides whether the span is
that license. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import cut, with_runs

#: The phrases of the base rule and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices of public licenses, lower case.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "all rights reserved"),
]

#: Words of a run; diagonals this close are one; share of a template's words that a span must hold.
RUN, SLACK, LEAST = 3, 2, 0.75


def word_text(text):
    """A text column lower-cased, its words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined by one blank; null is empty.

    The Kelvin sign is put aside first: lower() would make it the letter k, but only A-Z are to be lower-cased.
    """
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("å")))
    return F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def template_runs(spark: SparkSession, templates: list[tuple[str, str]], run: int) -> DataFrame:
    """Rows (template, label, n_template, place, run): every run of words of every template; a few hundred rows, fixed by the parameter."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    rows = rows.withColumn("words", F.split("text", " "))
    rows = with_runs(rows.withColumn("runs", F.transform("words", lambda w: F.xxhash64(w))), "runs", run)
    return rows.select("template", "label", F.size("words").alias("n_template"), F.posexplode("runs").alias("place", "run"))


def spaces(text):
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def phrase_places(padded, phrase: str):
    """Struct (n, first, last) of the places of ``phrase`` in a text column of words with blanks between and around them."""
    parts = F.split(padded, f"(?<= ){phrase}(?= )", -1)
    n = (F.size(parts) - 1).cast("long")
    last = spaces(padded) - spaces(F.element_at(parts, -1)) - phrase.count(" ") - 1
    found = F.struct(n.alias("n"), (spaces(parts[0]) - 1).cast("long").alias("first"), last.cast("long").alias("last"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    return F.when(F.contains(padded, F.lit(f" {phrase} ")), found).otherwise(none)


def voted_spans(runs: DataFrame, grams: DataFrame, slack: int = SLACK, least: float = LEAST) -> DataFrame:
    """Rows (row, template, label, start, end, share): verified spans from hits.

    ``runs``: (row, hits array<struct<at, run>>), the runs of a text that occur in some template.
    A span is verified if the template words under its hits are at least ``least`` of the template and the span is
    not longer than the template by more than ``slack`` words for each of its four words.
    """
    hits = runs.select("row", F.explode("hits").alias("hit")).select("row", "hit.*").join(F.broadcast(grams), "run")
    votes = hits.withColumn("diagonal", F.col("at") - F.col("place"))
    lines = votes.groupBy("row", "template", "label", "n_template", "diagonal").agg(
        F.collect_set("place").alias("places"), F.min("at").alias("start"), (F.max("at") + RUN).alias("end")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + RUN - 1)))))
    lines = lines.withColumn("whole", covered / F.col("n_template") >= least)  # needs no neighbour
    order = Window.partitionBy("row", "template").orderBy("diagonal", "start")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > slack) | F.col("whole") | F.lag("whole").over(order)
    new = F.coalesce(apart, F.lit(True))
    merged = (
        lines.withColumn("group", F.sum(new.cast("int")).over(order))
        .groupBy("row", "template", "label", "n_template", "group")
        .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("start").alias("start"), F.max("end").alias("end"))
    )
    spans = merged.withColumn("share", covered / F.col("n_template"))
    fits = F.col("end") - F.col("start") <= F.col("n_template") * (1 + slack / 4) + slack
    return spans.where((F.col("share") >= least) & fits).select("row", "template", "label", "start", "end", "share")


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, spans, score.

    n_base counts the places of the base phrases, first_word and last_word are the smallest and largest of their start
    words; labels adds those of the verified spans; spans lists (label, start, end, share) in order. score is 1 for a
    base phrase, else the best share of a template, 0 where nothing is found. A null or empty text has no words and
    finds nothing; repeated rows are scanned one by one; other columns are not read; an empty table gives no rows.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    if RUN > min(len(t.split()) for _, t in templates):
        raise ValueError(f"a template needs {RUN} words")
    grams = template_runs(docs.sparkSession, templates, RUN)
    known = [r.run for r in grams.select("run").distinct().collect()]  # fixed by the templates
    texts = docs.select(F.col(doc_id).alias("doc_id"), word_text(F.col(text)).alias("words"))
    split = texts.select("doc_id", F.concat(F.lit(" "), "words", F.lit(" ")).alias("padded"), F.when(F.col("words") != "", F.split("words", " ")).otherwise(F.array().cast("array<string>")).alias("words"))
    hashed = split.select("doc_id", "padded", F.size("words").cast("long").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("runs"))
    hashed = with_runs(hashed, "runs", RUN)
    found = hashed.select(
        "doc_id",
        "n_words",
        F.array_compact(F.transform("runs", lambda x, i: F.when(x.isin(known), F.struct(i.alias("at"), x.alias("run"))))).alias("hits"),
        *[phrase_places(F.col("padded"), p).alias(f"p{k}") for k, p in enumerate(phrases)],
    )
    each = [F.col(f"p{k}") for k in range(len(phrases))]
    labels = [F.when(p["n"] > 0, F.lit(label)) for p, label in zip(each, phrases.values(), strict=True)]
    rows = cut(
        found.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "n_words",
            "hits",
            sum(p["n"] for p in each).alias("n_base"),
            F.array_min(F.array(*[p["first"] for p in each])).alias("first_word"),
            F.array_max(F.array(*[p["last"] for p in each])).alias("last_word"),
            F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
        )
    )
    spans = voted_spans(rows.where(F.size("hits") > 0).select("row", "hits"), grams)
    scanned = spans.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "label", "share"))).alias("spans"), F.max("share").alias("best")
    )
    none = F.array().cast("array<struct<start: int, end: int, label: string, share: double>>")
    joined = rows.join(scanned, "row", "left").withColumn("spans", F.coalesce("spans", none))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.array_distinct(F.transform("spans", lambda s: s["label"])))), ",").alias("labels"),
        "spans",
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
