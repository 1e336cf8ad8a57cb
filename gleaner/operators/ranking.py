"""Ranks of all users' pending postings at once, from texts to estimates.

A posting's terms are counted inside its row and go on as 64-bit hashes with their counts, so a text is read once and
never shuffled. What depends on the user (how many of their candidates hold a term, and the weights that follow) is
summed with partial sums. Postings then meet the weights of their user in slices: a group holds at most about ``SLICE``
postings and ``SHARD`` terms, however many a user has, so no single term of a posting is shuffled by itself.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.functions.numbers import LEVELS, coverage, scaled, whole_ranks
from gleaner.functions.resumes import facts_text, profile_sections
from gleaner.functions.text import PHRASES, STOP_WORDS, once, tokens, trimmed
from gleaner.operators.joins import materialized, met
from gleaner.operators.relevance import TITLE_WEIGHT, blend, blocked, skill_match, skill_overlap, with_learned

#: Words of a skill that say nothing on their own.
GENERIC_SKILL_WORDS = frozenset(
    """experience systems system development engineering design skills tools knowledge strong software programming languages language frameworks framework
    technologies concepts principles practices fundamentals working understanding proficiency familiarity basic advanced modern services platforms platform""".split()
)


#: Postings and terms of a user that meet in one group.
SLICE, SHARD = 32768, 1 << 21


_PLAIN, _ANY = re.compile("[a-z0-9+#]+"), regex.compile(r"[\p{L}\p{Nd}+#]+")


def _words(text: str | None) -> list[str]:
    """Words in lower case, phrases as one."""
    low = (text or "").lower()
    for phrase, term in PHRASES.items():
        if phrase in low:
            low = low.replace(phrase, f" {term} ")
    return (_PLAIN if low.isascii() else _ANY).findall(low)


def _strip(found: Counter) -> None:
    """Take signs off the ends of words; those that are one then are counted together."""
    for w in [w for w in found if w[0] in "+#" or w[-1] in "+#"]:
        found[w.strip("+#")] += found.pop(w)


class _Hashes(dict):
    """Hashes of words; 0 for those that are no terms."""

    def __missing__(self, word: str) -> int:
        term = (len(word) > 1 or word in ("r", "c") or word > "\x7f") and word not in STOP_WORDS
        self[word] = found = xxhash.xxh64_intdigest(word, 42) if term else 0
        return found


def _counted(texts: pa.Array, titles: pa.Array) -> pa.Array:
    """Structs (ids, counts) of the terms of texts; one of the title counts as ``TITLE_WEIGHT``."""
    known, ids, counts, ends = _Hashes(), [], [], [0]
    for text, title in zip(texts.to_pylist(), titles.to_pylist(), strict=True):
        found = Counter(_words(text))
        for w in _words(title):
            found[w] += TITLE_WEIGHT
        _strip(found)
        ids += map(known.__getitem__, found)
        counts += found.values()
        ends.append(len(ids))
    hashes = np.array(ids, dtype=np.uint64)
    terms = hashes != 0
    offsets = np.concatenate(([0], np.cumsum(terms)))[ends].astype(np.int32)
    arrays = [pa.array(hashes[terms].view(np.int64)), pa.array(np.array(counts, dtype=np.int32)[terms])]
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), x) for x in arrays], names=["ids", "counts"])


def posting_terms(postings: DataFrame, doc: str, title: Column | None, body: Column) -> DataFrame:
    """Rows (doc, ids, counts): each posting's terms (``functions.text.tokens``) as hashes, and how often it has them.

    One of the title counts as three. The counting goes by Arrow batches: as expressions, it would need a lambda for each
    word or a shuffle of all of them.
    """

    @F.arrow_udf("ids array<long>, counts array<int>")
    def counted(texts: pa.Array, titles: pa.Array) -> pa.Array:
        return _counted(texts, titles)

    made = counted(body, F.lit("") if title is None else title)
    return postings.select(doc, made.alias("t")).select(doc, "t.ids", "t.counts")


#: Terms of a group that are looked up together.
TOGETHER = 1 << 18


def _products(user: str, doc: str, schema: pa.Schema):
    """Sums over a slice of a user's postings and a shard of their terms: (user, doc, dot, square).

    A term of the shard that has no weight is one that a single posting holds.
    """

    def sums(postings: pa.Table, weights: pa.Table) -> pa.Table:
        order = np.argsort(weights["id"].to_numpy())
        known, idf, pw = (np.append(weights[c].to_numpy()[order], 0) for c in ("id", "idf", "pw"))
        known[-1] = np.iinfo(np.int64).max
        dots, squares = [], []
        for batch in postings.to_batches():  # as they came: a group is never copied whole
            if not len(batch):
                continue
            lists, counted = batch["ids"], batch["counts"].flatten().to_numpy()
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            dot, square = np.zeros(len(batch)), np.zeros(len(batch))
            shard, shards, single = (batch[c][0].as_py() for c in ("shard", "shards", "single"))
            row = np.repeat(np.arange(len(batch), dtype=np.int32), np.diff(ends))
            for i in range(0, len(flat), TOGETHER):
                ids, tf, rows = flat[i : i + TOGETHER], 1 + np.log(counted[i : i + TOGETHER]), row[i : i + TOGETHER]
                at = np.searchsorted(known, ids)
                found = (known[at] == ids) & (at < len(known) - 1)
                w = np.where(np.mod(ids, shards) == shard, tf * np.where(found, idf[at], single), 0.0)
                dot += np.bincount(rows, np.where(found, w * pw[at], 0.0), len(batch))
                square += np.bincount(rows, w * w, len(batch))
            dots.append(dot)
            squares.append(square)
        dot, square = (np.concatenate([np.zeros(0), *x]) for x in (dots, squares))
        return pa.table([postings[user], postings[doc], pa.array(dot), pa.array(square)], schema=schema)

    return sums


def candidate_similarities(terms: DataFrame, pending: DataFrame, profiles: DataFrame, user: str = "user_id", doc: str = "job_id", slice_of: int = SLICE, shard_of: int = SHARD) -> DataFrame:
    """Rows (user, doc, similarity) for each row of ``pending``: cosine of the profile's and the posting's TF-IDF weights.

    ``terms``: (doc, ids, counts) of ``posting_terms``; ``profiles``: (user, ids, counts), in the same form. A weight is
    (1 + ln count) * ln(1 + n / (1 + df)), n and df counted over the user's own candidates. A posting without terms has
    similarity 0; all of a user's are null if their profile has none. ``pending`` holds a pair once; a null user or
    posting meets nothing.
    """
    pairs = met(pending.select(user, doc).where(F.col(user).isNotNull() & F.col(doc).isNotNull()), terms, doc)
    # explode_outer and both columns: what is read here is then what the slices read, and Spark moves it once for both
    flat = pairs.select(user, F.explode_outer(F.arrays_zip("ids", "counts")).alias("t")).select(user, F.col("t.ids").alias("id"), F.col("t.counts").alias("k"))
    frequency = flat.where(F.col("id").isNotNull()).groupBy(user, "id").agg(F.count(F.when(F.col("k") > 0, 1)).alias("df"))
    wanted = profiles.select(user, F.explode(F.arrays_zip("ids", "counts")).alias("t")).select(user, F.col("t.ids").alias("id"), F.col("t.counts").alias("pf"))
    number = pending.groupBy(user).agg(F.count("*").cast("double").alias("n"))
    idf = F.log1p(F.col("n") / (1 + F.coalesce("df", F.lit(0))))
    weights = met(frequency.join(wanted, [user, "id"], "full").where("df > 1 OR pf IS NOT NULL"), number, user)
    weights = weights.select(user, "id", idf.alias("idf"), F.coalesce((1 + F.log("pf")) * idf, F.lit(0.0)).alias("pw"), F.col("pf").isNotNull().alias("named"))
    sizes = weights.groupBy(user).agg(F.count("*").alias("v"), F.sqrt(F.sum(F.when(F.col("named"), F.col("pw") * F.col("pw")))).alias("pnorm"))
    at_least_one = lambda x: F.greatest(F.lit(1), F.ceil(x)).cast("long")
    split = number.join(sizes, user, "left").select(user, at_least_one(F.col("n") / slice_of).alias("slices"), at_least_one(F.coalesce("v", F.lit(0)) / shard_of).alias("shards"), F.log1p(F.col("n") / 2).alias("single"), "pnorm")
    placed = met(pairs, split, user).withColumn("slice", F.pmod(F.xxhash64(doc), "slices"))
    placed = placed.select(user, doc, "ids", "counts", "single", "shards", "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    dealt = met(weights, split, user).withColumn("shard", F.pmod("id", "shards"))
    dealt = dealt.select(F.col(user).alias("_user"), "id", "idf", "pw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "shard")
    kinds = {f.name: f.dataType for f in pairs.schema}
    schema = f"{user} {kinds[user].simpleString()}, {doc} {kinds[doc].simpleString()}, dot double, square double"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    sums = placed.groupBy(user, "slice", "shard").cogroup(dealt.groupBy("_user", "slice", "shard")).applyInArrow(_products(user, doc, arrow), schema)
    sums = sums.groupBy(user, doc).agg(F.sum("dot").alias("dot"), F.sqrt(F.sum("square")).alias("norm"))
    rows = met(pending.select(user, doc).join(sums, [user, doc], "left"), split.select(user, "pnorm"), user, how="left")
    return rows.select(user, doc, F.when(F.col("pnorm") > 0, F.coalesce(F.try_divide(F.col("dot"), F.col("norm") * F.col("pnorm")), F.lit(0.0))).alias("similarity"))


def specific(words: Column) -> Column:
    """A skill's tokens without those that say nothing on their own, unless it has no others."""
    left = F.filter(words, lambda w: ~w.isin(*sorted(GENERIC_SKILL_WORDS)))
    return F.when(F.size(left) > 0, left).otherwise(words)


def level_distance(level: Column, accepted: Column) -> Column:
    """Levels between a posting's and the nearest of an array of accepted ones; one where either is unknown."""
    order = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    places = F.filter(F.transform(accepted, lambda x: F.try_element_at(order, x)), lambda x: x.isNotNull())
    return F.coalesce(F.array_min(F.transform(places, lambda p: F.abs(p - F.try_element_at(order, level)))), F.lit(1))


def signals(known: DataFrame, words: DataFrame, similar: DataFrame | None, user: str, doc: str) -> DataFrame:
    """Rows (user, doc, *signals) of ``blend`` from pairs with their facts and profile.

    ``known``: (user, doc, seniority, skills, digest, years, work_mode, markdown, profile, max_years, levels,
    needs_sponsorship), where profile is the part of the markdown that is matched; ``words`` and ``similar``: (user, doc,
    similarity) by words and by vectors.
    """
    listed = F.filter(F.transform(F.coalesce("skills", F.array().cast("array<string>")), trimmed), lambda s: s.isNotNull())
    rows = known.select("*", F.transform(listed, lambda s: F.struct(s.alias("name"), tokens(s).alias("tokens"))).alias("_skills"))
    # a profile is far longer than the skills: what they share with it is found once, and each skill is held against that
    shared = lambda skills, profile, build: once(F.array_intersect(F.flatten(F.transform(skills, lambda s: s["tokens"])), profile), build)
    named = F.transform("_skills", lambda s: F.struct(s["name"].alias("name"), specific(s["tokens"]).alias("tokens")))
    rows = rows.withColumn("_match", shared(named, F.col("_whole"), lambda x: skill_match(named, x)))
    near, most, years = F.greatest(F.lit(0), F.col("years") - F.col("max_years") + 3), F.coalesce("max_years", F.lit(0)), F.col("years")
    rows = rows.select(
        user,
        doc,
        shared(F.col("_skills"), F.col("_profile"), lambda x: skill_overlap(F.transform("_skills", lambda s: s["tokens"]), x)).alias("skills"),
        coverage(F.col("_match.matched"), F.col("_match.missing")).alias("coverage"),
        F.when((most > 0) & years.isNotNull(), near).otherwise(0).alias("near"),
        level_distance(F.col("seniority"), F.col("levels")).alias("gap"),
        (F.coalesce("work_mode", F.lit("")) == "remote").cast("int").alias("remote"),
        blocked(F.col("digest"), listed, F.col("markdown"), F.coalesce("needs_sponsorship", F.lit(False))).alias("blocked"),
        F.coalesce((most > 0) & (years > most), F.lit(False)).alias("too_many_years"),
    )
    rows = rows.join(words.select(user, doc, F.col("similarity").alias("words")), [user, doc], "left")
    if similar is None:
        return rows.withColumn("embedding", F.lit(None).cast("double"))
    return rows.join(similar.select(user, doc, F.col("similarity").alias("embedding")), [user, doc], "left")


def rank_pending(profiles: DataFrame, postings: DataFrame, pending: DataFrame, facts: DataFrame, similar: DataFrame | None = None, learned: DataFrame | None = None, user: str = "user_id", doc: str = "job_id") -> DataFrame:
    """Rows (user, doc, similarity, blend, exact, estimate): the rank, from 35 to 85, of each pending posting of every user.

    ``profiles``: (user, markdown, max_years, levels, needs_sponsorship); ``postings``: (doc, title, body); ``pending``:
    (user, doc), a pair once; ``facts``: (doc, seniority, skills, digest, years, work_mode) of the postings that have
    them; ``similar``: (user, doc, similarity) by vectors; ``learned``: (user, doc, learned, n).

    A posting without facts stands by the similarity of its words to the whole profile, drawn linearly to 35..85 over
    all of the user's candidates and rounded (50 for all if the profile has no terms). One with facts stands by its
    blend (and what was learned), drawn to 35..85 over those that have facts. ``exact`` is not rounded there, so that the
    best keep their order; ``estimate`` is what is stored. Null texts are empty; users without a profile get no rows.
    """
    pending = met(pending.select(user, doc), profiles.select(user), user)
    markdown = F.coalesce("markdown", F.lit(""))
    wanted = materialized(profiles.select(user, "max_years", "levels", "needs_sponsorship", markdown.alias("markdown"), profile_sections(markdown).alias("profile")))
    terms = posting_terms(postings, doc, F.col("title"), F.col("body"))
    by_words = candidate_similarities(terms, pending, posting_terms(wanted, user, None, F.col("markdown")), user, doc)
    by_words = materialized(by_words)
    estimated = whole_ranks(by_words, [user], "similarity", "estimate")

    known = met(pending, facts, doc)
    described = postings.select(doc, "title").join(facts, doc).select(doc, "title", facts_text(F.col("seniority"), F.col("skills"), F.col("digest")).alias("body"))
    described = posting_terms(described, doc, F.col("title"), F.col("body"))
    words = candidate_similarities(described, known.select(user, doc), posting_terms(wanted, user, None, F.col("profile")), user, doc)
    have = wanted.select("*", F.array_distinct(tokens(F.col("profile"))).alias("_profile"), F.array_distinct(tokens(F.col("markdown"))).alias("_whole"))
    blended = blend(materialized(signals(met(known, have, user), words, similar, user, doc)), [user]).select(user, doc, "blend")
    if learned is not None:
        mixed = with_learned(blended.withColumnRenamed(doc, "id"), learned.withColumnRenamed(doc, "id"), user)
        order = mixed.select(user, F.col("id").alias(doc), "blend", F.col("final").alias("value"))
    else:
        order = blended.withColumn("value", F.col("blend"))
    order = scaled(materialized(order), [user], "value", "scaled").select(user, doc, "blend", "scaled")
    rows = estimated.join(order, [user, doc], "left")
    return rows.select(user, doc, "similarity", "blend", F.coalesce("scaled", F.col("estimate").cast("double")).alias("exact"), F.coalesce(F.round("scaled").cast("int"), "estimate").alias("estimate"))
