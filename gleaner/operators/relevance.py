"""Relevance of documents to a profile: TF-IDF cosine, skill measures, the standardized blend and learned estimates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.numbers import learned_weight, scaled, z_scores
from gleaner.operators.joins import met

#: Weights of the standardized signals, and what a blocker or too many years cost.
WEIGHTS = {"embedding": 2.0, "words": 1.0, "skills": 1.0, "coverage": 1.0, "near": -1.0, "gap": -0.5, "remote": 0.5}
BLOCKED, TOO_MANY_YEARS = 1.5, 4.0
TITLE_WEIGHT = 3


def term_counts(docs: DataFrame, keys: list[str], title_tokens: str | None, body_tokens: str) -> DataFrame:
    """Rows (*keys, term, f): how often a document has a term; one of its title counts three times."""
    body = docs.select(*keys, F.explode(body_tokens).alias("term"), F.lit(1).alias("f"))
    if title_tokens:
        body = body.unionByName(docs.select(*keys, F.explode(title_tokens).alias("term"), F.lit(TITLE_WEIGHT).alias("f")))
    return body.groupBy(*keys, "term").agg(F.sum("f").alias("f"))


def similarities(counts: DataFrame, profile: DataFrame, docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows (doc, similarity): cosine of a profile's and each document's weights (1 + ln f) * ln(1 + n / (1 + df)).

    df counts the documents of ``docs`` that have a term, n all of them, so that scores are relative to the
    candidates. ``counts``: (doc, term, f); ``profile``: (term, f). Documents without terms have similarity 0; all
    similarities are null if the profile has no terms. Only sums by document and term are shuffled.
    """
    total = docs.agg(F.count("*").cast("double")).scalar()
    frequency = counts.groupBy("term").agg(F.count("*").alias("df"))
    wanted = profile.select("term", F.col("f").alias("pf"))
    idf = F.log1p(total / (1 + F.coalesce("df", F.lit(0))))
    mine = wanted.join(frequency, "term", "left").select("term", ((1 + F.log("pf")) * idf).alias("pw"))
    norm = mine.agg(F.sqrt(F.sum(F.col("pw") * F.col("pw")))).scalar()
    terms = frequency.join(wanted, "term", "left").select("term", idf.alias("idf"), F.coalesce((1 + F.log("pf")) * idf, F.lit(0.0)).alias("pw"))
    weighed = met(counts, terms, "term").withColumn("w", (1 + F.log("f")) * F.col("idf"))
    sums = weighed.groupBy(doc).agg(F.sum(F.col("w") * F.col("pw")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    value = F.when(norm > 0, F.coalesce(F.try_divide(F.col("dot"), F.col("norm") * norm), F.lit(0.0)))
    return docs.select(doc).join(sums, doc, "left").select(doc, value.alias("similarity"))


def ranked(similar: DataFrame) -> DataFrame:
    """``similar`` with the whole estimate: the similarity drawn linearly to 35..85, 85 where all are equal, 50 where it is null."""
    ends = similar.agg(F.struct(F.min("similarity").alias("low"), F.max("similarity").alias("high"))).scalar()
    share = F.when(ends["high"] > ends["low"], (F.col("similarity") - ends["low"]) / (ends["high"] - ends["low"])).otherwise(1.0)
    exact = F.when(F.col("similarity").isNull(), 50.0).otherwise(35 + 50 * share)
    return similar.withColumn("estimate", F.round(exact).cast("int"))


def pending_ranks(estimates: DataFrame, blended: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """Rows (*keys, doc, exact, estimate): the rank of each pending posting of a user from 35 to 85.

    ``estimates``: (*keys, doc, estimate) by words alone, for all of them; ``blended``: (*keys, doc, value), the blend
    with what was learned, for those that have facts. Where there is a value its scale over the user's own values
    stands, exact and rounded, else the estimate.
    """
    fresh = scaled(blended, keys, "value", "scaled").select(*keys, doc, "scaled")
    joined = estimates.join(fresh, [*keys, doc], "left")
    return joined.select(*keys, doc, F.coalesce("scaled", F.col("estimate").cast("double")).alias("exact"), F.coalesce(F.round("scaled").cast("int"), "estimate").alias("estimate"))


#: A posting's demand for a clearance or citizenship, and a profile that could meet it.
NEEDS_CLEARANCE = r"(?i)\b(?:security|secret|government|dod|sci|public trust)[- ]+clearance\b|\bclearable\b|\bts/sci\b|\bu\.?s\.? citizen(?:ship)?\b|must be a citizen|\bitar\b"
SHOWS_CLEARANCE = "(?i)clearance|citizen"


def blocked(digest: Column, skills: Column, profile: Column, needs_sponsorship: Column) -> Column:
    """Whether a posting's digest or skills demand what the profile does not show; who needs sponsorship cannot show it."""
    demanded = F.concat_ws(" ", F.coalesce(digest, F.lit("")), F.array_join(skills, " ")).rlike(NEEDS_CLEARANCE)
    return demanded & (needs_sponsorship | ~F.coalesce(profile, F.lit("")).rlike(SHOWS_CLEARANCE))


def skill_overlap(skills: Column, profile: Column) -> Column:
    """Share of the skills (arrays of tokens) all of whose tokens the profile has; 0.5 where none is listed."""
    listed = F.filter(skills, lambda s: F.size(s) > 0)
    held = F.filter(listed, lambda s: F.size(F.array_except(s, profile)) == 0)
    return F.when(F.size(listed) == 0, 0.5).otherwise(F.size(held) / F.size(listed))


def skill_match(skills: Column, profile: Column, most: int = 8) -> Column:
    """Struct (matched, missing) of skills (structs of name and tokens), by any token, in order, at most ``most`` of each."""
    listed = F.filter(skills, lambda s: F.size(s["tokens"]) > 0)
    names = lambda found: F.slice(F.transform(F.filter(listed, lambda s: F.arrays_overlap(s["tokens"], profile) == F.lit(found)), lambda s: s["name"]), 1, most)
    return F.struct(names(True).alias("matched"), names(False).alias("missing"))


def blend(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """``candidates`` with blend: the weighted z-scores of its signals within each key, minus the penalties.

    Signals: embedding, words, skills, coverage, near, gap, remote; embedding and coverage may be null and then count
    as average. blocked and too_many_years are booleans.
    """
    rows = z_scores(candidates, keys, list(WEIGHTS))
    value = sum((F.lit(w) * F.col(f"z_{c}") for c, w in WEIGHTS.items()), F.lit(0.0))
    value = value - F.when(F.col("blocked"), BLOCKED).otherwise(0.0) - F.when(F.col("too_many_years"), TOO_MANY_YEARS).otherwise(0.0)
    return rows.withColumn("blend", value).drop(*[f"z_{c}" for c in WEIGHTS])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns in double precision; 0 for different lengths or a zero vector."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(product(a, b), F.sqrt(product(a, a)) * F.sqrt(product(b, b))), F.lit(0.0))).otherwise(0.0)


def normalized(vector: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double")))
    return F.when(length > 0, F.transform(vector, lambda v: v.cast("double") / length)).otherwise(F.transform(vector, lambda v: v.cast("double")))


def ridge_fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(weights, mean, bias) of a ridge regression on centred rows; None without rows, without penalty, or if it is singular."""
    if not len(x) or penalty <= 0:
        return None
    mean, bias = x.mean(0), float(y.mean())
    z = x - mean
    try:
        factor = np.linalg.cholesky(z.T @ z + penalty * np.eye(x.shape[1]))
    except np.linalg.LinAlgError:
        return None
    return np.linalg.solve(factor.T, np.linalg.solve(factor, z.T @ (y - bias))), mean, bias


def learned_estimates(scored: DataFrame, pending: DataFrame, user: str = "user_id", least: int = 10, most: int = 3000, penalty: float = 1.0) -> DataFrame:
    """Rows (user, id, learned, n): ridge estimates of pending vectors from each user's own newest ``most`` scores.

    ``scored``: (user, vector, score, created_at, id); ``pending``: (user, id, vector). One group is a user's at most
    ``most`` scores; the pending vectors are scored apart from it, by its weights. Users with fewer than ``least``
    scores give no rows; vectors of another length get the bias.
    """
    kind = scored.schema[user].dataType.simpleString()
    newest = Window.partitionBy(user).orderBy(F.desc("created_at"), F.desc("id"))
    newest = scored.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= most)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series(dtype=object if c in ("weights", "mean") else rows[user].dtype if c == user else float) for c in (user, "weights", "mean", "bias", "n")})
        if len(rows) < least:
            return empty
        x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        model = ridge_fit(x, rows["score"].to_numpy(np.float64), penalty)
        if model is None:
            return empty
        return pd.DataFrame({user: [rows[user].iloc[0]], "weights": [model[0]], "mean": [model[1]], "bias": [model[2]], "n": [len(rows)]})

    models = newest.select(user, "vector", F.col("score").cast("double").alias("score")).groupBy(user).applyInPandas(fit, f"{user} {kind}, weights array<double>, mean array<double>, bias double, n long")
    centred = F.zip_with("vector", "mean", lambda v, m: v.cast("double") - m)
    value = F.when(F.size("vector") == F.size("weights"), F.col("bias") + F.aggregate(F.zip_with(centred, "weights", lambda v, w: v * w), F.lit(0.0), lambda t, v: t + v)).otherwise(F.col("bias"))
    return pending.join(models, user).select(user, "id", value.alias("learned"), "n")


def with_learned(blended: DataFrame, learned: DataFrame, user: str = "user_id") -> DataFrame:
    """``blended`` (user, id, blend) with the final order: z(blend) + weight(n) * z(learned); without an estimate the latter is 0."""
    rows = z_scores(blended.join(learned, [user, "id"], "left"), [user], ["blend", "learned"])
    return rows.withColumn("final", F.col("z_blend") + F.coalesce(learned_weight(F.col("n")), F.lit(0.0)) * F.col("z_learned")).drop("z_blend", "z_learned", "n")


def entity_match(companies: DataFrame, employers: DataFrame) -> DataFrame:
    """Rows (company_id, employer_key): employers with a company's name up to legal forms, or, for names of five letters or more, with it as their loose name.

    ``companies``: (company_id, key), a row for each name and alias; ``employers``: (employer_key, loose).
    """
    exact = companies.join(employers, F.col("key") == F.col("employer_key"))
    loose = companies.where(F.length("key") >= 5).join(employers.where("loose <> ''"), F.col("key") == F.col("loose"))
    return exact.select("company_id", "employer_key").unionByName(loose.select("company_id", "employer_key")).distinct()
