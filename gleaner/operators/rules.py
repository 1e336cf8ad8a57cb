"""The configurable rule ladder: each posting against each user's preferences, with auditable reasons.

Rules read only title and location first; descriptions are looked at for what is left. The first rule that applies
gives the reason, so the ladder is a chain of conditions and nothing is evaluated twice. Users are few and their
preferences are part of the expression; postings are never crossed with them outside one projection.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import evidence_sentence, tag, trimmed


@dataclass
class Catalog:
    """Patterns by what they find; every pattern is matched without regard to case.

    ``levels`` maps a level to (patterns, spans to cut out before they are tried); ``overrides`` maps a name to (the
    families it belongs to, patterns) and skips the level and family rules.
    """

    families: dict[str, list[str]]
    levels: dict[str, tuple[list[str], list[str]]]
    overrides: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)
    home: list[str] = field(default_factory=list)
    abroad: list[str] = field(default_factory=list)
    refusals: list[str] = field(default_factory=list)
    refusal_words: list[str] = field(default_factory=lambda: ["sponsor", "visa", "citizen", "clearance"])
    flags: list[str] = field(default_factory=list)

    @classmethod
    def from_mapping(cls, given: dict) -> Catalog:
        """The catalog in a mapping, as a YAML or JSON file holds it: names of fields to lists; levels and overrides as pairs.

        Raises ValueError for an unknown field, for overrides of families that there are not, and for a pattern that is none.
        """
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown or not {"families", "levels"} <= set(given):
            raise ValueError(f"unknown fields {sorted(unknown)}, or no families and levels")
        made = cls(**given | {k: {name: tuple(pair) for name, pair in given.get(k, {}).items()} for k in ("levels", "overrides")})
        missing = {f for names, _ in made.overrides.values() for f in names} - set(made.families)
        if missing:
            raise ValueError(f"overrides of unknown families {sorted(missing)}")
        patterns = [p for group in made.families.values() for p in group] + [p for pair in made.levels.values() for group in pair for p in group]
        patterns += [p for _, group in made.overrides.values() for p in group] + made.home + made.refusals + made.flags
        for p in patterns:
            try:
                re.compile(p)
            except re.error as wrong:
                raise ValueError(f"no pattern: {p!r}: {wrong}") from wrong
        return made


@dataclass
class Preferences:
    families: list[str]
    levels: list[str]
    us_only: bool = False
    needs_sponsorship: bool = False
    max_years: int = 0


def any_of(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def matches(text: Column, patterns: list[str]) -> Column:
    return text.rlike(any_of(patterns)) if patterns else F.lit(False)


def first_match(text: Column, patterns: list[str]) -> Column:
    """What the first pattern that matches finds; null if none does."""
    found = [F.nullif(F.regexp_extract(text, f"(?i){p}", 0), F.lit("")) for p in patterns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def abroad(location: Column, catalog: Catalog) -> Column:
    """Whether a location is surely not at home: an empty one is not, and a mark of home outweighs any other."""
    text = F.trim(F.coalesce(location, F.lit("")))
    return F.when((text == "") | matches(text, catalog.home), False).otherwise(matches(text, catalog.abroad))


def categories(title: Column, prefs: Preferences, catalog: Catalog) -> Column:
    """The matched override, else the matched families of the user, in catalog order."""
    override = overridden(title, prefs, catalog)
    families = [F.when(matches(title, p), f) for f, p in catalog.families.items() if f in prefs.families]
    return F.when(override.isNotNull(), F.array(override)).otherwise(F.array_compact(F.array(*families)) if families else F.array().cast("array<string>"))


def overridden(title: Column, prefs: Preferences, catalog: Catalog) -> Column:
    mine = [(name, p) for name, (families, p) in sorted(catalog.overrides.items()) if set(families) & set(prefs.families)]
    return F.coalesce(*[F.when(matches(title, p), name) for name, p in mine]) if mine else F.lit(None).cast("string")


def title_reason(title: Column, location: Column, prefs: Preferences, catalog: Catalog) -> Column:
    """Why title or location rule a posting out; null if they do not."""
    steps = []
    for level, (patterns, spans) in catalog.levels.items():
        if level not in prefs.levels and patterns:
            shown = reduce(lambda t, p: F.regexp_replace(t, f"(?i){p}", " "), spans, title)
            steps.append(F.concat(F.lit("title:"), tag(first_match(shown, patterns))))
    ladder = F.coalesce(*steps, F.when(F.size(categories(title, prefs, catalog)) == 0, "title:no_category"))
    ladder = F.when(overridden(title, prefs, catalog).isNull(), ladder)
    return F.coalesce(ladder, F.when(abroad(location, catalog), "location:non_us")) if prefs.us_only else ladder


def refusal(description: Column, prefs: Preferences, catalog: Catalog) -> Column:
    """The sentence that refuses sponsorship, for users who need it; a cheap word test stands before the patterns."""
    if not (prefs.needs_sponsorship and catalog.refusals):
        return F.lit(None).cast("string")
    lower = F.lower(F.coalesce(description, F.lit("")))
    hint = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in catalog.refusal_words])
    return F.when(hint, evidence_sentence(description, any_of(catalog.refusals)))


def flags(description: Column, catalog: Catalog) -> Column:
    """Tags of what each flag pattern finds, in catalog order."""
    text = F.coalesce(description, F.lit(""))
    return F.array_compact(F.array(*[tag(first_match(text, [p])) for p in catalog.flags])) if catalog.flags else F.array().cast("array<string>")


def apply_rules(postings: DataFrame, prefs: Preferences, catalog: Catalog, title: str = "title", location: str = "location", description: str = "description") -> DataFrame:
    """``postings`` with reason (null: kept), evidence, categories and flags."""
    first = postings.withColumn("reason", title_reason(F.col(title), F.col(location), prefs, catalog))
    said = F.when(F.col("reason").isNull(), refusal(F.col(description), prefs, catalog))
    second = first.withColumn("_said", said)
    reason = F.coalesce("reason", F.when(F.col("_said").isNotNull(), "sponsorship:explicit_no"))
    evidence = F.when(F.col("_said").isNotNull(), F.col("_said")).when(F.col("reason").startswith("location"), F.col(location)).when(F.col("reason").isNotNull(), F.col(title))
    third = second.withColumns({"evidence": evidence, "reason": reason}).drop("_said")
    kept = F.col("reason").isNull()
    return third.withColumns({"categories": F.when(kept, categories(F.col(title), prefs, catalog)).otherwise(F.array().cast("array<string>")), "flags": F.when(kept, flags(F.col(description), catalog)).otherwise(F.array().cast("array<string>"))})


def facts_reason(facts: dict[str, Column], prefs: Preferences) -> Column:
    """Why extracted facts rule a posting out, in order: a quoted refusal, too many years, not eligible at home, senior."""
    steps = []
    if prefs.needs_sponsorship:
        steps.append(F.when((facts["sponsorship"] == "no") & (F.coalesce(facts["quote"], F.lit("")) != ""), "llm:sponsorship_no"))
    if prefs.max_years > 0:
        steps.append(F.when(facts["years"] > prefs.max_years, f"llm:years>{prefs.max_years}"))
    if prefs.us_only:
        steps.append(F.when(~facts["us_eligible"], "llm:non_us"))
    if "senior" not in prefs.levels:
        steps.append(F.when(facts["seniority"] == "senior", "llm:senior"))
    return F.coalesce(*steps) if steps else F.lit(None).cast("string")


#: Least and most characters of a body, most links.
LIMITS = {"post": (200, 20_000, 5), "comment": (2, 2000, 2)}


def moderation_reason(title: Column, body: Column, kind: str = "post") -> Column:
    """Why a post or comment is refused: title of 8 to 140 characters (posts), body in bounds, few links, no long run of one character."""
    least, most, links = LIMITS[kind]
    n, m = F.length(trimmed(F.coalesce(title, F.lit("")))), F.length(trimmed(body))
    return (
        F.when(F.lit(kind == "post") & ~n.between(8, 140), "title_length")
        .when(~m.between(least, most), "body_length")
        .when(F.regexp_count(F.lower(body), F.lit("https?://")) > links, "links")
        .when(F.concat(F.coalesce(title, F.lit("")), body).rlike(r"([^ \t\n\-=_.*#])\1{14,}"), "long_run")
    )
