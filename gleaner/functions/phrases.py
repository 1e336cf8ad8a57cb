"""Skills, keywords, places, degrees and letters as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gleaner.functions.replies import without_fences
from gleaner.functions.text import once, phrase_set, trimmed

#: Skills that go by another name.
SYNONYMS = {
    "k8s": "kubernetes", "golang": "go", "postgres": "postgresql", "psql": "postgresql", "js": "javascript", "ts": "typescript", "nodejs": "node.js", "node": "node.js",
    "reactjs": "react", "react.js": "react", "vuejs": "vue", "vue.js": "vue", "nextjs": "next.js", "gcp": "google cloud", "google cloud platform": "google cloud",
    "amazon web services": "aws", "azure cloud": "azure", "cicd": "ci/cd", "ci cd": "ci/cd", "continuous integration": "ci/cd", "ml": "machine learning",
    "llms": "llm", "large language models": "llm", "rest api": "rest", "restful": "rest", "rest apis": "rest", "py": "python", "c++": "cplusplus", "cpp": "cplusplus",
    "c#": "csharp", "dotnet": ".net", "sre": "site reliability", "site reliability engineering": "site reliability", "infra": "infrastructure", "o11y": "observability",
    "unix": "linux",
}
#: Endings of company names that a board's address may lack.
ENDINGS = "ai labs lab inc co corp llc technologies systems trading capital hq group".split()
#: Degrees, highest first.
DEGREES = {
    "doctorate": r"(?i)\b(ph\.?\s?d|doctor|doctorate|d\.?phil|ed\.?d|m\.?d\.?|j\.?d\.?)\b",
    "master": r"(?i)\b(master|m\.?\s?s\.?c?|m\.?\s?a\.?|mba|m\.?eng|meng|m\.?s\.?n|mph|mfa)\b",
    "bachelor": r"(?i)\b(bachelor|b\.?\s?s\.?c?|b\.?\s?a\.?|bba|b\.?eng|beng|b\.?s\.?n|b\.?tech|undergraduate)\b",
    "associate": r"(?i)\b(associate|a\.?\s?s\.?|a\.?\s?a\.?|a\.?d\.?n)\b",
    "high_school": r"(?i)high school|secondary|ged\b|diploma",
}
#: The states and how the country is written.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL",
    "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME",
    "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV",
    "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
    "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT",
    "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
COUNTRY = ("usa", "us", "u.s", "u.s.a", "united states", "united states of america")


def _empty():
    return F.array().cast("array<string>")


def canonical_skill(name):
    """A skill in lower case, in letters, digits and ``+#./``, under its usual name."""
    return once(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9+#./]+", " ")), _usual)


def _usual(plain):
    """The usual name of a skill that is written plainly."""
    return F.when(plain.isin(*SYNONYMS), F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])[plain]).otherwise(plain)


def _deeper(part):
    """Brackets opened in a text less those closed in it."""
    return F.length(F.replace(part, F.lit(")"), F.lit(""))) - F.length(F.replace(part, F.lit("("), F.lit("")))


def _bracketed(text):
    return F.contains(text, F.lit("(")) | F.contains(text, F.lit(")"))


def count_items(text):
    """How many parts ``split_items`` gives: a fold that holds two numbers, as one that holds the parts copies them at each step."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"))

    def step(so_far, part):
        return once(so_far["depth"] + _deeper(part), lambda depth: F.struct(depth.alias("depth"), (so_far["n"] + (depth == 0).cast("int")).alias("n")))

    parts = F.split(text, ",", -1)
    return F.when(_bracketed(text), F.aggregate(parts, start, step, lambda x: x["n"] + (x["depth"] != 0).cast("int"))).otherwise(F.size(parts))


def split_items(text):
    """The parts of a text between commas outside round brackets, trimmed.

    A comma counts if the brackets opened and closed before it are as many; the fold runs over the parts between commas
    where there are brackets.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("open"), _empty().alias("out"))

    def step(so_far, part):
        depth = so_far["depth"] + _deeper(part)
        joined = F.when(so_far["open"].isNull(), part).otherwise(F.concat(so_far["open"], F.lit(","), part))
        out = F.when(depth == 0, F.array_append(so_far["out"], trimmed(joined))).otherwise(so_far["out"])
        return F.struct(depth.alias("depth"), F.when(depth != 0, joined).alias("open"), out.alias("out"))

    parts = F.split(text, ",", -1)
    folded = F.aggregate(parts, start, step, lambda x: F.when(x["open"].isNull(), x["out"]).otherwise(F.array_append(x["out"], trimmed(x["open"]))))
    return F.when(_bracketed(text), folded).otherwise(F.transform(parts, trimmed))


def keyword_forms(keyword):
    """The forms of a keyword each of which meets it: itself, what stands before its brackets, what stands in them, parts between slashes."""
    pattern = r"(?s)^(.*?)\s*\(([^)]*)\)\s*\z"
    inside, head, inner = keyword.rlike(pattern), F.regexp_extract(keyword, pattern, 1), F.regexp_extract(keyword, pattern, 2)
    parts = lambda text, sep: F.array_remove(F.transform(F.split(text, sep, -1), trimmed), "")
    whole = F.when(inside, head).otherwise(keyword)
    slashed = F.contains(whole, F.lit("/")) & ~F.contains(F.lower(whole), F.lit("ci/cd"))
    named = F.when(inside, F.array(keyword, head)).otherwise(F.array(keyword))
    bracketed = F.concat(F.array(keyword, head), parts(inner, "[/,]| or "))
    return F.when(inside & (inner != ""), bracketed).when(slashed, F.concat(named, parts(whole, "/"))).otherwise(named)


def keyword_list(*lists, longest: int = 60, most: int = 30):
    """The trimmed entries of several arrays in order, each once whatever its case, none over ``longest`` bytes, the first ``most``."""
    whole = F.concat(*[F.coalesce(x, _empty()) for x in lists])
    fit = F.filter(F.transform(whole, trimmed), lambda k: (k != "") & (F.octet_length(k) <= longest))
    low = F.transform(fit, F.lower)
    return F.slice(F.filter(fit, lambda k, i: F.array_position(low, F.lower(k)) == i + 1), 1, most)


def board_slugs(name):
    """Addresses that a company's board may have: its words joined and hyphenated, also without the usual endings."""
    words = F.array_remove(F.split(F.lower(name), r"[^\p{L}\p{Nd}]+", -1), "")
    endings = F.transform(F.reverse(words), lambda w: w.isin(ENDINGS))
    first_kept = F.array_position(endings, False)  # from the end, from 1; 0: all are endings
    cut = F.when(first_kept == 0, F.size(words) - 1).otherwise(first_kept - 1).cast("int")
    forms = F.transform(F.sequence(F.lit(0), F.greatest(cut, F.lit(0))), lambda k: F.slice(words, 1, F.size(words) - k))
    joined = F.flatten(F.transform(forms, lambda f: F.array(F.array_join(f, ""), F.array_join(f, "-"))))
    return F.when(F.size(words) > 0, F.array_distinct(joined)).otherwise(_empty())


def split_location(location):
    """Struct (city, state, country) of a place as written; empty strings for what it does not say."""
    parts = F.filter(F.transform(F.split(location, ",", -1), trimmed), lambda p: (p != "") & (F.lower(p) != "remote"))
    part = lambda i: F.try_element_at(parts, F.lit(i))
    ours = lambda p: F.lower(F.regexp_replace(p, r"^[. ]+|[. ]+\z", "")).isin(*COUNTRY)
    place = lambda city, state, country: F.struct(city.alias("city"), state.alias("state"), country.alias("country"))
    code = F.upper(F.regexp_extract(part(2), r"^\S+", 0))
    named = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])[F.lower(part(2))]
    blank, home = F.lit(""), F.lit("United States")
    n = F.size(parts)
    return (
        F.when(n == 0, place(blank, blank, blank))
        .when(n == 1, place(part(1), blank, blank))
        .when(n > 2, place(part(1), part(2), F.when(ours(part(-1)), home).otherwise(part(-1))))
        .when(code.isin(*STATES.values(), "DC"), place(part(1), code, home))
        .when(ours(part(2)), place(part(1), blank, home))
        .when((F.length(part(2)) > 3) & named.isNotNull(), place(part(1), named, home))
        .otherwise(place(part(1), blank, part(2)))
    )


def degree_level(degree):
    """The level of a degree as written; empty where unclear."""
    return F.coalesce(reduce(lambda c, d: c.when(degree.rlike(d[1]), d[0]), list(DEGREES.items())[1:], F.when(degree.rlike(DEGREES["doctorate"]), "doctorate")), F.lit(""))


def slice_between(text, start, end, least: int = 12, most: int = 24_000):
    """``text`` from the first ``start`` to the last ``end``, white space as single blanks; all of it where a marker is short or missing."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"[\x09-\x0D\x20\x{85}\x{A0}]+", " "))
    t, s, e = plain(text), plain(start), plain(end)
    first = F.instr(t, s)
    back = F.instr(F.reverse(t), F.reverse(e))
    stop = F.length(t) - back + 1  # the last character of the last end
    good = (F.octet_length(s) >= least) & (F.octet_length(e) >= least) & (first > 0) & (back > 0) & (stop >= first)
    return F.when(good, F.substring(t, first, stop - first + 1)).otherwise(F.left(trimmed(text), F.lit(most)))


def clean_letter(text, most: int = 6000):
    """A letter without fences and emphasis, with commas or, between digits, hyphens for dashes, and at most one blank line in a row."""
    s = without_fences(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    s = F.regexp_replace(s, r"\*\*([^*]+)\*\*|__([^_]+)__", "$1$2")
    s = F.regexp_replace(s, r"\s*[\x{2014}\x{2013}]\s*", ", ")
    s = F.regexp_replace(s, r"(\d), (\d)", "$1-$2")
    s = F.replace(F.replace(s, F.lit(" ,"), F.lit(",")), F.lit(",,"), F.lit(","))
    return F.left(F.regexp_replace(trimmed(s), r"\n{3,}", "\n\n"), F.lit(most))


def new_numbers(before, after):
    """Numbers that ``after`` has and ``before`` has not: a rewrite with any is refused."""
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)))
    return F.array_except(numbers(after), numbers(before))


def same_skills(before, after):
    """Whether two arrays hold the same entries in any order."""
    return F.sort_array(before) == F.sort_array(after)


def bullet_priority(section, entry, bullet, is_project, hits, dropped_at=None, dropped: int = 0):
    """How long a bullet stays when a page must get shorter: its place, the keywords that it hits, and what is least relevant goes first."""
    rank = F.when(is_project, 600).otherwise(1000) - 40 * entry - 5 * bullet - section + 400 * hits
    if dropped_at is None or not dropped:
        return rank.cast("double")
    return rank - F.when(dropped_at.isNotNull(), 100_000.0 * (dropped - dropped_at) / dropped).otherwise(0.0)


def named_phrases(text):
    """The runs of one to three words of a text and, for each of them and of its parts between slashes, the usual name.

    Runs hold single blanks and nothing that a skill's name would lose, so their names need no pattern.
    """
    runs = F.array_remove(F.transform(phrase_set(F.coalesce(text, F.lit(""))), lambda p: F.trim(p, F.lit(".,/"))), "")

    def named(runs):
        slashed = F.filter(runs, lambda p: F.contains(p, F.lit("/")))
        parts = F.array_remove(F.flatten(F.transform(slashed, lambda p: F.split(p, "/", -1))), "")
        return F.array_distinct(F.concat(runs, F.transform(F.concat(runs, parts), lambda p: once(F.trim(p), _usual))))

    return once(runs, named)


def keyword_coverage(text, keywords):
    """Struct (matched, missing, percent) of keywords in a text: one is met by any of its forms under its usual name, and counts once."""

    def of(word):
        forms = F.transform(keyword_forms(word), lambda f: F.array(canonical_skill(f), F.lower(trimmed(f))))
        return F.struct(word.alias("word"), canonical_skill(word).alias("name"), F.array_distinct(F.flatten(forms)).alias("forms"))

    named = F.filter(F.transform(keywords, of), lambda k: k["name"] != "")
    first = lambda all_of: F.filter(all_of, lambda k, i: ~F.exists(F.slice(all_of, 1, i), lambda x: x["name"] == k["name"]))

    def found(both):
        judged = F.transform(both["wanted"], lambda k: F.struct(k["word"].alias("word"), F.coalesce(F.arrays_overlap(k["forms"], both["have"]), F.lit(False)).alias("met")))
        return once(judged, shares)

    def shares(judged):
        words = lambda keep: F.transform(F.filter(judged, keep), lambda k: k["word"])
        matched, missing = words(lambda k: k["met"]), words(lambda k: ~k["met"])
        percent = F.when(F.size(judged) > 0, F.floor(100 * F.size(matched) / F.size(judged))).otherwise(0).cast("int")
        return F.struct(matched.alias("matched"), missing.alias("missing"), percent.alias("percent"))

    return once(F.struct(named_phrases(text).alias("have"), once(named, first).alias("wanted")), found)
