"""Review of nested resumes: findings with the place they point at, a score, and the resume as plain text.

Everything is one walk over a row's sections, entries and bullets with higher-order functions; nothing is exploded or
shuffled. What compares bullets with each other (numbers, periods, verbs) works on the flat array of what a resume's
bullets say. ``transform`` copies what it makes, whole sections with all their texts if they are part of it; filters and
``exists`` copy nothing, so only findings and short values come out of a transform.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.phrases import count_items

BULLET = "struct<id: string, text: string, hidden: boolean>"
ENTRY = f"struct<id: string, heading: string, subheading: string, dates: string, location: string, tech: string, text: string, bullets: array<{BULLET}>, hidden: boolean>"
SECTION = f"struct<id: string, kind: string, title: string, hidden: boolean, entries: array<{ENTRY}>, skills: array<struct<id: string, name: string, items: string>>, text: string>"
#: The shape of a resume; a kind is entries, projects, compact, skills or summary.
RESUME = f"struct<name: string, headline: string, phone: string, email: string, location: string, links: array<struct<label: string, url: string>>, sections: array<{SECTION}>>"
CHECKS = "array<struct<place: array<int>, id: string, severity: string, message: string, target: string>>"

#: Openings that say little, words that reviewers skip, names of sections, and ways to write dates.
WEAK_OPENERS = ["responsible for", "worked on", "helped", "assisted", "participated in", "involved in", "tasked with", "duties included", "in charge of", "worked with", "was part of", "contributed to"]
CLICHES = ["synergy", "go-getter", "hard worker", "hardworking", "team player", "detail-oriented", "detail oriented", "results-driven", "results driven", "self-starter", "self starter", "passionate", "think outside the box", "dynamic"]
STANDARD_TITLES = [
    "experience", "work experience", "professional experience", "employment", "education", "skills", "technical skills", "projects", "summary", "professional summary", "certifications", "awards", "honors", "publications",
    "leadership", "volunteer", "activities", "research", "additional experience", "relevant experience", "languages", "interests", "coursework", "patents", "talks", "selected honors", "invited talks", "achievements", "profile",
    "licenses", "licensure", "licenses and certifications", "clinical experience", "clinical rotations", "teaching experience",
]
DATE_STYLES = {
    "Mon YYYY": r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\.? \d{4}\b",
    "Month YYYY": r"\b(January|February|March|April|June|July|August|September|October|November|December) \d{4}\b",
    "MM/YYYY": r"\b\d{1,2}/\d{4}\b",
    "YYYY-MM": r"\b\d{4}-\d{2}\b",
}
PRONOUN = r"(?:^|[\s(])(I|me|my|My|we|We|our|Our|us)(?:[\s,;:)]|$)"
#: Bytes of a bullet at most and at least, of a summary, items of a skill line, bullets of an entry, and what findings cost.
LONGEST, SHORTEST, SUMMARY, ITEMS, BULLETS = 230, 35, 450, 16, 6
COSTS = {"fix": 12, "improve": 5, "tip": 2}


def _said(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _seen(item: Column) -> Column:
    return ~F.coalesce(item["hidden"], F.lit(False))


def _shown(items: Column) -> Column:
    """The items of an array that are not hidden."""
    return F.filter(items, _seen)


def _each(items: Column, kind: str, build) -> Column:
    """The arrays of type ``kind`` that ``build`` makes of each item that is not hidden and of its place, as one; empty for null."""
    none = F.array().cast(kind)
    return F.flatten(F.coalesce(F.transform(items, lambda x, i: F.when(_seen(x), build(x, i)).otherwise(none)), F.array().cast(f"array<{kind}>")))


def _any(items: Column, holds) -> Column:
    """Whether one of the items that are not hidden holds; not for null."""
    return F.coalesce(F.exists(items, lambda x: _seen(x) & holds(x)), F.lit(False))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _named(c: Column) -> Column:
    return F.when(_said(c) == "", "this entry").otherwise(c)


def _found(when: Column, place: list, check: str, severity: str, target: Column, *message: Column | str) -> Column:
    """A finding where the condition holds, else null."""
    text = F.concat(*[F.lit(m) if isinstance(m, str) else m.cast("string") for m in message])
    path = F.array(*[p if isinstance(p, Column) else F.lit(p) for p in place]).cast("array<int>")
    return F.when(when, F.struct(path.alias("place"), F.lit(check).alias("id"), F.lit(severity).alias("severity"), text.alias("message"), _said(target).alias("target")))


def _kept(*findings: Column) -> Column:
    return F.filter(F.array(*findings), lambda f: f.isNotNull())


def _first_of(words: list[str], holds) -> Column:
    """The first of ``words`` that holds; null if none does."""
    return F.coalesce(*[F.when(holds(w), F.lit(w)) for w in words])


def _once(value: Column, build) -> Column:
    """``build`` of a column, which is computed once however often ``build`` reads it."""
    return F.transform(F.array(value), build)[0]


def first_word(text: Column) -> Column:
    """The word that a bullet opens with, in lower case and without signs around it."""
    plain = F.ltrim(F.replace(text, F.lit("**"), F.lit("")), F.lit(" -•"))
    return F.lower(F.btrim(F.substring_index(plain, " ", 1), F.lit(".,;:")))


def _bullet_checks(section: Column, title: Column, bullet: Column, place: list) -> Column:
    def checks(both):
        text, low, size = both["text"], both["low"], F.octet_length(both["text"])
        weak = F.when(low.rlike("^(?:" + "|".join(WEAK_OPENERS) + ")"), _first_of(WEAK_OPENERS, lambda w: F.startswith(low, F.lit(w))))
        cliche = _first_of(CLICHES, lambda w: F.contains(low, F.lit(w)))  # a pattern of all tries each of them at each place
        pronoun = F.regexp_extract(text, PRONOUN, 1)
        short = (size <= LONGEST) & (size < SHORTEST) & (section["kind"] == "entries") & ~F.contains(title, F.lit("education"))
        return _kept(
            _found(weak.isNotNull(), [*place, 0], "weak-opener", "improve", bullet["id"], "Starts with ", _quoted(F.left(text, F.length(weak))), ". Lead with a strong verb and what changed (Built, Cut, Led, Shipped)."),
            _found(pronoun != "", [*place, 1], "pronoun", "improve", bullet["id"], "Drop ", _quoted(pronoun), ": resume bullets are written without I, my or we."),
            _found(size > LONGEST, [*place, 2], "long-bullet", "improve", bullet["id"], "This bullet runs past two lines. Cut it to the action and the result."),
            _found(F.coalesce(short, F.lit(False)), [*place, 2], "short-bullet", "tip", bullet["id"], "Short bullet: say what it achieved or how much."),
            _found(cliche.isNotNull(), [*place, 3], "cliche", "tip", bullet["id"], _quoted(cliche), " is a cliché that reviewers skip; show it with a result instead."),
        )

    plain = F.replace(_said(bullet["text"]), F.lit("**"), F.lit(""))
    return F.flatten(F.transform(F.array(F.struct(plain.alias("text"), F.lower(plain).alias("low"))), checks))  # the item of an array would ask for its type at each call


def _entry_checks(section: Column, title: Column, entry: Column, place: list) -> Column:
    shown = _shown(entry["bullets"])
    undated = _found(F.coalesce((section["kind"] == "entries") & (_said(entry["dates"]) == ""), F.lit(False)), [*place, -1, 0], "no-dates", "improve", entry["id"], "Add dates to ", _named(entry["heading"]), ".")
    bullets = _each(entry["bullets"], CHECKS, lambda b, i: _bullet_checks(section, title, b, [*place, i]))
    many = _found(F.size(shown) > BULLETS, [*place, 2**30, 0], "many-bullets", "tip", entry["id"], _named(entry["heading"]), " has ", F.size(shown), " bullets; three to five strong ones read better.")
    return F.concat(_kept(undated), bullets, _kept(many))


def _section_checks(section: Column, place: list) -> Column:
    title = F.lower(F.trim(_said(section["title"])))
    odd = ~title.isin(*STANDARD_TITLES) & (title != "")
    long = F.coalesce(section["kind"] == "summary", F.lit(False)) & (F.octet_length(_said(section["text"])) > SUMMARY)
    own = _kept(
        _found(odd, [*place, -2, 0, 0], "odd-title", "tip", section["id"], _quoted(_said(section["title"])), " is not a standard section name; applicant tracking systems may not file it correctly."),
        _found(long, [*place, -2, 0, 1], "long-summary", "improve", section["id"], "Keep the summary to two or three lines; recruiters skim it in seconds."),
    )
    lines = F.transform(section["skills"], lambda g, i: _once(count_items(_said(g["items"])), lambda n: _found(n > ITEMS, [*place, -1, i, 0], "long-skills", "tip", section["id"], _quoted(_said(g["name"])), " lists ", n, " items. Keep the ones this kind of job asks for.")))
    entries = _each(section["entries"], CHECKS, lambda e, i: _entry_checks(section, title, e, [*place, i]))
    return F.concat(own, F.filter(F.coalesce(lines, F.array().cast(CHECKS)), lambda f: f.isNotNull()), entries)


def shown_bullets(resume: Column) -> Column:
    """(id, w, figure, stop) of the bullets that are seen, in order: first word, whether a figure is in it and a period at its end."""

    def said(b):
        text = F.replace(_said(b["text"]), F.lit("**"), F.lit(""))
        return _once(text, lambda x: F.struct(_said(b["id"]).alias("id"), first_word(x).alias("w"), x.rlike("[0-9]").alias("figure"), x.endswith(".").alias("stop")))

    kind = "array<struct<id: string, w: string, figure: boolean, stop: boolean>>"
    bullets = lambda e: F.coalesce(F.transform(_shown(e["bullets"]), said), F.array().cast(kind))
    return _each(resume["sections"], kind, lambda s, _: _each(s["entries"], kind, lambda e, _: bullets(e)))


def _whole_checks(resume: Column, bullets: Column, pages: Column) -> tuple[Column, Column]:
    """Findings about the header and about the whole resume."""
    none = F.lit("")
    profile = F.exists(F.coalesce(resume["links"], F.array().cast("array<struct<label: string, url: string>>")), lambda x: F.lower(_said(x["url"])).rlike(r"linkedin\.com|github\.com"))
    header = _kept(
        _found(_said(resume["email"]) == "", [0, 0], "no-email", "fix", none, "Add your email address to the header."),
        _found(_said(resume["phone"]) == "", [0, 1], "no-phone", "improve", none, "Add a phone number: many recruiters still call first."),
        _found(~profile, [0, 2], "no-profile-link", "tip", none, "Add a LinkedIn or GitHub link; reviewers often check them."),
        _found(F.coalesce(pages > 1, F.lit(False)), [0, 3], "too-long", "fix", none, "The resume runs to ", F.coalesce(pages, F.lit(0)), " pages. Use Fit to one page, or hide older bullets."),
    )
    number = lambda field: F.size(F.filter(bullets, lambda b: b[field]))
    total, figures, stops = F.size(bullets), number("figure"), number("stop")
    experienced = _any(resume["sections"], lambda s: F.lower(_said(s["title"])).rlike("experience|employment"))
    written = lambda style: _any(resume["sections"], lambda s: _any(s["entries"], lambda e: _said(e["dates"]).rlike(style))).cast("int")
    styles = reduce(lambda a, b: a + b, map(written, DATE_STYLES.values()))
    words = F.filter(bullets, lambda x: F.length(x["w"]) > 0)

    def repeated(words):
        ordered = F.array_sort(F.transform(words, lambda x: x["w"]))
        verbs = _once(ordered, lambda o: F.array_distinct(F.filter(o, lambda w, i: w.eqNullSafe(F.get(o, i + 2)))))  # those that stand three times
        of = lambda v: F.filter(words, lambda x: x["w"] == v)
        return F.transform(verbs, lambda v, i: _once(of(v), lambda same: _found((F.size(same) >= 3) & (F.octet_length(v) > 2), [2, 4, i], "repeated-verb", "tip", F.get(same, F.lit(2))["id"], F.size(same), " bullets start with ", _quoted(v), "; vary the verbs.")))

    end = _kept(
        _found(~experienced, [2, 0], "no-experience", "improve", none, "Add an Experience section (internships and research count)."),
        _found((total >= 4) & (F.floor(figures * 100 / total) < 40), [2, 1], "few-metrics", "improve", none, "Only ", figures, " of ", total, " bullets have a number. Add scale or results: users, latency, %, $, time saved."),
        _found(F.least(stops, total - stops) >= 2, [2, 2], "periods", "tip", none, "Some bullets end with a period and some don't; pick one style."),
        _found(styles > 1, [2, 3], "date-styles", "tip", none, "Dates use more than one format; use one (e.g. Aug 2024 – May 2026)."),
    )
    return header, F.concat(end, F.filter(_once(words, repeated), lambda f: f.isNotNull()))


def review(resume: Column, pages: Column) -> Column:
    """Struct (score, checks) of a resume of type ``RESUME`` that takes ``pages`` pages (null or 0: not known).

    Checks are (place, id, severity, message, target) in the order of the resume; a place is [0, n] for the header, [1,
    section, entry, bullet, n] inside it and [2, n] for the whole. The target is the id of the bullet, entry or section to
    mend. Hidden parts are not looked at; null texts are empty. The score is 100 less what the findings cost, 0 at least.
    """
    sections = _each(resume["sections"], CHECKS, lambda s, i: _section_checks(s, [1, i]))

    def judged(bullets):
        header, end = _whole_checks(resume, bullets, pages)
        return F.concat(header, sections, end)

    cost = lambda c: F.when(c["severity"] == "fix", COSTS["fix"]).when(c["severity"] == "improve", COSTS["improve"]).otherwise(COSTS["tip"])
    return _once(_once(shown_bullets(resume), judged), lambda checks: F.struct(F.greatest(F.lit(0), 100 - F.aggregate(checks, F.lit(0), lambda t, c: t + cost(c))).alias("score"), checks.alias("checks")))


def plain_text(resume: Column) -> Column:
    """The resume as it is seen, a line for each thing it says: parts of a line joined by bars, bullets with a dash."""

    def line(*parts: Column) -> Column:
        filled = F.filter(F.array(*[_said(p) for p in parts]), lambda p: p != "")
        return F.when(F.size(filled) > 0, F.concat(F.array_join(filled, " | "), F.lit("\n"))).otherwise("")

    def joined(items: Column, write) -> Column:
        return F.coalesce(F.array_join(F.transform(items, write), ""), F.lit(""))

    def entry(e: Column) -> Column:
        bullets = joined(_shown(e["bullets"]), lambda b: F.concat(F.lit("- "), _said(b["text"]), F.lit("\n")))
        return F.concat(line(e["heading"], e["subheading"], e["tech"], e["dates"], e["location"]), line(e["text"]), bullets)

    def section(s: Column) -> Column:
        skills = joined(s["skills"], lambda g: line(F.concat(_said(g["name"]), F.lit(": "), _said(g["items"]))))
        return F.concat(F.lit("\n"), F.upper(_said(s["title"])), F.lit("\n"), line(s["text"]), skills, joined(_shown(s["entries"]), entry))

    labels = F.coalesce(F.transform(resume["links"], lambda x: _said(x["label"])), F.array().cast("array<string>"))
    contacts = F.filter(F.concat(F.array(_said(resume["phone"]), _said(resume["email"]), _said(resume["location"])), labels), lambda p: p != "")
    head = F.concat(line(resume["name"]), line(resume["headline"]), F.when(F.size(contacts) > 0, F.concat(F.array_join(contacts, " | "), F.lit("\n"))).otherwise(""))
    return F.btrim(F.concat(head, joined(_shown(resume["sections"]), section)), F.lit(" \t\n\x0b\f\r"))
