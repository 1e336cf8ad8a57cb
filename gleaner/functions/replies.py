"""Replies of external models, read and checked as column expressions: nothing in a reply is trusted."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.numbers import coverage, ratings_valid, rubric_score, verdict
from gleaner.functions.text import SPACE, once, trimmed, trimmed_of

#: What a reply may say; anything else counts as unknown.
SENIORITY = ("entry", "junior", "mid", "senior", "unknown")
SPONSORSHIP = ("yes", "no", "unknown")
WORK_MODES = ("remote", "hybrid", "onsite", "unknown")
REFUSED = ("violence", "harassment", "hate", "sexual", "self_harm", "unethical", "illegal", "personal_data", "spam", "off_topic")
DATA_TAGS = ("posting", "profile", "resume", "answers", "content", "draft", "request")

FACTS = (
    "seniority string, years_required int, sponsorship string, sponsorship_quote string, us_eligible boolean, work_mode string, "
    "location_summary string, skills_required array<string>, digest string"
)
VERDICT = "allowed boolean, categories array<string>, reason string"
DEEP = "why_fit array<string>, gaps array<struct<gap: string, address: string>>, resume_bullets array<string>, interview_topics array<string>"


def without_fences(reply, space=SPACE):
    """A reply without white space (a character class) around it and without a Markdown code fence around all of it."""
    inside = lambda whole: trimmed_of(F.substring(whole, F.instr(whole, "\n") + 1, F.length(whole)), space)
    opened = lambda inner: F.when(inner.endswith("```"), trimmed_of(F.left(inner, F.length(inner) - 3), space)).otherwise(inner)
    return once(trimmed_of(reply, space), lambda whole: F.when(whole.startswith("```") & F.contains(whole, F.lit("\n")), once(inside(whole), opened)).otherwise(whole))


def fenced(text):
    """Untrusted text in which tags that wrap data in a prompt stand in round brackets, so that it can't close its wrapper."""
    return F.regexp_replace(text, rf"(?i)<(\s*/?\s*(?:{'|'.join(DATA_TAGS)})\b[^>]*?)<*>", r"($1)")


def squashed(text):
    """Lower case, white space as single blanks, none at the ends."""
    space = r"[\x09-\x0D\x20\x{85}\x{A0}]"  # single blanks stay as they are, so most places are no match
    return F.trim(F.regexp_replace(F.lower(text), rf"(?:[\x09-\x0D\x{{85}}\x{{A0}}]|\x20(?={space})){space}*", " "))


def _known(value, names):
    return F.when(value.isin(*names), value).otherwise("unknown")


def facts(reply, description):
    """Facts of a posting (struct FACTS) from a reply; null if it is no such object or has no digest.

    Years outside 0 to 40 are dropped. A quote must stand in the posting, case and white space aside; one that does not
    is dropped, and a refusal without a quote that was given counts as unknown. Lists and texts are cut to size.
    """
    read = F.struct(F.from_json(without_fences(reply), FACTS).alias("f"), squashed(F.coalesce(description, F.lit(""))).alias("said"))
    return once(read, lambda r: _facts(r["f"], r["said"]))


def _facts(f, said):
    quote = f["sponsorship_quote"]
    real = (quote != "") & F.contains(said, squashed(quote))
    invented = quote.isNotNull() & ~real
    stance = _known(f["sponsorship"], SPONSORSHIP)
    digest = F.left(trimmed(f["digest"]), F.lit(900))
    skills = F.filter(F.transform(f["skills_required"], lambda s: F.left(trimmed(s), F.lit(60))), lambda s: s != "")
    fields = {
        "seniority": _known(f["seniority"], SENIORITY),
        "years_required": F.when(f["years_required"].between(0, 40), f["years_required"]),
        "sponsorship": F.when(invented & (stance == "no"), "unknown").otherwise(stance),
        "sponsorship_quote": F.when(real, quote),
        "us_eligible": f["us_eligible"],
        "work_mode": _known(f["work_mode"], WORK_MODES),
        "location_summary": F.left(f["location_summary"], F.lit(120)),
        "skills_required": F.slice(F.coalesce(skills, F.array().cast("array<string>")), 1, 12),
        "digest": digest,
    }
    return F.when(digest != "", F.struct(*[c.alias(k) for k, c in fields.items()]))


def moderation_verdict(reply):
    """Struct (allowed, categories, reason) of a moderation reply; null if it can't be read. A known category always refuses."""
    return once(F.from_json(without_fences(reply), VERDICT), _verdict)


def _verdict(v):
    categories = F.filter(F.coalesce(v["categories"], F.array().cast("array<string>")), lambda c: c.isin(*REFUSED))
    allowed = F.coalesce(v["allowed"], F.lit(False)) & (F.size(categories) == 0)
    said = F.left(trimmed(F.coalesce(v["reason"], F.lit(""))), F.lit(300))
    reason = F.when(allowed, "").when(said == "", "This does not meet the community guidelines.").otherwise(said)
    known = v["allowed"].isNotNull() | v["categories"].isNotNull() | v["reason"].isNotNull()
    return F.when(known, F.struct(allowed.alias("allowed"), categories.alias("categories"), reason.alias("reason")))


def deep_review(reply):
    """The deep review in a reply (struct DEEP), null unless each list holds as many entries as it should, none of them blank."""
    return once(F.from_json(without_fences(reply), DEEP), _deep)


def _deep(d):
    blank = lambda s: F.coalesce(trimmed(s) == "", F.lit(True))
    listed = lambda c: F.coalesce(F.size(c).between(1, 5) & ~F.exists(c, blank), F.lit(False))
    gaps = F.coalesce((F.size(d["gaps"]) <= 5) & ~F.exists(d["gaps"], lambda g: blank(g["gap"]) | blank(g["address"])), d["gaps"].isNull())
    return F.when(listed(d["why_fit"]) & listed(d["resume_bullets"]) & listed(d["interview_topics"]) & gaps, d)


def merged(facts_struct, fit_struct):
    """One struct with the fields of both."""
    return F.when(facts_struct.isNotNull() & fit_struct.isNotNull(), F.struct(facts_struct.alias("facts"), fit_struct.alias("fit")))


#: What an analysis and its ratings hold; and a form's fields and the answers that a reply suggests for them.
RATINGS = ("role", "seniority", "skills", "domain", "location")
ANALYSIS = f"ratings struct<{', '.join(f'{r}: int' for r in RATINGS)}, blocker: boolean>, seniority string, sponsorship string, work_mode string, years_required int, skills_matched array<string>, skills_missing array<string>"
SUGGESTIONS = "answers array<struct<id: string, value: string, confidence: string, why: string>>"
CHOICES = ("select", "radio", "buttons", "listbox", "combobox", "checkboxes")


def analysis(reply):
    """The analysis in a reply with its fit and verdict; null unless every rating and name in it is one that is known."""
    return once(F.from_json(without_fences(reply), ANALYSIS), _analysis)


def _analysis(a):
    r = a["ratings"]
    named = [F.coalesce(a[k].isin(*values), F.lit(False)) for k, values in (("seniority", SENIORITY), ("sponsorship", SPONSORSHIP), ("work_mode", WORK_MODES))]
    valid = ratings_valid(*[r[k] for k in RATINGS]) & named[0] & named[1] & named[2] & (F.coalesce(a["years_required"], F.lit(0)) >= 0)
    listed = lambda k: F.coalesce(a[k], F.array().cast("array<string>"))
    fit = rubric_score(*[r[k] for k in RATINGS], F.coalesce(r["blocker"], F.lit(False)), coverage(listed("skills_matched"), listed("skills_missing")))
    kept = [a[k].alias(k) for k in ("seniority", "sponsorship", "work_mode", "years_required", "skills_matched", "skills_missing")]
    return F.when(valid, F.struct(fit.alias("fit"), verdict(fit).alias("verdict"), *kept))


def form_answers(reply, fields, today, clean, choice, past_start):
    """The suggestions in a reply that fit a form's fields: array of (id, value, confidence, why), the first for each field.

    ``fields``: array of (id, label, kind, options, max_length). A suggestion needs a known id and a value: for a choice,
    options that exist, only one unless several may be ticked; for a box, yes; no start that has gone by. Values are
    cut to the field's limit. ``clean``, ``choice`` and ``past_start`` are the functions of letters and forms.
    """
    none = F.array().cast("array<struct<id: string, value: string, confidence: string, why: string>>")
    said = F.coalesce(F.from_json(without_fences(reply), SUGGESTIONS)["answers"], none)
    usual = lambda field: F.when(field["kind"] == "textarea", 2000).otherwise(600)
    limit = lambda field: F.when(field["max_length"] > 0, F.least(field["max_length"], usual(field))).otherwise(usual(field))

    def several(field):
        return lambda picked: F.when((F.size(picked) > 1) & (field["kind"] != "checkboxes"), "").otherwise(F.array_join(picked, " | "))

    def chosen(field, value):
        picked = F.array_remove(F.transform(F.split(value, r"\|", -1), lambda part: choice(field["options"], part)), "")
        return F.when(field["kind"].isin(*CHOICES) & (F.size(field["options"]) > 0), once(picked, several(field))).otherwise(value)

    def ticked(field, value):
        return once(chosen(field, value), lambda v: F.when((field["kind"] == "checkbox") & (F.lower(v) != "yes"), "").otherwise(v))

    def fitted(pair):
        a, field = pair["a"], pair["field"]
        plain = trimmed(clean(F.coalesce(a["value"], F.lit(""))))
        value = once(plain, lambda v: F.when(F.lower(v) == "true", "yes").when(F.lower(v) == "false", "").otherwise(v))
        fresh = once(once(value, lambda v: ticked(field, v)), lambda v: F.when(past_start(field["label"], v, today), "").otherwise(v))
        sure = F.when(a["confidence"] == "high", "high").otherwise("low")
        return F.struct(a["id"].alias("id"), F.left(fresh, limit(field)).alias("value"), sure.alias("confidence"), F.left(trimmed(F.coalesce(a["why"], F.lit(""))), F.lit(120)).alias("why"))

    def filled(fields):
        known = F.filter(said, lambda a: F.exists(fields, lambda f: f["id"] == a["id"]))
        paired = F.transform(known, lambda a: F.struct(a.alias("a"), F.filter(fields, lambda f: f["id"] == a["id"])[0].alias("field")))
        return F.filter(F.transform(paired, fitted), lambda a: a["value"] != "")

    first = lambda kept: F.filter(kept, lambda a, i: ~F.exists(F.slice(kept, 1, i), lambda b: b["id"] == a["id"]))
    return once(once(fields, filled), first)
