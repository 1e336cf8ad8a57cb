"""All findings of the review, and the plain text, against a plain version over nested resumes of whole documents."""

import re
from hashlib import sha256

from pyspark.sql import functions as F

from gleaner import catalog
from gleaner.functions import review as V
from gleaner.plans.tables import Tables
from gleaner.queries.reviews import resumes

SF = "/root/testdata/sf0.001"


def items(text):
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def quoted(s):
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def shown(xs):
    return [x for x in xs or [] if not x["hidden"]]


def plain_review(r, pages):
    found = []
    add = lambda check, severity, target, message: found.append((check, severity, target or "", message))
    size = lambda s: len(s.encode())
    if not r["email"]:
        add("no-email", "fix", "", "Add your email address to the header.")
    if not r["phone"]:
        add("no-phone", "improve", "", "Add a phone number: many recruiters still call first.")
    if not any(re.search(r"linkedin\.com|github\.com", (x["url"] or "").lower()) for x in r["links"] or []):
        add("no-profile-link", "tip", "", "Add a LinkedIn or GitHub link; reviewers often check them.")
    if (pages or 0) > 1:
        add("too-long", "fix", "", f"The resume runs to {pages} pages. Use Fit to one page, or hide older bullets.")
    bullets, styles, experience = [], set(), False
    for s in shown(r["sections"]):
        title = (s["title"] or "").strip().lower()
        experience |= "experience" in title or "employment" in title
        if title and title not in V.STANDARD_TITLES:
            add("odd-title", "tip", s["id"], f"{quoted(s['title'])} is not a standard section name; applicant tracking systems may not file it correctly.")
        if s["kind"] == "summary" and size(s["text"] or "") > 450:
            add("long-summary", "improve", s["id"], "Keep the summary to two or three lines; recruiters skim it in seconds.")
        for g in s["skills"] or []:
            if (n := len(items(g["items"] or ""))) > 16:
                add("long-skills", "tip", s["id"], f"{quoted(g['name'])} lists {n} items. Keep the ones this kind of job asks for.")
        for e in shown(s["entries"]):
            styles |= {k for k, p in V.DATE_STYLES.items() if re.search(p, e["dates"] or "")}
            name = e["heading"] or "this entry"
            if s["kind"] == "entries" and not e["dates"]:
                add("no-dates", "improve", e["id"], f"Add dates to {name}.")
            for b in shown(e["bullets"]):
                text = (b["text"] or "").replace("**", "")
                bullets.append((b["id"], text))
                if weak := next((w for w in V.WEAK_OPENERS if text.lower().startswith(w)), None):
                    add("weak-opener", "improve", b["id"], f"Starts with {quoted(text[: len(weak)])}. Lead with a strong verb and what changed (Built, Cut, Led, Shipped).")
                if m := re.search(V.PRONOUN, text, re.ASCII):
                    add("pronoun", "improve", b["id"], f"Drop {quoted(m[1])}: resume bullets are written without I, my or we.")
                if size(text) > 230:
                    add("long-bullet", "improve", b["id"], "This bullet runs past two lines. Cut it to the action and the result.")
                elif size(text) < 35 and s["kind"] == "entries" and "education" not in title:
                    add("short-bullet", "tip", b["id"], "Short bullet: say what it achieved or how much.")
                if cliche := next((c for c in V.CLICHES if c in text.lower()), None):
                    add("cliche", "tip", b["id"], f"{quoted(cliche)} is a cliché that reviewers skip; show it with a result instead.")
            if len(shown(e["bullets"])) > 6:
                add("many-bullets", "tip", e["id"], f"{name} has {len(shown(e['bullets']))} bullets; three to five strong ones read better.")
    if not experience:
        add("no-experience", "improve", "", "Add an Experience section (internships and research count).")
    figures, stops = sum(bool(re.search("[0-9]", t)) for _, t in bullets), sum(t.endswith(".") for _, t in bullets)
    if len(bullets) >= 4 and figures * 100 // len(bullets) < 40:
        add("few-metrics", "improve", "", f"Only {figures} of {len(bullets)} bullets have a number. Add scale or results: users, latency, %, $, time saved.")
    if min(stops, len(bullets) - stops) >= 2:
        add("periods", "tip", "", "Some bullets end with a period and some don't; pick one style.")
    if len(styles) > 1:
        add("date-styles", "tip", "", "Dates use more than one format; use one (e.g. Aug 2024 – May 2026).")
    verbs = {}
    for i, t in bullets:
        if w := t.lstrip(" -•").split(" ")[0].strip(".,;:").lower():
            verbs.setdefault(w, []).append(i)
    for w in sorted(verbs, key=str.encode):
        if len(verbs[w]) >= 3 and size(w) > 2:
            add("repeated-verb", "tip", verbs[w][2], f"{len(verbs[w])} bullets start with {quoted(w)}; vary the verbs.")
    return max(0, 100 - sum(V.COSTS[f[1]] for f in found)), found


def plain_text(r):
    out = []

    def line(*parts):
        if filled := [p for p in parts if p]:
            out.append(" | ".join(filled) + "\n")

    line(r["name"])
    line(r["headline"])
    line(r["phone"], r["email"], r["location"], *[x["label"] for x in r["links"] or []])
    for s in shown(r["sections"]):
        out.append("\n" + (s["title"] or "").upper() + "\n")
        line(s["text"])
        for g in s["skills"] or []:
            line(f"{g['name'] or ''}: {g['items'] or ''}")
        for e in shown(s["entries"]):
            line(e["heading"], e["subheading"], e["tech"], e["dates"], e["location"])
            line(e["text"])
            out.extend(f"- {b['text'] or ''}\n" for b in shown(e["bullets"]))
    return re.sub(r"\A[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\Z", "", "".join(out))


def reviewed(spark, rows):
    frame = spark.createDataFrame(rows, f"k long, resume {V.RESUME}, pages int")
    return {r.k: (r.v.score, [(c.id, c.severity, c.target, c.message) for c in r.v.checks], r.text) for r in frame.select("k", V.review(F.col("resume"), F.col("pages")).alias("v"), V.plain_text(F.col("resume")).alias("text")).collect()}


def resume(**changes):
    bullet = lambda i, t, hidden=None: {"id": i, "text": t, "hidden": hidden}
    entry = {"id": "e1", "heading": "Acme", "subheading": "Engineer", "dates": "Aug 2024 – May 2026", "location": "Oslo", "tech": None, "text": None, "hidden": None}
    entry["bullets"] = changes.pop("bullets", [bullet("b1", "Filed a US Patent on deploys, i.e. faster rollbacks by 40%"), bullet("b2", "Cut **latency** of the search service by 30 percent in 2 months")])
    sections = [{"id": "s1", "kind": "entries", "title": "Experience", "hidden": None, "entries": [entry], "skills": None, "text": None}, {"id": "s2", "kind": "skills", "title": "Odd & \"new\"", "hidden": True, "entries": None, "skills": None, "text": None}]
    return {"name": "Ada", "headline": None, "phone": "1", "email": "a@b", "location": None, "links": [{"label": "me", "url": "https://LinkedIn.com/in/me"}], "sections": sections} | changes


def test_a_solid_resume_and_a_bad_one(spark):
    bad = [("b1", "Responsible for the deploy pipeline"), ("b2", "I built a dashboard that my team used every day for monitoring the production fleet"), ("b3", "Passionate team player")]
    rows = [(1, resume(), 1), (2, resume(email="", bullets=[{"id": i, "text": t, "hidden": None} for i, t in bad]), 2)]
    got = reviewed(spark, rows)
    assert got[1][:2] == (100, []) and got[1][2] == plain_text(rows[0][1])
    assert {("no-email", ""), ("too-long", ""), ("weak-opener", "b1"), ("pronoun", "b2"), ("cliche", "b3")} <= {(c[0], c[2]) for c in got[2][1]}
    assert got[2][0] < got[1][0] and got[2][:2] == plain_review(rows[1][1], 2)


def test_nothing_in_it(spark):
    empty = dict.fromkeys(("name", "headline", "phone", "email", "location", "links", "sections"))
    got = reviewed(spark, [(1, empty, None), (2, empty | {"sections": [dict.fromkeys(("id", "kind", "title", "hidden", "entries", "skills", "text"))]}, 0)])
    assert got[1] == (*plain_review(empty, None), "") and got[2][:2] == got[1][:2]


def test_whole_documents(spark):
    rows = resumes(Tables(spark, SF)).collect()
    got = {r.doc_id: r for r in catalog.QUERIES["resume_reviews"](spark, SF).collect()}
    seen = set()
    for r in rows:
        nested = r.resume.asDict(recursive=True)
        score, found = plain_review(nested, r.pages)
        seen |= {f[0] for f in found}
        mine = got[r.doc_id]
        assert (mine.score, mine.n) == (score, len(found)), r.doc_id
        assert mine.findings_sha256 == sha256("\n".join("|".join((f[0], f[1], f[2], f[3])) for f in found).encode()).hexdigest(), r.doc_id
        assert mine.text_sha256 == sha256(plain_text(nested).encode()).hexdigest(), r.doc_id
    assert len(seen) == 19, sorted(seen)
