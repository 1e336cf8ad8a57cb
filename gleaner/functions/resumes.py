"""Profiles, resumes and forms: dates as people write them, sections, cuts at words, choices, defaults of stored JSON."""

from __future__ import annotations

import re
from functools import reduce
from hashlib import sha256
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from gleaner.functions.phrases import SYNONYMS, named_phrases
from gleaner.functions.text import once, trimmed

#: Months by their first letters, and the month that a season stands for.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
SEASONS = {"spring": 3, "summer": 6, "fall": 9, "autumn": 9, "winter": 12}
PRESENT = "present|current|now|today|ongoing"
#: The sections of a profile that say what a person wants and can do.
PROFILE_SECTIONS = ("## target roles", "## technical skills", "## skills", "## licenses")
#: Common skills that a posting can name.
KNOWN_TERMS = """python,go,golang,java,javascript,typescript,rust,c++,c#,ruby,php,scala,kotlin,swift,sql,bash,
react,vue,angular,next.js,node.js,django,flask,fastapi,spring,rails,graphql,rest,grpc,
kubernetes,k8s,docker,terraform,ansible,helm,aws,azure,gcp,google cloud,linux,ci/cd,github actions,jenkins,
prometheus,grafana,opentelemetry,datadog,splunk,elasticsearch,kafka,rabbitmq,redis,postgresql,postgres,mysql,
mongodb,dynamodb,snowflake,spark,airflow,dbt,pandas,numpy,pytorch,tensorflow,scikit-learn,machine learning,
llm,rag,langchain,nlp,computer vision,microservices,distributed systems,system design,networking,security,
observability,site reliability,incident response,on-call,slos,tdd,unit testing,agile,figma,tableau,
excel,salesforce,hubspot,quickbooks,sap,netsuite,workday,google analytics,seo,adobe creative suite,photoshop,
epic,cerner,meditech,bls,acls,pals,nrp,tncc,patient care,triage,telemetry,critical care,medication administration,
iv therapy,phlebotomy,wound care,charting,hipaa,case management,infection control,cpr,first aid,
classroom management,lesson planning,curriculum development,special education,cdl,osha,forklift,food safety,servsafe""".replace("\n", "").split(",")
#: Each of them with its usual name.
KNOWN_NAMES = {t: SYNONYMS.get(plain, plain) for t in KNOWN_TERMS for plain in [re.sub("[^a-z0-9+#./]+", " ", t).strip()]}
#: Prefixes of queries and documents by what a model's name holds.
PREFIXES = (
    (("bge-", "-en"), "Represent this sentence for searching relevant passages: ", ""),
    (("snowflake-arctic-embed",), "Represent this sentence for searching relevant passages: ", ""),
    (("mxbai-embed",), "Represent this sentence for searching relevant passages: ", ""),
    (("/e5-",), "query: ", "passage: "),
    (("multilingual-e5",), "query: ", "passage: "),
    (("nomic-embed-text",), "search_query: ", "search_document: "),
)


def _year_month(year, month):
    """YYYY-MM, or the year alone where the month is none."""
    return F.when(month.between(1, 12), F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"))).otherwise(year)


def _date(token):
    """A date token as YYYY-MM or YYYY; null for a word that means the present."""
    low = F.lower(token)
    slash, dash, named = r"^(\d{1,2})\s*/\s*(\d{4})$", r"^(\d{4})\s*[-/.]\s*(\d{1,2})$", r"^([a-z]{3,9})\.?\s+(\d{4})$"
    word = F.regexp_extract(low, named, 1)
    by_name = lambda names, key: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key]
    month = F.coalesce(by_name(MONTHS, F.left(word, F.lit(3))), by_name(SEASONS, word), F.lit(0))
    return (
        F.when(low.rlike(slash), _year_month(F.regexp_extract(low, slash, 2), F.regexp_extract(low, slash, 1).cast("int")))
        .when(low.rlike(dash), _year_month(F.regexp_extract(low, dash, 1), F.regexp_extract(low, dash, 2).cast("int")))
        .when(low.rlike(named), _year_month(F.regexp_extract(low, named, 2), month))
        .when(low.rlike(r"^\d{4}$"), low)
    )


def parsed_dates(text):
    """Struct (start, end, current) of a range of dates: YYYY-MM or YYYY, empty where it says none; no end while it runs."""
    pattern = rf"(?i){PRESENT}|\d{{1,2}}\s*/\s*\d{{4}}|\d{{4}}\s*[-/.]\s*\d{{1,2}}\b|[a-z]{{3,9}}\.?\s+\d{{4}}|\d{{4}}"
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))

    def read(found):
        current = F.exists(found, lambda t: F.lower(t).rlike(f"^(?:{PRESENT})$"))
        dates = F.array_compact(F.transform(found, _date))
        first = F.coalesce(F.try_element_at(dates, F.lit(1)), F.lit(""))
        last = F.when((F.size(dates) > 1) & ~current, F.try_element_at(dates, F.lit(-1))).otherwise("")
        return F.struct(first.alias("start"), last.alias("end"), current.alias("current"))

    return once(tokens, read)


def recent_first(entries):
    """An array of structs with end and current, the current ones first, then by end, latest first, none being the latest; equal ones as they stood."""
    end = lambda e: F.coalesce(F.nullif(e["end"], F.lit("")), F.lit("9999"))
    placed = F.transform(entries, lambda e, i: F.struct((~e["current"]).cast("int").alias("past"), end(e).alias("end"), i.alias("i"), e.alias("e")))
    later = lambda a, b: F.when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(a["i"] - b["i"])
    ordered = F.array_sort(placed, lambda a, b: F.when(a["past"] != b["past"], a["past"] - b["past"]).otherwise(later(a, b)))
    return F.transform(ordered, lambda k: k["e"])


def past_start(label, value, today):
    """Whether a form's answer is a start that has gone by on the date ``today``: a day, a month that is over, or years all before this one."""

    def gone(v):
        day = F.to_date(F.try_to_timestamp(v, F.lit("yyyy-MM-dd")))
        american = F.to_date(F.try_to_timestamp(v, F.lit("M/d/yyyy")))
        month = F.to_date(F.try_to_timestamp(v, F.lit("yyyy-M")))
        years = F.regexp_extract_all(v, F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0))
        return (
            F.when(v.rlike(r"^\d{4}-\d\d-\d\d$") & day.isNotNull(), day < today)
            .when(v.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.coalesce(american < today, F.lit(False)))
            .when(v.rlike(r"^\d{4}-\d{1,2}$"), F.coalesce(F.add_months(month, 1) <= today, F.lit(False)))
            .otherwise(once(years, lambda years: (F.size(years) > 0) & F.forall(years, lambda y: y.cast("int") < F.year(today))))
        )

    return label.rlike("(?i)start|availab|join|begin|commence") & F.coalesce(once(trimmed(value), gone), F.lit(False))


def zone_or_utc(name: str | None) -> str:
    """A time zone's name if there is such a zone, else UTC."""
    try:
        return ZoneInfo(name).key if name and len(name) <= 64 else "UTC"
    except (KeyError, ValueError, OSError):
        return "UTC"


def profile_sections(markdown):
    """The sections of a profile that are used for matching, a blank line between them; all of it where it has none of them."""
    parts = F.filter(F.split(markdown, "(?m)(?=^## )", -1), lambda p: p.startswith("## "))
    titled = lambda p: F.lower(trimmed(F.substring_index(p, "\n", 1)))
    kept = F.filter(parts, lambda p: reduce(lambda a, b: a | b, [titled(p).startswith(s) for s in PROFILE_SECTIONS]))
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, trimmed), "\n\n")).otherwise(markdown)


def facts_text(seniority, skills, digest):
    """What a posting's facts read as."""
    return F.concat(F.lit("Seniority: "), F.coalesce(seniority, F.lit("")), F.lit(". Skills: "), F.coalesce(F.array_join(skills, ", "), F.lit("")), F.lit(". "), F.coalesce(digest, F.lit("")))


def document_text(title, seniority, skills, digest):
    """What a posting is embedded as: its title and its facts."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), facts_text(seniority, skills, digest))


def model_prefixes(model: str) -> tuple[str, str]:
    """The prefixes of queries and of documents that an embedding model expects."""
    low = model.lower()
    return next(((query, document) for parts, query, document in PREFIXES if all(p in low for p in parts)), ("", ""))


def keyed_model(model: str, kind: str, prefix: str) -> str:
    """The name that vectors of a model are stored under: vectors made with another prefix are of another kind."""
    return f"{model}#{kind}{sha256(prefix.encode()).hexdigest()[:8]}" if prefix else model


def keyword_windows(text, words: list[str], reach: int = 250):
    """The parts of a text within ``reach`` characters of one of ``words``, overlapping ones as one, with a line between; empty where none occurs."""
    any_word = "(?:" + "|".join(rf"\Q{w}\E" for w in words) + ")"
    pattern = rf"(?is).{{0,{reach}}}{any_word}(?:.{{0,{2 * reach}}}?{any_word})*.{{0,{reach}}}"
    found = F.rlike(text, F.lit(f"(?i){any_word}"))
    return F.when(found, F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), " \n ")).otherwise("")


def first_sentence(text, n: int):
    """The first sentence of a text, cut at a word to at most ``n`` bytes, with an ellipsis where it is cut."""
    whole = trimmed(text)
    stop = F.instr(whole, ". ")
    sentence = F.when(stop > 1, F.left(whole, stop)).otherwise(whole)
    clipped = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(sentence, "UTF-8"), 1, n).cast("string")), r"\x{FFFD}+\z", "")
    space = F.length(clipped) - F.instr(F.reverse(clipped), " ")
    head = F.when((F.instr(clipped, " ") > 0) & (F.octet_length(F.left(clipped, space)) >= n // 2), F.left(clipped, space)).otherwise(clipped)
    return F.when(F.octet_length(sentence) <= n, sentence).otherwise(F.concat(F.rtrim(head, F.lit(" ,;:")), F.lit("…")))


def clean_text(text, most: int = 30_000):
    """Uploaded text: white space of a line as single blanks, one blank line at most, ``most`` characters."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1), lambda line: trimmed(F.regexp_replace(line, r"[ \t\f\x0B]+", " ")))
    return F.left(trimmed(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")), F.lit(most))


def known_terms(text):
    """The common skills that a text names, by their first place in it; skills of one name once."""
    entries = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(name).alias("name")) for t, name in KNOWN_NAMES.items()])

    def hits(both):
        near = F.filter(both["have"], lambda p: p.isin(*{*KNOWN_NAMES, *KNOWN_NAMES.values()}))
        held = once(near, lambda near: F.filter(entries, lambda e: F.array_contains(near, e["name"]) | F.array_contains(near, e["term"])))
        first = once(held, lambda held: F.filter(held, lambda e, i: ~F.exists(F.slice(held, 1, i), lambda x: x["name"] == e["name"])))
        at = lambda e: once(F.instr(both["low"], e["term"]), lambda at: F.when(at > 0, at).otherwise(F.length(both["low"]) + 1))
        placed = F.transform(first, lambda e, i: F.struct(at(e).alias("at"), i.alias("i"), e["term"].alias("term")))
        return F.transform(F.array_sort(placed), lambda p: p["term"])

    with_phrases = lambda low: F.struct(low.alias("low"), named_phrases(low).alias("have"))
    return once(once(F.lower(F.coalesce(text, F.lit(""))), with_phrases), hits)


def choice(options, value):
    """The first of a form's options that a value names, case and white space aside; empty where it names none."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[\x09-\x0D\x20\x{85}\x{A0}]+", " "))
    named = once(plain(value), lambda v: F.filter(options, lambda o: plain(o) == v))
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.lit(""))


def capitalized(text):
    """Words in lower case with a capital, a word being a run of letters and digits."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0)), lambda w: F.initcap(F.lower(w))), "")


def storable(text):
    """``text`` without characters that a text column cannot store."""
    return F.replace(text, F.lit("\0"), F.lit(""))


def json_text(text):
    """Any text as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[(.*)\]\z", "$1")


def json_flag(document, path: str):
    """A boolean inside a JSON document; null where it is none."""
    return F.get_json_object(document, path).try_cast("boolean")


def json_setting(document, path: str, default):
    """A stored setting, or its default where the document does not have it."""
    return F.coalesce(F.get_json_object(document, path), F.lit(default).cast("string"))


def json_details(document):
    """The filled entries of a JSON object of strings as an array of (key, value), by key."""
    entries = F.map_entries(F.from_json(document, "map<string,string>"))
    return F.array_sort(F.filter(entries, lambda e: trimmed(F.coalesce(e["value"], F.lit(""))) != ""))


#: Answers about oneself that were stored by default, and the word that stood for none.
SELF_DESCRIBED, DECLINED = ("gender", "race", "hispanic", "veteran", "disability", "transgender", "sexual_orientation"), "decline"


def json_patch(document, *patches):
    """A JSON object with those of ``patches``, JSON objects too, laid over it one after the other, by their top fields.

    Fields that no patch names stay as they are, whatever is in them; fields come out by name, numbers in their plain
    form. A patch that is null or no object changes nothing; a document that is null or no object stays.
    """
    fields = lambda d: F.from_json(d, "map<string,variant>")
    entries = lambda d: F.coalesce(F.map_entries(fields(d)), F.array().cast("array<struct<key: string, value: variant>>"))

    def over(merged, new):
        return F.concat(F.filter(merged, lambda e: ~F.exists(new, lambda n: n["key"] == e["key"])), new)

    merged = reduce(over, map(entries, patches), entries(document))
    by_name = F.array_sort(merged, lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
    return F.when(fields(document).isNotNull(), F.to_json(F.map_from_entries(by_name))).otherwise(document)


def without_stored_defaults(document):
    """Stored details in which answers about oneself that were only a default are empty; all others stay."""
    said = lambda name: F.get_json_object(document, f"$.{name}") == DECLINED
    return json_patch(document, *[F.when(said(name), F.lit(f'{{"{name}":""}}')) for name in SELF_DESCRIBED])
