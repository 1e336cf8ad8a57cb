"""Personal data: fixed base patterns, and identifiers discovered by bootstrapped contexts.

The base kinds are found by regular expressions. Beyond them, every token of letters, digits and inner signs that has a
digit and SHORTEST letters and digits is a candidate instance. An instance has two lexical patterns: its context (the
last word before it and the signs in between, up to the match before, where these tell: TELLING) and its form. Seed instances, which are the spans
of the base rules, values of a known form and values after a telling word, induce patterns; in each round a pattern's
confidence is the mean score of its instances, and an instance's score is the best confidence of its patterns, until
scores stand still. What a confident context with enough instances vouches for in the end is reported as kind
``secret``, so that its other values are found whatever they look like. Built-in functions only; all counts are over
the whole table.

Positions come from splitting a text at its matches: the lengths of the parts and of the matches add up to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut

#: The base patterns, and for each a cheap sign without which a text has no match. Possessive and anchored forms of
#: the plain patterns with the same matches: every run is read once, whatever its length.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": (EMAIL, "@"), "ip": (IP, r"[0-9]\.[0-9]"), "card": (CARD, r"[0-9][\x20-]?[0-9]"), "phone": (PHONE, r"\+[0-9]")}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

#: Candidates: runs of letters, digits and the signs ._+- with a digit. A run is read once, from its start on.
CANDIDATE, CANDIDATE_SIGN = r"(?<![A-Za-z0-9._+-])(?=[A-Za-z._+-]*+[0-9])[A-Za-z0-9._+-]++", "[0-9]"
#: Letters and digits that a candidate needs, and from which lengths are one form.
SHORTEST, LONG = 8, 16
#: Seeds beside the base spans: values of a known form, and words in front of a value that tell what it is.
SEED_VALUES = ("^AKIA[0-9A-Z]{16}$",)
SEED_WORDS = ("password", "passwd", "secret", "token", "credential", "apikey")
#: Most rounds of scoring, and the confidence and the different instances that a context needs to vouch for a value.
ROUNDS, CONFIDENCE, SUPPORT = 10, 0.5, 3
#: A context tells what follows by a sign that assigns or names it, or by a seed word; "the " does not.
TELLING = "[:=#]"
#: A context with more characters stands for itself by its digest.
CONTEXT = 64

SPANS = "array<struct<start: int, end: int, value: string>>"
FOUND = "array<struct<start: int, end: int, value: string, context: string>>"


def with_matches(docs: DataFrame, text: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """``docs`` with a column of spans (start, end, value, context) for each pattern: leftmost matches that do not overlap, in code points.

    The context is the last word before a match, in lower case, and the signs in between, as far as the match before;
    null if there is no word or no telling sign or word.
    """
    t = F.col(text)
    for name, (pattern, sign) in patterns.items():
        found = t.contains(sign) if sign == "@" else t.rlike(sign)
        docs = docs.withColumns(
            {
                f"_hits_{name}": F.when(found, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))),
                f"_parts_{name}": F.when(found, F.split(t, pattern, -1)),
            }
        )
    spans = {}
    for name in patterns:
        pairs = F.zip_with(F.col(f"_hits_{name}"), F.slice(f"_parts_{name}", 1, F.size(f"_hits_{name}")), lambda hit, part: F.struct(hit.alias("hit"), F.length(part).alias("gap"), _context(part).alias("context")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("spans"))

        def step(so_far, pair):
            begin = so_far["at"] + pair["gap"]
            end = begin + F.length(pair["hit"])
            span = F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("value"), pair["context"].alias("context"))
            return F.struct(end.alias("at"), F.array_append(so_far["spans"], span).cast(FOUND).alias("spans"))

        some = F.when(F.size(f"_hits_{name}") > 0, F.aggregate(pairs, start, step, lambda x: x["spans"]))
        spans[name] = F.coalesce(some, F.array().cast(FOUND))
    return docs.withColumns(spans).drop(*[f"_{x}_{name}" for name in patterns for x in ("hits", "parts")])


def _context(part):
    """The end of a text, read backwards from there so that nothing is read twice; see with_matches()."""
    end = F.lower(F.reverse(F.regexp_extract(F.reverse(part), r"^[^\p{L}\p{N}]*+\p{L}*+", 0)))
    tells = end.rlike(r"\p{L}") & (end.rlike(TELLING) | end.rlike("|".join(SEED_WORDS)))
    return F.when(tells, F.when(F.length(end) > CONTEXT, F.sha2(end, 256)).otherwise(end))


def _digits(value):
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(value):
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(digits, F.lit(0), lambda total, d: total + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def with_base_spans(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with columns email, ip, card and phone, the spans of the base rules, and refused: what looked like an ip or card and failed its check."""
    docs = with_matches(docs, text, KINDS)
    length = lambda v: F.length(_digits(v))
    valid = {
        "ip": lambda s: s["value"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
        "card": lambda s: F.when(length(s["value"]).between(16, 19), _luhn(s["value"])).otherwise(False),
        "phone": lambda s: length(s["value"]).between(8, 15),
    }
    failed = [F.filter("ip", lambda s: ~valid["ip"](s)), F.filter("card", lambda s: length(s["value"]).between(16, 19) & ~_luhn(s["value"]))]
    return docs.withColumns({"refused": F.concat(*failed)} | {name: F.filter(name, test) for name, test in valid.items()})


def with_candidates(docs: DataFrame, text: str, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` (with the base spans) with a column candidates of spans (start, end, value, context) apart from those and from what was refused."""
    docs = with_matches(docs, text, {"_found": (CANDIDATE, CANDIDATE_SIGN)})

    def trimmed(s):
        head = F.length(F.regexp_extract(s["value"], r"^[._+-]*+", 0))
        value = F.regexp_replace(s["value"], r"^[._+-]++|(?<![._+-])[._+-]++$", "")
        start = s["start"] + head
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), s["context"].alias("context"))

    long = lambda s: F.length(F.regexp_replace(s["value"], r"[._+-]+", "")) >= shortest
    found = F.filter(F.transform("_found", trimmed), long)
    return docs.withColumn("candidates", _apart(found, F.concat(*KINDS, "refused"))).drop("_found", "refused")


def form(value):
    """The form of a value: its kind of letters and digits and its length up to LONG, or, with signs in it, its characters by kind."""
    plain = (
        F.when(value.rlike("^[0-9]+$"), "digits").when(value.rlike("^[0-9a-f]+$"), "hex").when(value.rlike("^[0-9A-Z]+$"), "upper").when(value.rlike("^[0-9a-z]+$"), "lower").when(value.rlike("^[0-9A-Za-z]+$"), "mixed")
    )
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")
    return F.when(plain.isNotNull(), F.concat_ws(" ", plain, F.least(F.length(value), F.lit(LONG)).cast("string"))).otherwise(F.sha2(shape, 256))


def _met(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each value of ``column``.

    Both sides are dealt by a hash of the column that stands for this join alone: so neither comes dealt by it already,
    and the adaptive skew join can split the rows of a value that very many rows hold.
    """
    deal = F.xxhash64(F.lit("deal"), column).alias("_deal")
    return left.select("*", deal).join(right.select("*", deal), ["_deal", column]).drop("_deal")


def accepted_values(occurrences: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT, seed_values=SEED_VALUES, seed_words=SEED_WORDS) -> DataFrame:
    """Rows (value,): instances that the graph accepts, from occurrences (value, context, base).

    Seeds keep score 1: base spans, values that match one of ``seed_values``, and values whose context holds one of
    ``seed_words``. Any other instance needs a score of ``confidence`` and a context of that confidence in which
    ``support`` different instances stand. Scores only grow, and the rounds end when they do no more, after ``rounds``
    at the latest.
    """
    seed = F.col("base")
    for pattern in seed_values:
        seed = seed | F.col("value").rlike(pattern)
    for word in seed_words:
        seed = seed | F.coalesce(F.contains("context", F.lit(word)), F.lit(False))
    seeded = occurrences.groupBy("value", "context").agg(F.max(seed).alias("seed"))
    patterns = F.array_compact(F.array(F.concat(F.lit("context "), "context"), F.concat(F.lit("form "), form(F.col("value")))))
    edges = cut(seeded.select("value", F.explode(patterns).alias("pattern"), "seed").groupBy("value", "pattern").agg(F.max("seed").alias("seed")))
    scores = cut(edges.groupBy("value").agg(F.max("seed").cast("double").alias("score"), F.max("seed").alias("vouched")))
    before = -1.0
    for _ in range(rounds):
        total = scores.agg(F.sum("score")).first()[0] or 0.0
        if total - before < 1e-6 * max(1.0, total):
            break
        before = total
        trusted = _met(edges, scores.select("value", "score"), "value").groupBy("pattern").agg((F.sum("score") / F.count("*")).alias("confidence"), F.count("*").alias("support"))
        voted = _met(edges, trusted, "pattern")
        vouched = F.col("pattern").startswith("context ") & (F.col("confidence") >= confidence) & (F.col("support") >= support)
        scores = cut(voted.groupBy("value").agg(F.greatest(F.max("seed").cast("double"), F.max("confidence")).alias("score"), (F.max("seed") | F.max(vouched)).alias("vouched")))
    return scores.where((F.col("score") >= confidence) & F.col("vouched")).select("value")


def occurrences_of(rows: DataFrame, row: str) -> DataFrame:
    """Rows (row, start, end, value, context, base): the base spans and the candidates of ``rows``."""
    tagged = lambda name, base: F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["context"].alias("context"), F.lit(base).alias("base")))
    return rows.select(F.col(row).alias("row"), F.explode(F.concat(*[tagged(k, True) for k in KINDS], tagged("candidates", False))).alias("o")).select("row", "o.*")


def _joined(kind: str, spans):
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def _apart(spans, others):
    """``spans`` without those that overlap one of ``others``."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, **graph) -> DataFrame:
    """One row for each row of ``docs``: doc_id, email, ip, card, phone, secret (arrays of start, end, value) and row.

    A null text is empty; positions count code points; a match that fails its check is dropped and not tried again;
    candidates have ``shortest`` letters and digits or more, and one that overlaps a base span, or a number of 16 to 19
    digits or of dotted groups that failed its check, is none; repeated rows
    are searched one by one; other columns are not read; an empty table gives no rows. The work on a text grows with
    its length and with the square of its matches. ``graph``: see accepted_values().
    """
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    rows = with_candidates(with_base_spans(texts, "_text"), "_text", shortest)
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", *KINDS, "candidates"))
    occurrences = occurrences_of(rows, "row")
    found = _met(occurrences.where("NOT base"), accepted_values(occurrences, **graph), "value")
    secrets = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("secret"))
    plain = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).alias(k) for k in KINDS]
    return rows.select("row", "doc_id", *plain).join(secrets, "row", "left").withColumn("secret", F.coalesce("secret", F.array().cast(SPANS)))


def pii_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret) of ``personal_data``."""
    found = personal_data(docs, doc_id, text, **options)
    base = F.concat(*[_joined(k, F.col(k)) for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _joined("secret", F.col("secret"))), ",").alias("spans"),
        F.size("secret").cast("long").alias("n_secret"),
    )


def masked(text, spans):
    """A text column with each of ``spans`` (start, end, kind; sorted; one that starts inside an earlier one is merged into it) replaced by its kind in brackets."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(so_far, s):
        inside = s["start"] < so_far["at"]
        gap = F.concat(so_far["out"], F.substring(text, so_far["at"] + 1, s["start"] - so_far["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(so_far["at"], s["end"]).alias("at"), F.when(inside, so_far["out"]).otherwise(gap).alias("out"))

    return F.aggregate(spans, start, step, lambda x: F.concat(x["out"], F.substring(text, x["at"] + 1, F.length(text))))


def masked_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", shortest: int = SHORTEST, **graph) -> DataFrame:
    """``docs`` with every span of personal data replaced by ``[kind]``; ``n_chars``, where there is such a column, is counted anew.

    The texts without spans and candidates do not move: only values that the graph accepts are joined, to the texts
    that have some. A null text stays null; other columns come through as they were, whatever their names. Options are
    those of personal_data().
    """
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("_doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    spanned = with_candidates(with_base_spans(packed, "_text"), "_text", shortest)
    kinds = lambda k, spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind")))
    # one row out of an array of one or none: so the spans are computed once, where a filter on them would compute them again
    some = lambda x: F.size(F.concat(*[kinds(k, x[k]) for k in (*KINDS, "candidates")])) > 0
    hits = F.explode_outer(F.filter(F.array(F.struct(*KINDS, "candidates")), some)).alias("_s")
    sought = spanned.select("_doc", "_text", hits)
    marked = cut(sought.where("_s IS NOT NULL").select("_doc", "_text", "_s.*", F.monotonically_increasing_id().alias("_row")))
    plain = sought.where("_s IS NULL")
    occurrences = occurrences_of(marked, "_row")
    accepted = _met(occurrences.where("NOT base"), accepted_values(occurrences, **graph), "value")
    secrets = accepted.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "end", F.lit("secret").alias("kind"))).alias("_secret"))
    none = F.array().cast("array<struct<start: int, end: int, kind: string>>")
    marked = marked.join(secrets, "_row", "left")
    spans = F.array_sort(F.concat(*[kinds(k, F.col(k)) for k in KINDS], F.coalesce("_secret", none)))
    out = plain.select("_doc", "_text", none.alias("_spans")).unionByName(marked.select("_doc", "_text", spans.alias("_spans")))
    old = {c: F.col(f"_doc.c{i}") for i, c in enumerate(columns)}
    out = out.withColumn("_new", F.when((F.size("_spans") > 0) & old[text].isNotNull(), masked(F.col("_text"), F.col("_spans"))).otherwise(old[text]))
    new = {text: F.col("_new")}
    if n_chars in old:
        new[n_chars] = F.length("_new").cast(docs.schema[n_chars].dataType)
    return out.select(*[new.get(c, old[c]).alias(c) for c in columns])
