"""Text functions of posting intelligence, as column expressions; Arrow UDFs only where Spark has no built-in."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a filing name that never tell employers apart, and those ignored only when names are compared.
LEGAL = "inc incorporated llc l c corp corporation co company ltd limited lp llp plc pc pllc pbc na n a com the".split()
GENERIC = "services service technologies technology tech systems labs group holdings holding usa us international intl global platforms software ai io hq opco".split()
JOINERS = ("of", "and", "for", "the")
#: White space of any kind, and that of ASCII alone, inside a character class.
SPACE, ASCII_SPACE = r"\s\x{00A0}", r"\s"


def trimmed(text):
    """``text`` without white space of any kind at its ends."""
    return trimmed_of(text, SPACE)


def trimmed_of(text, space):
    """``text`` without characters of the class ``space`` at its ends."""
    return F.regexp_replace(text, rf"^[{space}]+|[{space}]+\z", "")


def once(value, build):
    """``build`` of a column, which is computed once however often ``build`` reads it."""
    return F.transform(F.array(value), build)[0]


def tag(text):
    """A short reason tag: lower case, runs of anything but a-z and 0-9 become one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def content_hash(title, location, description):
    """Hex sha256 of what makes a posting's content: title without case, location, description."""
    parts = [F.coalesce(c, F.lit("")) for c in (F.lower(trimmed(title)), trimmed(location), description)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def manual_hash(title, location, description):
    """The hash of postings that users add by hand; not the same as ``content_hash``."""
    return F.sha2(F.concat(title, F.lit("\0"), location, F.lit("\0"), description), 256)


def score_key(profile_hash):
    """The key that scores of the second method are stored under."""
    return F.sha2(F.concat(F.lit("score-v2\n"), profile_hash), 256)


def _name_words(name):
    low = F.lower(name)
    dba = F.instr(low, " dba ")
    low = F.when(dba > 1, F.substring(low, 1, dba - 1)).otherwise(low)
    words = F.trim(F.regexp_replace(F.replace(low, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
    return F.regexp_replace(words, r"^(\S+(?: \S+)*?) d b a(?: .*)?\z", "$1")


def _without_endings(words, endings):
    """Drops trailing words of ``endings`` while another word stays and the word before is no joiner, then a leading "the"."""
    pattern = rf"(?:(?<!\b(?:{'|'.join(JOINERS)})) (?:{'|'.join(endings)}))+\z"
    return F.regexp_replace(F.regexp_replace(words, pattern, ""), "^(?:the )+", "")


def employer_key(name):
    """The name in lower-case words without punctuation and legal forms."""
    return _without_endings(_name_words(name), LEGAL)


def loose_key(name):
    """``employer_key`` without generic endings too; empty when fewer than five letters are left."""
    key = _without_endings(employer_key(name), LEGAL + GENERIC)
    return F.when(F.length(key) >= 5, key).otherwise("")


def title_case(text):
    """White-space words in lower case with a capital."""
    return F.initcap(F.lower(F.regexp_replace(trimmed(text), r"\s+", " ")))


def trigrams(text):
    """The set of three-letter pieces of each word, padded by two blanks in front and one behind."""
    words = F.array_remove(F.split(F.lower(text), "[^a-z0-9]+", -1), "")
    pieces = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def similarity(a, b):
    """Share of three-letter pieces that two texts have in common; 0 where neither has any."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


TRACKING = ("ref", "source", "src", "gh_src", "lever-source")


def url_key(url):
    """A URL for comparison: host in lower case, no fragment, no tracking parameters, no slash at the end, parameters by name."""
    plain = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(plain, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(plain, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    path = F.rtrim(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), F.lit("/"))
    query = F.when(F.contains(plain, F.lit("?")), F.regexp_extract(plain, r"\?(.*)$", 1)).otherwise("")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING) & ~F.lower(p).startswith("utm_"))
    parameters = F.array_join(F.array_sort(kept), "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(parameters != "", F.concat(F.lit("?"), parameters)).otherwise(""))


def answer_key(question):
    """A form question for comparison: lower case, no "required" ending, words of letters and numbers."""
    low = F.regexp_replace(F.lower(question), r"\s*\(?\*?\s*required\s*\)?\s*\z", "")
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))


def clean_tags(tags, longest: int = 24, most: int = 5):
    """Slugs of an array of tags, cut to ``longest`` characters, each once, the first ``most``."""
    slugs = F.transform(tags, lambda t: F.trim(F.left(F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(longest)), F.lit("-")))
    return F.slice(F.array_distinct(F.filter(slugs, lambda s: s != "")), 1, most)


def excerpt(body, n: int = 280):
    return F.left(body, F.lit(n))


def read_minutes(body):
    """Minutes to read a text: 1,100 characters each, at least one."""
    return F.greatest(F.lit(1), F.round(F.length(body) / 1100).cast("long"))


def evidence_sentence(text, pattern: str):
    """The first sentence that matches ``pattern``, trimmed; else 60 characters around the first match; null without a match."""
    sentences = F.filter(F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0)), lambda s: s.rlike(pattern))
    at = F.regexp_instr(text, F.lit(pattern))
    around = F.substring(text, F.greatest(at - 60, F.lit(1)), F.length(F.regexp_substr(text, F.lit(pattern))) + F.least(at - 1, F.lit(60)) + 60)
    return F.when(text.rlike(pattern), F.coalesce(trimmed(F.try_element_at(sentences, F.lit(1))), around))


def phrase_set(text, most: int = 3):
    """The runs of one to ``most`` words of a text, in lower case and each once."""
    run = lambda words, n: lambda _, i: F.array_join(F.slice(words, i + 1, n), " ")

    def runs(words):
        longer = [F.transform(F.slice(words, 1, F.greatest(F.size(words) - n + 1, F.lit(0))), run(words, n)) for n in range(2, most + 1)]
        return F.array_distinct(F.concat(words, *longer))

    words = F.array_remove(F.split(F.lower(text), r"[^a-z0-9+#./]+", -1), "")
    return once(F.coalesce(words, F.array().cast("array<string>")), runs)


#: Phrases that stay one term, and words that carry no meaning.
PHRASES = {
    "c++": "cplusplus", "c#": "csharp", ".net": "dotnet", "node.js": "nodejs", "next.js": "nextjs", "react.js": "react", "vue.js": "vue", "ci/cd": "cicd",
    "machine learning": "machinelearning", "deep learning": "deeplearning", "data science": "datascience", "computer vision": "computervision",
    "site reliability": "sre", "full stack": "fullstack", "full-stack": "fullstack", "back end": "backend", "back-end": "backend", "front end": "frontend", "front-end": "frontend",
}
STOP_WORDS = frozenset(
    """a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing
    down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor
    not now of off on once only or other our ours out over own same she should so some such than that the their them then there these they this those
    through to too under until up very was we were what when where which while who whom why will with would you your yours etc ie eg via per within
    across including include includes us team teams work working role roles job jobs company candidate candidates experience years year ability strong
    excellent good great new looking join help using use used well like make build building""".split()
)


def tokens(text):
    """Words for relevance as an array: lower case, phrases as one term, stop words and single bytes gone except the languages r and c."""
    joined = F.lower(F.coalesce(text, F.lit("")))
    for phrase, term in PHRASES.items():
        joined = F.replace(joined, F.lit(phrase), F.lit(f" {term} "))
    words = F.transform(F.split(joined, r"[^\p{L}\p{Nd}+#]+", -1), lambda w: F.trim(w, F.lit("+#")))
    return F.filter(words, lambda w: ~w.isin(*sorted(STOP_WORDS)) & ((F.octet_length(w) >= 2) | w.isin("r", "c")))


#: What a style says that puts an element out of sight, and the elements that are searched for it.
HIDDEN_STYLES = (
    r"display\s*:\s*none",
    r"visibility\s*:\s*hidden",
    r"font-size\s*:\s*[0-2](?:\.\d+)?(?:px|pt|em|rem|%)?\s*(?:;|[\"'])",
    r"opacity\s*:\s*0(?:\.0\d*)?\s*(?:;|[\"'])",
    r"color\s*:\s*(?:transparent|#fff(?:fff)?\b|white\b|rgb\(\s*255\s*,\s*255\s*,\s*255\s*\))",
    r"(?:left|top|text-indent)\s*:\s*-\d{3,}(?:\.\d+)?px",
)
HIDDEN_TAGS = "span|div|p|font|small|li|td|section|b|i|em|strong"
#: Elements whose end is a blank line, and whose end is a line.
BLOCK_TAGS, ITEM_TAGS = "p|div|h[1-6]|pre|blockquote|section|article|table|tr|ul|ol", "li|dt|dd"


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else html.unescape(t) for t in texts], dtype=object)


def unescaped(text):
    """``text`` with HTML entities as characters; only texts with an ampersand leave the JVM."""
    marked = F.contains(text, F.lit("&"))
    return F.when(marked, _unescaped(F.when(marked, text))).otherwise(text)


def html_to_text(page):
    """The visible text of HTML: entities twice undone, scripts, styles and elements styled out of sight gone, a line
    for each item and a blank line between blocks. Null stays null."""
    out = unescaped(F.col(page) if isinstance(page, str) else page)
    for tag_name in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<\s*{tag_name}[^>]*>.*?<\s*/\s*{tag_name}\s*>", " ")
    hidden = rf"""(?is)<(?:{HIDDEN_TAGS})\b[^>]*\bstyle\s*=\s*["'][^"']*(?:{"|".join(HIDDEN_STYLES)})[^>]*>.*?</(?:{HIDDEN_TAGS})\s*>"""
    # the costly pattern only where a page has a style at all; the page so far is computed once for both
    out = F.transform(F.array(out), lambda o: F.when(o.rlike(r"(?i)style\s*="), F.regexp_replace(o, hidden, " ")).otherwise(o))[0]
    for pattern, put in ((r"(?i)<\s*br\s*/?>", "\n"), (rf"(?i)</\s*(?:{BLOCK_TAGS})\s*>", "\n\n"), (rf"(?i)</\s*(?:{ITEM_TAGS})\s*>", "\n"), (r"<[^>]*>", "")):
        out = F.regexp_replace(out, pattern, put)
    lines = F.transform(F.split(unescaped(out), "\n", -1), lambda line: trimmed(F.regexp_replace(line, r"[ \t\r\f\x0B\x{00A0}]+", " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+\z", "")


def clipper(n: int):
    """A function of a text column that cuts it to ``n`` bytes of UTF-8 without breaking a character."""

    @F.pandas_udf(T.StringType())
    def clip(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else t.encode()[:n].decode("utf-8", "ignore") for t in texts], dtype=object)

    return clip
