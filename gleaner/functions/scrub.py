"""Posting text without what is aimed at machines: invisible characters, and sentences that order a tool what to write."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import once, trimmed

#: Characters that show nothing, and letters of other alphabets that read like Latin ones.
INVISIBLE = r"[\x{00ad}\x{034f}\x{061c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{e0000}-\x{e007f}]"
LOOKALIKES = ("аеорсухіѕјкмтвнАЕОРСХІТМКВαοινΙΑΟ", "aeopcyxisjkmtbhAEOPCXITMKBaoivIAO")

#: Whom a sentence can speak to, what it can order, what makes a tool's name a person's work, what makes a tool the job's subject.
TOOL = r"(?:ai|a\.i\.|artificial intelligence|llms?|large language models?|language models?|gpts?(?:-?\d)?|chat ?gpt|claude|gemini|copilot|bots?|robots?|machines?|non-?humans?|automated (?:tools?|systems?|agents?|applicants?|programs?|scripts?|assistants?|applications?|software)|(?:ai|generative|autonomous|automated|auto-?fill|auto-?apply|llm|language) (?:tools?|systems?|agents?|assistants?|models?|applicants?|programs?|scripts?|software|extensions?|browsers?|writers?)|auto-?fill(?:ers?)?|auto-?appl(?:y|iers?)|virtual assistants?|crawlers?|scrapers?)"
DO = r"(?:fill|enter|type|write|answer|respond|reply|put|place|select|choose|pick|tick|check|mark|click|include|mention|use|start|begin|end|add|say|state|output|return|insert|append|prepend|submit|give|provide|leave|skip|ignore|disregard|do not|don'?t|you (?:must|should|need to)|must|should)"
ROLE = r"[\s/&-]*(?:ml\b|learning|engineer|research|scientist|developer|practitioner|specialist|lead|manager|team|product|startup|compan|experience|skills?\b|ethics|safety|policy|strategy|programs?\b|operator|technician|shop|enthusiast|expert|architect|consultant|professional|student|native|first)"
OWN = r"\b(?:the|our|your|this|that|a|an|their|its)\s{1,8}"
#: Stand in the patterns below for a tool's name, and for one that is not someone's own.
NAME, OTHERS_NAME = "<tool>", "<tool of none>"

#: How a sentence speaks to a tool.
SPOKEN = (
    rf"\bif\s+(?:you(?:['’]?re| are)\s+|this\b[^.!?\n]{{0,50}}?\b(?:is|was|are|were)(?:\s+being)?\s+\w+(?:\s+(?:out|in))?\s+(?:by|with)\s+|(?:an?|the)\s+)(?:an?\s+|the\s+|any\s+)?{NAME}[^.!?\n]{{0,40}}?\b{DO}\b",
    rf"\b(?:attention|note|notice|message|instructions?|important|warning|hey|hello|hi|dear|greetings)\b[\s,:-]*(?:to|for)?\s*(?:all\s+|any\s+|the\s+)?{NAME}\s*(?:[,:;!]|-\s)",
    rf"\b(?:to|for)\s+(?:all|any|every)\s+{NAME}(?:\s+(?:reading|parsing|processing|seeing|scanning)\b[^,:;.!?\n]{{0,30}})?\s*[,:;]",
    rf"(?:^|[.!?]\s+){NAME}\s*:\s*(?:please\s+)?{DO}\b",
    rf"\bif\s+(?:you(?:['’]?re| are)?\s+)?(?:using|use|used)\s+(?:an?\s+)?{NAME}[^.!?\n]{{0,70}}?\b(?:include|mention|add|write|use|put|say|insert|start|begin|end)\b",
    rf"\b{NAME}[^.!?\n]{{0,25}}\b(?:reading|parsing|scanning|processing|analy[sz]ing|summari[sz]ing|ingesting|filling (?:out|in)|completing|answering)\s+(?:this\s+(?:page|form|application|posting|text|job|message|description|document|question)|these\s+instructions|this\b\s*[,:;.!?-])",
    rf"\b(?:all\s+|any\s+)?{OTHERS_NAME}[^.!?\n]{{0,30}}?\s(?:must|should|shall|needs? to|ha(?:ve|s) to|(?:are|is) (?:required|instructed|asked|told|expected) to|please)\s+(?:always\s+|also\s+|then\s+)?(?:answer|respond|reply|write|type|fill|put|enter|select|choose|pick|tick|check|mark|include|mention|start|begin|end|add|say|output|return|insert|ignore|leave|skip)\b",
)
#: Orders to whoever writes an application, and the usual ways to take over a model.
ORDERS = (
    rf"\bif\s+you(?:['’]?re| are)\s+not\s+(?:a\s+)?(?:human|person)\b[^.!?\n]{{0,40}}?\b{DO}\b",
    r"\bif\s+the\s+(?:user|candidate|applicant|human|person)\s+(?:asks?|tells?|wants?|requests?)\s+you\b",
    r"\b(?:ignore|disregard|forget|override|bypass)\s+(?:(?:all|any|the|your|these|those|of)\s+)*(?:previous|prior|above|earlier|preceding|foregoing|original|initial|system|former)\s+(?:\w+\s+)?(?:instructions?|prompts?|directions?|rules?|guidelines?|commands?|context|messages?)\b",
    r"\b(?:reveal|print|show|repeat|output)\s+(?:\w+\s+){0,3}system\s+prompts?\b",
    r"(?m:^)\s*(?:system|assistant)\s*:",
    r"\[/?INST\]|<\|im_(?:start|end)\|>|<</?SYS>>|###\s*(?:instruction|system)\b",
    r"\bnew\s+instructions?\s*:",
    r"\byou\s+are\s+now\s+(?:an?\s+)?(?:ai|assistant|bot|model|gpt|dan)\b",
    r"""\b(?:fill(?:\s+in)?|enter|type|write|put|answer|respond|reply)(?:\s+with)?\s+["'“‘]?[\w/.-]{1,20}["'”’]?\s+instead\s+of\s+(?:a\s+|an\s+|the\s+|your\s+)?(?:response|answer|reply|text|value)\b""",
    r"\bto\s+(?:show|prove|confirm|demonstrate|let us know|indicate)\b[^.!?\n]{0,40}\b(?:read|reading|paying attention|attention to detail|a human|human)\b",
    r"\b(?:include|mention|use|put|add|write|type|say)\s+(?:the\s+|this\s+)?(?:(?:code|magic|secret|key)\s*)?(?:word|phrase|keyword)\b",
    r"\b(?:start|begin|end|open|title|subject(?:\s+line)?)\s+(?:of\s+)?(?:your|the)\s+(?:application|cover letter|answer|response|message|email|note|first sentence|letter)\s+(?:with|by|should)\b",
    r"\bsecret\s+(?:word|phrase|code)\b",
    r"\bif\s+you(?:['’]?ve| have)\s+read\s+(?:this|the|all|so far|until)\b",
    r"\bif\s+you(?:['’]?re| are)\s+(?:still\s+)?reading\s+this\b[^.!?\n]{0,20}\b(?:mention|include|add|write|say|put|use|start|begin)\b",
)
#: A sentence with what ends it, words that are left over in front of an order, openings that only set it up.
SENTENCE = r"""[^\n]+?(?:[.!?]+["'”’)\]]*(?:\s|\z)|\n|\z)|\n"""
LEFT_OVER = r"(?i)[\s,;:(\[{–—-]*(?:\b(?:and|but|or|also|however|note|please|note that|then)\b[\s,:;–—-]*)*\z"
LEAD_IN = "(?i)^(?:if|when|to help|to show|in order to)\\b"


#: Marks around what tells whether a match counts.
_OPEN, _CLOSE = "\uFFFE", "\uFFFF"


def spoken_at(read, pattern: str):
    """The place, from 1, of the first match of ``pattern`` whose tool's name is no one's work; null where there is none.

    Matches are found one after the other, and each is judged by what stands around the name that it took: a group
    behind the name is empty if it is someone's work (or, where the pattern says so, someone's own tool), else it is
    all the rest of the sentence. All matches are marked with that group, and the first mark that holds something counts.
    """
    role = rf"{TOOL}\b(?=((?={ROLE})|[\s\S]+))"
    own = rf"(?={TOOL}\b)(?=((?<={OWN})|[\s\S]+)){TOOL}\b(?=((?={ROLE})|(?=\1)|[\s\S]+))"  # whose it is matters only where a name is
    group = 2 if OTHERS_NAME in pattern else 1
    marked = F.regexp_replace(read, "(?i)" + pattern.replace(OTHERS_NAME, own).replace(NAME, role), f"{_OPEN}${group}{_CLOSE}$0")
    first = F.regexp_instr(marked, F.lit(f"{_OPEN}[^{_CLOSE}]"))
    return F.when(first > 0, F.length(F.regexp_replace(F.left(marked, first - 1), f"{_OPEN}[^{_CLOSE}]*{_CLOSE}", "")) + 1)


_UNSEEN = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), INVISIBLE))


@F.pandas_udf(T.StringType())
def _legible(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _UNSEEN.sub("", unicodedata.normalize("NFKC", t)) for t in texts], dtype=object)


def legible(text):
    """``text`` in the Unicode form NFKC, without characters that show nothing; only texts beyond ASCII leave the JVM."""
    wide = text.rlike(r"[^\x00-\x7F]")
    return F.when(wide, _legible(F.when(wide, text))).otherwise(text)


_BOUND, _FREE = [p[2:] for p in ORDERS if p.startswith(r"\b")], [p for p in ORDERS if not p.startswith(r"\b")]
#: What a sentence that is aimed at machines cannot do without: a tool's name or an order. Tried at once, where words begin.
SIGN = rf"(?i)\b(?:{TOOL}|{'|'.join(_BOUND)})|{'|'.join(_FREE)}"


#: The same for whole lines at once, in the linear patterns of Arrow: what every line with a sign holds, up to where a rule looks
#: further on. Letters of other alphabets that read like Latin ones may spell any sign.
LINE_SIGN = "|".join([rf"\b(?:{TOOL}|{'|'.join(p.split(r'[^.!?')[0] for p in _BOUND)})", *(p.removeprefix(r"(?m:^)\s*") for p in _FREE), f"[{LOOKALIKES[0]}{_OPEN}{_CLOSE}]"]).replace(r"\s", r"[\s\x0B]")


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def _signed(lines: pa.Array) -> pa.Array:
    """Of every text's lines, whether they may hold a sign."""
    found = pc.match_substring_regex(lines.flatten(), LINE_SIGN, ignore_case=True)
    return pa.ListArray.from_arrays(pc.subtract(lines.offsets, lines.offsets[0]), found)


def aimed_at(sentence):
    """The place, from 1, where the words aimed at machines begin; null where there are none."""
    places = lambda read: F.array(*[spoken_at(read, p) for p in SPOKEN], *[F.regexp_instr(read, F.lit(f"(?i){p}")) for p in ORDERS])
    plain = F.when(sentence.rlike(r"[^\x00-\x7F]"), F.translate(sentence, LOOKALIKES[0] + _OPEN + _CLOSE, LOOKALIKES[1])).otherwise(sentence)
    return once(plain, lambda read: F.when(read.rlike(SIGN), F.array_min(F.filter(places(read), lambda at: at > 0))))


def _shown(sentence):
    """What stays of a sentence: all of it, or what it says before the words aimed at machines if that is three words or more."""

    def kept(at):
        before = trimmed(F.regexp_replace(F.left(sentence, at - 1), LEFT_OVER, ""))
        says = (F.size(F.array_remove(F.split(before, r"\s+", -1), "")) >= 3) & ~before.rlike(LEAD_IN)
        end = F.concat(F.when(before.rlike(r"[.?!]\z"), "").otherwise("."), F.when(sentence.endswith("\n"), "\n").otherwise(" "))
        return F.when(at.isNull(), sentence).when(says, F.concat(before, end)).otherwise("")

    return once(aimed_at(sentence), kept)


def scrubbed(text):
    """Untrusted page text as a person reads it: without invisible characters and without what is aimed at machines.

    The sentence around an order stays as far as it says something before it. Every prompt built from a posting takes
    its text from here. Null stays null.
    """
    plain = legible(text)
    lines = lambda s: F.split(s, r"(?<=\n)", -1)  # noqa: E731  no sentence goes beyond its line
    sentences = lambda line: F.array_join(F.transform(F.regexp_extract_all(line, F.lit(SENTENCE), F.lit(0)), _shown), "")
    signed = _signed(lines(F.coalesce(plain, F.lit(""))))
    parts = F.transform(F.arrays_zip(lines(plain).alias("line"), signed.alias("signed")), lambda x: F.when(x["signed"], sentences(x["line"])).otherwise(x["line"]))
    return trimmed(F.regexp_replace(F.array_join(F.when(text.isNotNull(), parts), ""), r"\n{3,}", "\n\n"))
