import math
import random
import re

import pytest

from gleaner.llm.quality_rules import ALIKE, FLOOR, INNER, MEASURES, OUTER, TIMES, measured, quality_rules, thresholds


def plain_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 8))
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def cases():
    rnd = random.Random(4)
    some = lambda n, k=400: " ".join("w" + str(rnd.randrange(k)) + "é" * rnd.randrange(3) for _ in range(n))
    texts = [None, "", " \n\t ", "one", some(19), some(20), some(60, 3), some(60, 2), "a b c d e f g h " * 2, "a b c d e f g h " * 5, "x " * 30]
    texts += ["line one\nline two\nline one\n\n\nline one\r\nline two", "#*$%&|<> ### word", "😀 smile " * 40, some(4000), " ".join(f"q{i}" for i in range(20000))]
    once = some(40)
    texts += [f"{once} {some(50)} {once}", f"{once} {some(400)} {once}\n{once}"]
    return texts


def test_counts_match_brute_force(spark):
    texts = cases()
    rows = [(i, t, None if i % 5 == 0 else "en", "hot" if i % 3 else None, -1) for i, t in enumerate(texts)] + [(3, "one", "en", "hot", -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(docs).collect())
    assert got == sorted((r[0], *plain_counts(r[1])) for r in rows)
    assert quality_rules(docs.limit(0)).count() == 0


def plain_measures(text):
    """The measures of a text and whether it fails the base rules, in plain Python."""
    n, chars, symbols, dup_lines, repeated, failed = plain_counts(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = {"n_symbols": symbols, "word_chars": chars, "n_dup_lines": dup_lines, "_n_lines": len(lines), "n_repeat_words": repeated, "n_words": n}
    count |= {"_stutters": sum(a == b for a, b in zip(words, words[1:], strict=False)), "_upper": len(re.findall("[A-Z]", text or ""))}
    return {m: round(math.log((count[part] + a) / (count[whole] + b)), 6) for m, (part, whole, a, b, _) in MEASURES.items()}, failed


def plain_bounds(group):
    """(measure, low, high) of a group of measures by exact quantiles."""
    out = []
    for m, (*_, both) in MEASURES.items():
        values = sorted({tuple(round(x[k], ALIKE) for k in MEASURES): x[m] for x in sorted(group, key=lambda x: -x[m])}.values())
        at = lambda q: values[max(0, math.ceil(q * len(values) - 1e-9) - 1)]  # noqa: E731, B023
        high = at(OUTER) + TIMES * ((at(OUTER) - at(INNER)) or FLOOR)
        low = at(1 - OUTER) - TIMES * ((at(1 - INNER) - at(1 - OUTER)) or FLOOR) if both else -math.inf
        out.append((m, low, high))
    return out


def texts_of(rnd, n, odd):
    """Texts of made words, some with many symbols, capitals, repeated words or lines, long or short words."""
    out = []
    for _ in range(n):
        size = lambda: rnd.randrange(3, 8)
        kind = rnd.random()
        long = 9 if kind < odd / 3 else -2 if kind < odd / 2 else 0
        words = ["".join(rnd.choices("abcdefghijk", k=max(1, size() + long))) for _ in range(rnd.randrange(25, 160))]
        words = [w + rnd.choice("*#|") * (rnd.random() < (0.5 if kind > 1 - odd else 0.01)) for w in words]
        words = [w.upper() if rnd.random() < (0.6 if 0.4 < kind < 0.4 + odd / 2 else 0.03) else w for w in words]
        words = [w for w in words for _ in range(1 + (rnd.random() < (0.8 if 0.6 < kind < 0.6 + odd / 2 else 0.01)))]
        text = "".join(w + rnd.choice([" ", " ", " ", "\n"]) for w in words)
        out.append(text + "\n" + "\n".join(["menu home"] * rnd.randrange(9)) if rnd.random() < 0.1 else text)
    return out


def test_kept_matches_exact_quantiles(spark):
    """Sketches that hold all values are exact, so every verdict follows from the sorted measures of its group."""
    rnd = random.Random(6)
    rows, groups = [], {("en", "a"): 260, ("en", "b"): 250, ("de", "a"): 90, ("de", None): 150, (None, "c"): 30, ("fr", "rare"): 3}
    for (lang, source), n in groups.items():
        rows += [(len(rows) + i, t, lang, source) for i, t in enumerate(texts_of(rnd, n, 0.1 if source == "a" else 0.25))]
    rows += [(5000 + i, rows[0][1], "en", "a") for i in range(400)]  # copies set no thresholds
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    plain = {r[0]: plain_measures(r[1]) for r in rows}
    for i, (measures, failed) in plain.items():
        assert failed == got[i].base_failed
        assert all(measures[m] == pytest.approx(got[i][m], abs=2e-6) for m in MEASURES)
    members = lambda keep: [plain[r[0]][0] for r in rows if not plain[r[0]][1] and keep(r)]
    distinct = lambda group: len({tuple(round(x[k], ALIKE) for k in MEASURES) for x in group})
    refused = 0
    for i, _, lang, source in rows:
        choices = (lambda r: r[2:] == (lang, source), lambda r: r[2] == lang, lambda r: True)  # noqa: B023
        group = next((g for g in map(members, choices) if distinct(g) >= 200), members(choices[-1]))
        measures, failed = plain[i]
        gaps = [min(measures[m] - low, high - measures[m]) for m, low, high in plain_bounds(group)]
        if failed or min(map(abs, gaps)) > 1e-5:
            assert got[i].kept == (not failed and min(gaps) >= 0)
            refused += not failed and min(gaps) < 0
    assert 20 < refused < len(rows) / 3


def test_spread_decides_where_medians_are_equal(spark):
    """Two sources with the same median of symbols: the one that spreads more keeps what the other refuses."""
    rnd = random.Random(7)
    rows = []
    for i in range(800):
        source = "wide" if i % 2 else "tight"
        share = rnd.uniform(0.0, 0.2) if source == "wide" else rnd.uniform(0.09, 0.11)
        n = rnd.randrange(150, 250)
        words = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(3, 8))) for _ in range(n)]
        words[:2] = [w.upper() for w in words[:2]] if i % 3 else words[:2]
        for at in rnd.sample(range(2, n), round(n * share)):
            words[at] += "#"
        rows.append((i, " ".join(words), "en", source))
    probe = " ".join(["".join(rnd.choices("abcdefghij", k=5)) + "#" * (k % 4 == 0) for k in range(200)])
    rows += [(1000, probe, "en", "wide"), (1001, probe, "en", "tight")]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    middle = {s: sorted(r.symbol_rate for r in got.values() if r.source == s)[200] for s in ("wide", "tight")}
    assert abs(middle["wide"] - middle["tight"]) < 0.1
    assert got[1000].kept and not got[1001].kept and got[1001].reasons == ["high symbol_rate"]


def test_floor_stands_only_where_nothing_spreads(spark):
    words = "abcd efgh ijkl mnop qrst uvwx yzab cdef ghij klmn opqr stuv wxyz abce fghj klmo pqru vwxa bceg hjlm oqsu"
    rows = [(i, words, "en", "same") for i in range(30)] + [(100, words + " ####", "en", "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert thresholds(measured(docs, ["lang", "source"]), "lang", "source", 1).first().floors > 0
    assert {r.doc_id: r.kept for r in quality_rules(docs, least_rows=1).collect()}[0]
    rnd = random.Random(8)
    varied = [(i, t, "en", "s") for i, t in enumerate(texts_of(rnd, 300, 0.1))]
    varied = spark.createDataFrame(varied, "doc_id long, text string, lang string, source string")
    assert thresholds(measured(varied, ["lang", "source"]), "lang", "source").first().floors == 0


def test_thresholds_follow_the_group(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        lang = "de" if i % 2 else "en"
        words = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(12, 16) if lang == "de" else rnd.randrange(3, 7))) for _ in range(60)]
        rows.append((i, " ".join(words), lang, f"s{i % 3}"))
    long_english = " ".join("".join(rnd.choices("abcdefghij", k=14)) for _ in range(60))
    rows += [(1000, long_english, "en", "s0"), (1001, long_english, "de", "s0"), (1002, long_english.replace(" ", "### "), "de", "s0"), (1003, long_english, "fr", "rare")]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), least_rows=50).collect()}
    assert [got[i].kept for i in (1000, 1001, 1002, 1003)] == [False, True, False, True]
    assert got[1000].reasons == ["high word_length"] and "high symbol_rate" in got[1002].reasons
    assert sum(got[i].kept for i in range(600)) > 590
