import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm.fill_in_middle import UNITS, count_chunks, fill_in_middle, place, restored

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def plain(doc_id, text, seed=1):
    text = text or ""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def documents():
    rnd = random.Random(13)
    texts = ["".join(rnd.choices("ab é😀\n\t<>PSM", k=rnd.randrange(0, 60))) for _ in range(300)]
    texts += [None, "", "x", "😀", "a<P>b", "<S>", "<M", "<P", "\x00\n", "é" * 200_000, "😀a" * 70_001, "word " * 50_000]
    return [(i, t, "keep", 1.5) for i, t in enumerate(texts)] + [(3, texts[3], "keep", 1.5), (None, "no id, some text", "keep", 1.5)]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_against_plain_slices(spark, chunk):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, `other.one` string, form double")
    out = fill_in_middle(docs, chunk=chunk)
    assert out.columns == ["doc_id", "other.one", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = sorted([(r[0] is None, r[0] or 0, str(plain(*r[:2])), r[1] or "") for r in documents()])
    assert sorted((r.doc_id is None, r.doc_id or 0, str((r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.back) for r in rows) == want
    assert {r.form for r in rows} == {"plain", "psm", "spm"} and all(r["other.one"] == "keep" for r in rows)


def test_units_cut_where_words_and_lines_start():
    rnd = random.Random(5)
    for _ in range(200):
        text = "".join(rnd.choices("aé \n\t", k=rnd.randrange(1, 40)))
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        words = [len(text[: m.start()].encode()) for m in re.finditer(rf"[^{SPACES}]+", text)]
        lines = [len(text[:i].encode()) for i in range(len(text)) if i == 0 or text[i - 1] == "\n"]
        for unit, at in (("word", words), ("line", lines)):
            for chunk in (1, 3, 64):
                before = count_chunks(raw, UNITS[unit], chunk)
                assert before[-1] == len(at)
                assert [place(raw, before, r, UNITS[unit], chunk) for r in range(len(at) + 1)] == ([0, *at[1:], len(raw)] if at else [0])


def test_words_and_shares(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("  one two\nthree é four ").alias("text"))
    rows = fill_in_middle(docs, unit="word", plain=50, suffix_first=100).collect()
    assert {r.form for r in rows} == {"plain", "spm"} and abs(sum(r.form == "plain" for r in rows) - 1500) < 150
    for r in rows:
        assert r.n == 5
        if r.form == "spm":
            s, p, m = re.fullmatch(r"(?s)<S>(.*)<P>(.*)<M>(.*)", r.output).groups()
            assert p + m + s == "  one two\nthree é four " and (len(p), len(m)) == (r.prefix_chars, r.middle_chars)
            assert all(not x or not before or x[0] not in SPACES for x, before in ((m, p), (s, p + m)))


def test_reruns_and_empty_tables(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, a string, b double")
    first, second = (sorted(map(str, fill_in_middle(d).collect())) for d in (docs, docs.repartition(5, F.rand(2))))
    assert first == second
    assert fill_in_middle(docs.limit(0)).count() == 0
