import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.llm.spelling import near_pairs, roots, spelling_groups

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def variants(word):
    """All strings one edit from ``word``."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    found = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in LETTERS} | {a + c + b for a, b in cuts for c in LETTERS}
    return found - {word}


def plain_counts(rows, every):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain(rows, every=31):
    words = plain_counts(rows, every)
    near = {w: sorted(variants(w) & words.keys(), key=lambda v: (-words[v], v.encode())) for w in words}
    form = {w: near[w][0] if near[w] and words[near[w][0]] >= 10 * n else None for w, n in words.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=lambda r: r[0].encode())


def edited(rnd, word):
    i = rnd.randrange(len(word))
    return rnd.choice([word[:i] + word[i + 1 :], word[:i] + rnd.choice("aeéÿ÷") + word[i + 1 :], word[:i] + rnd.choice("aeé") + word[i:]])


def documents(seed=2):
    rnd = random.Random(seed)
    base = ["".join(rnd.choices("abcéd", k=rnd.randrange(7, 15))) for _ in range(60)] + ["shared" + "".join(rnd.choices("abc", k=rnd.randrange(2, 7))) for _ in range(120)]
    pool = [(w, 3 ** rnd.randrange(0, 6)) for w in base]
    pool += [(edited(rnd, w), rnd.choice([1, 2, 5])) for w in base for _ in range(3)]
    pool += [(edited(rnd, edited(rnd, w)), 1) for w in base]
    drawn = rnd.choices([w for w, _ in pool], [n for _, n in pool], k=12000)
    rows = [(i, rnd.choice([" ", "-", "_1 "]).join(w.upper() if rnd.random() < 0.1 and w.isascii() else w for w in drawn[20 * i : 20 * i + 20]), "x", "y") for i in range(600)]
    rows += [(700, None, "x", "y"), (701, "", "x", "y"), (702, "a" * 100_000, "x", "y"), (703, "K" + "elvinwo ſharedaá", "x", "y"), (None, rows[3][1], "x", "y"), (5, rows[5][1], "x", "y"), (5, rows[5][1], "x", "y")]
    return rows


SCHEMA = "doc_id long, text string, word string, n string"


@pytest.mark.parametrize("crowded", [512, 3, 0])
def test_against_plain_version(spark, crowded):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in spelling_groups(docs, every=31, crowded=crowded).collect()), key=lambda r: r[0].encode())
    want = plain(rows)
    assert got == want
    assert sum(r[1] is not None for r in want) > 50 and any(r[1] and r[1] != r[2] for r in want)


def test_texts_as_they_are(spark):
    rows = [(1, "Receive receive receive receive receive receive receive receive receive receive", "", ""), (2, "recieve recieves receives receivé, RECEIVE", "", ""), (3, "receivé receives", "", "")]
    got = {r.word: (r.form, r.n, r.n_near) for r in spelling_groups(spark.createDataFrame(rows, SCHEMA), least_count=1).collect()}
    assert got == {"receive": (None, 11, 2), "recieve": (None, 1, 1), "recieves": (None, 1, 1), "receives": (None, 2, 1), "receivé": (None, 2, 1)}


def test_a_crowded_segment_is_split_on_without_loss(spark):
    words = [f"prefixed{a}{b}{c}{d}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh" for d in "ab"] + [f"prefixed{a}a{b}aa" for a in "abcdefgh" for b in "ab"]
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    split = {(r.word, r.other) for r in near_pairs(table, 4).collect()}
    known = set(words)
    want = {tuple(sorted((w, v), key=lambda x: (len(x), x))) for w in words for v in variants(w) & known}
    assert split == want == {(r.word, r.other) for r in near_pairs(table).collect()}


def test_roots_of_long_chains(spark):
    chain = spark.range(17).select(F.concat(F.lit("w"), "id").alias("word"), F.concat(F.lit("w"), F.col("id") + 1).alias("form"))
    assert {r.root for r in roots(chain).collect()} == {"w17"}


def test_empty(spark):
    assert spelling_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling_groups(spark.createDataFrame([(1, None, "a", "b"), (2, "short words", "a", "b")], SCHEMA)).count() == 0
