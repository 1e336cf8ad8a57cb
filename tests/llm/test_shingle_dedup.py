import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import shingle_dedup
from gleaner.llm.shingle_dedup import bucket_links, common_counts, one_of_each_shingle_group

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def plain(rows):
    """The rows that stay, by all pairs."""
    sets, roots = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and roots[i] != roots[j]:
                a, b = roots[i], roots[j]
                roots = [min(a, b) if x in (a, b) else x for x in roots]
    least = {}
    for r, root in zip(rows, roots, strict=True):
        least[root] = min(least.get(root, (True, 0)), (r[0] is None, r[0] or 0))
    return sorted(least.values())


def stage(spark, rows):
    return corpus_pipeline.keep_one_copy(spark, spark.createDataFrame(rows, SCHEMA), "").collect()


def test_planted_near_copies_go(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(150):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 200))]
        rows.append((10 * i, " ".join(words), "en", "a", 0))
        for k in range(rnd.randrange(3)):  # near copies on either side of 0.8, chains among them
            for _ in range(rnd.randrange(1, 4)):
                words[rnd.randrange(len(words))] = "changed"
            rows.append((10 * i + k + 1, " ".join(words).upper(), "en", "a", 0))
    got = stage(spark, rows)
    want = plain(rows)
    assert sorted((False, r.doc_id) for r in got) == want and 150 <= len(want) < len(rows) - 60


def test_every_group_keeps_one(spark):
    a, b, c = ("one two three four five six seven", "other words that stand quite alone here", "no id has this text of its own")
    rows = [(7, a, "en", "a", 0), (7, b, "en", "a", 0), (7, a, "en", "a", 0), (3, b, "en", "a", 0), (None, c, "en", "a", 0), (None, c, None, "a", 0), (9, None, "en", "a", 0), (8, "", "en", "a", 0)]
    got = stage(spark, rows)
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, c), (3, b), (7, a), (8, "")]
    assert stage(spark, []) == []


def test_common_counts(monkeypatch):
    monkeypatch.setattr(shingle_dedup, "WIDTH", 16)
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(-50, 50, n)) for n in (1, 5, 40, 90, 3)]
    assert common_counts(sets, sets[:3]).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets[:3]] for x in sets]


def test_blocks_of_a_bucket_lose_no_link(spark, monkeypatch):
    """One bucket in four blocks and others in one: the links connect what all pairs connect, with no row for a pair."""
    monkeypatch.setattr(shingle_dedup, "SIDE", 16)
    rnd = random.Random(9)
    sets = {}
    for i in range(300):
        base = list(range(20 * (i % 12), 20 * (i % 12) + 30))
        for _ in range(rnd.randrange(6)):
            base[rnd.randrange(30)] = rnd.randrange(1000, 1200)
        sets[i] = sorted(set(base))
    rows = [(7, i, i if i % 5 else i - i % 10, 4, sets[i]) for i in sets] + [(8 + i % 40, i, i, 1, sets[i]) for i in range(200)]
    got = bucket_links(spark.createDataFrame(rows, "key long, class long, root long, blocks int, shingles array<long>").repartition(3)).collect()
    roots = {i: i if i % 5 else i - i % 10 for i in sets}

    def joined(pairs, roots):
        roots = dict(roots)
        for a, b in pairs:
            x, y = roots[a], roots[b]
            roots = {k: min(x, y) if v in (x, y) else v for k, v in roots.items()}
        return roots

    near = [(a, b) for a in sets for b in range(a) if 9 * len(set(sets[a]) & set(sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))]
    assert len(got) < 0.5 * len(near)
    assert joined([(r.a, r.b) for r in got], roots) == joined(near, roots)


def test_odd_columns_come_back(spark):
    rows = [(1, "one two three four five six", "en", 3), (2, "One two three four five six", "en", 4), (None, "other", "de", 5), (4, "", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _h int")
    docs = docs.withColumns({"_g": F.lit("g"), "name": F.lit("n"), "a.b": F.lit(1.5), "class": F.lit(True), "fp": F.struct(F.lit(1).alias("x y"))})
    got = one_of_each_shingle_group(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id != 2)
    assert one_of_each_shingle_group(docs.limit(0)).count() == 0
