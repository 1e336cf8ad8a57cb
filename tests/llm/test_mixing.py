import random
from collections import defaultdict

from pyspark.sql import functions as F

from gleaner.llm.mixing import mix_sizes, mixed_documents

SCHEMA = "doc_id long, text string, source string, target int"


def plain_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    left = float(total)
    while left > 1e-9 and free:
        share = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / share
        left = 0.0
        for s in list(free):
            if target[s] >= repeats * sizes[s]:
                left += target[s] - repeats * sizes[s]
                target[s] = repeats * sizes[s]
                free.discard(s)
    return target


def documents(seed=6, n=400):
    rnd = random.Random(seed)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 30, 200])), rnd.choice(["a"] * 8 + ["b", "c", "é", None, "big"]), 1) for i in range(n)]
    return rows + [(900, "x " * 20000, "big", 1), (901, None, "a", 1), (902, "", "void", 1), (903, "one\ttwo\n three", "tiny", 1), (5, "same row", "a", 1), (5, "same row", "a", 1), (None, "no id", None, 1)]


def test_targets_and_takes(spark):
    rows = documents()
    got = mix_sizes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(3, 0.02 * t), (s, taken[s], t)
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r[0] or -1, len((r[1] or "").split())) for r in rows)


def test_reruns_agree_over_other_partitions(spark):
    docs = spark.createDataFrame(documents(7), SCHEMA)
    first, second = (sorted(map(str, mix_sizes(d).collect())) for d in (docs, docs.repartition(7, F.rand(1))))
    assert first == second


def test_empty(spark):
    assert mix_sizes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.taken for r in mix_sizes(spark.createDataFrame([(1, None, None, 1)], SCHEMA)).collect()] == [0]


def test_documents_hold_the_words_taken(spark):
    rnd = random.Random(8)
    rows = [(i, "  ".join(f"w{j}" for j in range(rnd.choice([0, 3, 50, 300]))), rnd.choice("aaaaab"), 1) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"n_chars": F.length("text"), "row": F.lit("a"), "size": F.lit("b")})
    taken = {r.doc_id: r.taken for r in mix_sizes(docs).collect()}
    mixed, words = mixed_documents(docs), defaultdict(int)
    assert mixed.columns == docs.columns
    originals = {r[0]: r[1] for r in rows}
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.text in originals[r.doc_id] and r.n_chars == len(r.text)
    assert {k: v for k, v in taken.items() if v} == dict(words)
