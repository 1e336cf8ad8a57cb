import random
import zlib

import numpy as np

from gleaner.llm.quality_classifier import STATISTICS, fit, quality_scores, statistics

SCHEMA = "doc_id long, text string, score string"


def texts(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randrange(2, 9)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rnd.randrange(5, 120))]
        good = rnd.random() < 0.7
        if not good:
            words = rnd.choice([[w + "***" for w in words], [w.upper() + "!!" for w in words], [w for w in words[:6] for _ in range(9)]])
        out.append((i, " ".join(words), good))
    return out


def test_held_out_accuracy(spark):
    rows = texts(1, 1500)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], SCHEMA)
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    # labels of held-out rows are wrong here: they must not matter
    labels = spark.createDataFrame([(i, int(g != (i in held)), 0) for i, _, g in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert {i for i, r in got.items() if r.held_out} == held
    right = sum(got[i].predicted == g for i, _, g in rows if i in held)
    assert right >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_model_is_the_discriminant(spark):
    rng = np.random.default_rng(2)
    d = len(STATISTICS)
    x = np.concatenate((rng.standard_normal((300, d)) @ rng.standard_normal((d, d)), rng.standard_normal((200, d)) + 2))
    y = np.repeat([0, 1], [300, 200])
    model = fit(spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in zip(y, x, strict=True)], "label int, statistics array<double>"))
    z = (x - x.mean(0)) / x.std(0)
    spreads = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    shared, logs = 0.6 * spreads[0] + 0.4 * spreads[1], []
    for k in (0, 1):
        s = 0.9 * spreads[k] + 0.1 * shared
        s = 0.98 * s + 0.02 * np.trace(s) / d * np.eye(d)
        u = z - z[y == k].mean(0)
        logs.append(np.log((0.6, 0.4)[k]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (u @ np.linalg.inv(s) * u).sum(1))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), atol=1e-8)


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "no id", "x"), (3, "a " * 60000, "x"), (3, "same id", "x"), (4, "é" * 50000, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality_scores(docs, labels).collect()] == [0.5] * 6
    one = spark.createDataFrame([(3, 1), (3, 1), (4, None), (1, 7)], "doc_id long, quality int")
    assert {r.score for r in quality_scores(docs, one).collect()} == {1.0}
    both = spark.createDataFrame([(3, 1), (4, 0), (2, 0), (2, 1), (2, 1), (1, 0)], "doc_id long, quality int")
    got = quality_scores(docs, both).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert quality_scores(docs.limit(0), labels).count() == 0
    assert all(np.isfinite(statistics(t)).all() for t in (None, "", " ", "x", "a b", "\n\n", "😀" * 10))
