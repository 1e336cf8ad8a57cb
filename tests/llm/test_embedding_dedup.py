import duckdb
import numpy as np
import pyarrow as pa

from gleaner.llm import embedding_dedup
from gleaner.llm.embedding_dedup import embedding_groups, passes_for
from gleaner.llm.registry import EMBEDDING_SQL

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string"


def plain(rows):
    """(n_links, component_id) of each row, by all pairs."""
    good = [r[1] is not None and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    x = [np.array(r[1], np.float32).astype(np.float64) if g else None for r, g in zip(rows, good, strict=True)]
    near = lambda i, j: good[i] and good[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt(x[i] @ x[i]) / np.sqrt(x[j] @ x[j]) >= 0.93
    links = [[j for j in range(len(rows)) if j != i and near(i, j)] for i in range(len(rows))]
    names = [r[0] for r in rows]
    for _ in range(len(rows)):
        new = [min([n, *(names[j] for j in js)]) for n, js in zip(names, links, strict=True)]
        if new == names:
            break
        names = new
    return [(len(js), n) for js, n in zip(links, names, strict=True)]


def clustered(seed, sizes, noise, dim=32):
    rng = np.random.default_rng(seed)
    out = []
    for size in sizes:
        centre = rng.standard_normal(dim)
        for _ in range(size):
            v = centre + noise * rng.standard_normal(dim)
            out.append([float(a) for a in (v * rng.uniform(0.1, 9)).astype(np.float32)])
    return out


def check(spark, rows, **options):
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_groups(spark.createDataFrame(rows, SCHEMA), **options).collect())
    want = sorted((r[0], n, c, r[0] == c) for r, (n, c) in zip(rows, plain(rows), strict=True))
    return got, want


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]
    rows = [(9, a, 1, "x"), (4, a, 1, "x"), (5, b, 1, "x"), (6, a, 2, "x"), (7, a, None, "x"), (8, None, 1, "x"), (10, [0.0] * 3, 1, "x"), (11, [1.0, None, 3.0], 1, "x")]
    rows += [(12, [nan, 1.0, 1.0], 1, "x"), (13, [inf, 1.0, 1.0], 1, "x"), (14, [1.0, 2.0], 1, "x"), (15, [], 1, "x"), (16, [3e38, 3e38, 3e38], 3, "x"), (17, [1.0, 1.0, 1.0], 3, "x"), (4, a, 1, "x"), (18, [-0.0, 1.0, 0.0], 4, None), (19, [0.0, 1.0, 0.0], 4, None)]
    got, want = check(spark, rows)
    assert got == want
    assert embedding_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dense_groups_count_every_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SMALL_BLOCK", 16)  # several blocks for each component
    vectors = clustered(1, [150, 40, 3, 2, *[1] * 80], 0.2)
    rows = [(i * 7 % 1009, v, 0 if i % 11 else 1, "x") for i, v in enumerate(vectors)]
    got, want = check(spark, rows, window=8)
    assert got == want and max(n for _, n, _, _ in got) > 100


def test_recall_of_lone_pairs(spark):
    vectors = clustered(2, [2] * 400 + [1] * 1200, 0.17)
    rows = [(i, v, 0, "x") for i, v in enumerate(vectors)]
    got, want = check(spark, rows)
    found, real = sum(n for _, n, _, _ in got), sum(n for _, n, _, _ in want)
    assert real > 500 and 0.97 * real <= found <= real
    assert passes_for(100) < passes_for(10**6) < passes_for(10**9)


def recall(spark, base, n_pairs, seed):
    """Share of planted lone pairs at a cosine of 0.931 to 0.95 that are found among the unit vectors ``base`` of one label."""
    rng = np.random.default_rng(seed)
    own = rng.choice(len(base), n_pairs, replace=False)
    aside = rng.standard_normal((n_pairs, base.shape[1]))
    aside -= (aside * base[own]).sum(1, keepdims=True) * base[own]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.95, (n_pairs, 1))
    partners = cosine * base[own] + np.sqrt(1 - cosine**2) * aside
    table = pa.table({"vec_id": np.arange(len(base) + n_pairs), "embedding": list(np.vstack([base, partners]).astype(np.float32)), "label": np.zeros(len(base) + n_pairs, np.int32)})
    got = embedding_groups(spark.createDataFrame(table)).where("n_links > 0").collect()
    found = {r.vec_id: r.component_id for r in got}
    return np.mean([found.get(len(base) + k) == found.get(int(i), -1) for k, i in enumerate(own)]), len(got)


def test_recall_in_a_large_label(spark):
    base = np.random.default_rng(3).standard_normal((100_000, 32))
    share, linked = recall(spark, base / np.linalg.norm(base, axis=1, keepdims=True), 1000, 4)
    assert share >= 0.98 and linked < 2100


def test_recall_of_vectors_with_a_common_direction(spark):
    """Crowded hashes: the first passes find about four fifths of the pairs, further rounds the rest."""
    base = np.random.default_rng(5).standard_normal((20_000, 64))
    base[:, 0] = 0
    base = np.sqrt(0.2) * base / np.linalg.norm(base, axis=1, keepdims=True)
    base[:, 0] = np.sqrt(0.8)
    share, linked = recall(spark, base, 300, 6)
    assert share >= 0.97 and linked < 640


def test_links_against_the_sql(spark):
    """The registered SQL on vectors that do link."""
    vectors = clustered(7, [40, 12, 5, 3, 2, 2, *[1] * 60], 0.25)
    rows = [(i * 7 % 1009, v, i % 3 if i % 17 else None) for i, v in enumerate(vectors)] + [(2000, None, 1), (2001, [0.0] * 32, 1), (2002, vectors[0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    embeddings = frame.toArrow()
    want = duckdb.connect().register("embeddings", embeddings).sql(EMBEDDING_SQL).fetchall()
    got = embedding_groups(frame).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r[1] > 0 for r in want) > 40
