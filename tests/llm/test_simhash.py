import numpy as np
import xxhash
from pyspark.sql import functions as F

from gleaner.llm.components import connected_components
from gleaner.llm.simhash import fingerprint, fingerprint_links, simhash_groups, tree_links


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(names):
    """Smallest index reachable over at most 4 differing bits."""
    roots = list(range(len(names)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(names)):
        for j in range(i):
            if (names[i] ^ names[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                roots[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(names))]


def near(rng, n, clusters):
    """Fingerprints around a few centres, so that links form chains and dense groups."""
    centres = rng.integers(0, 1 << 63, clusters, dtype=np.uint64)
    out = centres[rng.integers(0, clusters, n)]
    for _ in range(4):
        out = out ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64), np.uint64(0))
    return np.unique(out)


def test_fingerprint():
    for text in (None, "", " \t\n", "One", "one TWO three", "a b c d", "a b c d e f a b c d e f", "É è ß x Z\x0bq", "w " * 5000):
        assert fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_tree_links_are_all_links():
    rng = np.random.default_rng(1)
    for n in (1, 2, 17, 300, 900):
        x = near(rng, n, 5)
        want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if int(x[i] ^ x[j]).bit_count() <= 4}
        got = [tuple(p) for i, j in tree_links(x, 4) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_links_connect_as_brute_force_does(spark):
    rng = np.random.default_rng(2)
    names = near(rng, 700, 12)
    want = plain_roots(names.tolist())
    reps = spark.createDataFrame([(int(x),) for x in names.view(np.int64)], "fp long")
    for blocks, dense in ((6, 4096), (7, 4096), (6, 40)):  # the last sends hot keys through the midpoints
        roots = {r.node: r.root for r in connected_components(fingerprint_links(reps, 4, blocks, dense)).collect()}
        got = [roots.get(int(x), int(x)) for x in names.view(np.int64)]
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_groups(spark):
    base = "the quick brown fox jumps over the lazy dog " * 30
    rows = [(5, base, "x"), (3, base.upper(), "x"), (9, base + "end", None), (2, "something else entirely here", "x"), (7, None, "x"), (6, "", "x"), (None, base, "x"), (5, base, "x")]
    rows += [(100 + i, "word" + str(i) + " " + "long " * 20000, "x") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit(1))
    names = [plain_fingerprint(r[1]) for r in rows]
    roots = plain_roots(names)
    least = {root: min(r[0] for r, x in zip(rows, roots, strict=True) if x == root and r[0] is not None) for root in set(roots)}
    want = sorted((r[0] or -1, n, least[x]) for r, n, x in zip(rows, names, roots, strict=True))
    got = sorted((r.doc_id or -1, r.fp % (1 << 64), r.component_id) for r in simhash_groups(docs).collect())
    assert got == want
    assert simhash_groups(docs.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(150)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    roots = {x: x for p in links[:-1] for x in p}
    for _ in range(60):
        for a, b in links[:-1]:
            roots[a] = roots[b] = min(roots[a], roots[b])
    assert got == {x: r for x, r in roots.items() if any(x in p and p[0] != p[1] for p in links)}
