import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.llm.line_dedup import drop_repeated_lines, line_hashes, suspects

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def plain(rows, least_chars=40, least_docs=5):
    order = lambda d: (d is not None, d or 0)
    holders = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(order(doc_id))
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == order(doc_id)]
        out.append((order(doc_id), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def documents(seed=3):
    rnd = random.Random(seed)
    common = ["".join(rnd.choices("abcdé 😀", k=rnd.randrange(37, 60))) for _ in range(40)]
    forms = [lambda s: s, str.upper, lambda s: f" \t{s}\r", lambda s: f"{s}\x0b\x0c", lambda s: f" {s}"]
    rows = []
    for i in range(400):
        lines = [rnd.choice(forms)(rnd.choice(common[: 40 if i % 3 else 3])) if rnd.random() < 0.4 else "".join(rnd.choices("xyz ", k=rnd.randrange(0, 70))) for _ in range(rnd.randrange(0, 9))]
        rows.append((i, "\n".join(lines), "keep", "clash"))
    hot = "one line that stands in a third of all documents there are"
    rows += [(1000 + i, f"{hot}\nown line number {i}\n{hot}", "keep", "clash") for i in range(200)]
    rows += [(2000, None, "keep", "x"), (2001, "", "keep", "x"), (2002, "\n", "keep", "x"), (2003, hot * 5000 + "\n" + hot.upper(), "keep", "x"), (7, rows[7][1], "keep", "x"), (7, hot, "keep", "x"), (None, hot + "\nx", "keep", "x")]
    four = "this line of forty code points or more stands in four documents and twice in one"
    return rows + [(3000 + i, f"{four}\n{four}", "keep", "x") for i in range(4)]


SCHEMA = "doc_id long, text string, `a.b` string, n_lines string"


@pytest.mark.parametrize("bits,broadcast", [(16, 1 << 25), (16, 0), (1, 0)])
def test_against_plain_version(spark, bits, broadcast):
    docs = spark.createDataFrame(documents(), SCHEMA).repartition(7)
    out = drop_repeated_lines(docs, bits=bits, broadcast=broadcast)
    assert out.columns == ["doc_id", "text", "a.b", "n_lines", "n_dropped"]
    rows = out.collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.text, r.n_lines, r.n_dropped) for r in rows) == plain(documents())
    assert {r["a.b"] for r in rows} == {"keep"} and sum(r.n_dropped for r in rows) > 500


def test_only_repeats_are_suspected(spark):
    rows = [(i, f"line {i} that stands in one document only, over and over") for i in range(20000)] + [(i, "a line of forty code points that comes again") for i in range(3)]
    lines = line_hashes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 40)
    found = suspects(lines).collect()
    assert {r.doc_id for r in found} >= {0, 1, 2} and 3 <= len(found) <= 3 + 200  # a false suspect in some hundred lines at most


def test_empty_and_nothing_to_drop(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert drop_repeated_lines(empty).count() == 0
    docs = empty.union(spark.createDataFrame([(1, None, "a", "b"), (2, "short\nshort", "a", "b")], SCHEMA))
    assert sorted(tuple(r) for r in drop_repeated_lines(docs).collect()) == [(1, "", "a", 1, 0), (2, "short\nshort", "a", 2, 0)]


def test_reruns_agree_over_other_partitions(spark):
    docs = spark.createDataFrame(documents(9), SCHEMA)
    first, second = (sorted(map(str, drop_repeated_lines(d).collect())) for d in (docs, docs.repartition(11, F.rand(4))))
    assert first == second
