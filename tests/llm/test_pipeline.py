import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_pii import plain as plain_spans
from test_shingle_dedup import plain as plain_groups

import corpus_pipeline
from gleaner.llm.common import cut
from gleaner.llm.mixing import mix_sizes
from gleaner.llm.quality_classifier import quality_scores
from gleaner.llm.sentencepiece_nbest import MODEL, Pieces, decode_ids, model_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randrange(2, 9)))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rnd.randrange(30, 120))]
        if i % 9 == 0:
            words.insert(5, rnd.choice(["me@mail.example.com", "10.0.0.7", "4111111111111111", "+1 (712) 555-9396"]))
        good = i % 4 > 0
        text = " ".join(words if good else [w + "***" for w in words])
        if i % 10 == 3 and rows:
            text = rows[-1][1] + rnd.choice(["", " end"])
        rows.append((i, text, rnd.choice(["en", None]), rnd.choice(["a", "a", "a", "b", None]), len(text)))
        labels.append((i, int("***" not in text), 0))
    rows += [(500, None, "en", "a", 0), (501, "", "en", "a", 0), (7, rows[7][1], "en", "a", 1), (None, " ".join(word() for _ in range(60)), "en", "a", 1)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_every_stage_against_a_plain_version(spark, folder, tmp_path):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs, stage(spark, docs, folder)
        if name != "sentencepiece":
            assert out.columns == before.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before.collect(), docs.collect())
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "", str(r.source))

    before, after = kept["quality"]
    scores = quality_scores(spark.createDataFrame(before, SCHEMA), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    good = {r.doc_id for r in scores if r.predicted}
    assert sorted(map(key, after)) == sorted(key(r) for r in before if r.doc_id in good)
    assert all("***" not in (r.text or "") for r in after) and sum("***" not in (r.text or "") for r in before) <= len(after) + 3

    before, after = kept["near_duplicates"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in after) == plain_groups([(r.doc_id, r.text) for r in before])
    assert {r.text for r in before if r.doc_id is None} <= {r.text for r in after}
    assert {key(r) for r in after} <= {key(r) for r in before}

    before, after = kept["personal_data"]
    texts = {r.doc_id: r.text for r in after}
    for r in before:
        assert r.doc_id in texts
        n, _ = plain_spans(r.text)
        for kind, count in zip(("email", "ip", "card", "phone"), n, strict=True):
            assert (texts[r.doc_id] or "").count(f"[{kind}]") == count
        assert sum(plain_spans(texts[r.doc_id])[0]) == 0

    before, after = kept["mixing"]
    want = {r.doc_id: r.taken for r in mix_sizes(spark.createDataFrame(before, SCHEMA)).collect() if r.taken}
    got = defaultdict(int)
    for r in after:
        got[r.doc_id] += len(r.text.split())
    assert got == want

    before, after = kept["sentencepiece"]
    pieces = Pieces(model_bytes(MODEL))
    assert sorted((r.doc_id or -1, decode_ids(r.ids, pieces)) for r in after) == sorted((r.doc_id or -1, r.text) for r in before)


def test_run_is_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, docs.collect()))


def test_columns_of_any_name_come_through(spark, folder, tmp_path):
    """Every name that a stage uses inside, an output's name and a name with a dot; each comes back with its own values."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60 and n_chars > 1 or doc_id is null")
    names = ["_id", "_n", "_digest", "_size", "_start", "_h", "_g", "_doc", "_row", "_text", "row", "size", "name", "class", "fp", "statistics", "label", "_new", "a.b", "email", "candidates", "score", "ids", "nbest", "c0"]
    extra = {c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in names}
    odd = docs.withColumns(extra)
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    plain = docs
    for name, stage in corpus_pipeline.STAGES:
        odd, plain = stage(spark, odd, str(tmp_path)), stage(spark, plain, folder)
        kept = [c for c in names if name != "sentencepiece" or c not in ("score", "ids", "nbest")]
        for r in odd.collect():
            assert all(r[c] == f"{c} {'none' if r.doc_id is None else r.doc_id}" for c in kept)
        odd, plain = cut(odd), cut(plain)
    assert sorted((r.doc_id or -1, r.ids) for r in odd.collect()) == sorted((r.doc_id or -1, r.ids) for r in plain.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == odd.count()
