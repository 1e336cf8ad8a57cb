import heapq
import random
import resource
import time

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gleaner.llm.sentencepiece_nbest import LITERAL, MODEL, PLACEHOLDER, SPACE, Pieces, Segmenter, decode_ids, decoded, edited, encode_texts, lattice_codes, model_bytes

HARD = ["", " ", "  ", "a", "the cat", " a  b ", "\n\t", "é😀一▁x", "▁", "don't*** stop!!", "   x", "naïve\u0000z", "x" * 300, "word " * 200, "ein Überfluß, 4.50 €"]


@pytest.fixture(scope="module")
def pieces():
    return Pieces(model_bytes(MODEL))


def all_paths(text, pieces):
    """Every segmentation of a short text, as (score, ids)."""
    codes = lattice_codes(text).tolist()
    chars = ["\0" if c == LITERAL else chr(c) for c in codes]

    def from_(at):
        if at == len(codes):
            return [(0.0, ())]
        out = []
        for end in range(at + 1, min(len(codes), at + pieces.longest) + 1):
            known = pieces.by_name.get("".join(chars[at:end])) if LITERAL not in codes[at:end] else None
            if known:
                step = (known[1], (known[0],))
            elif end == at + 1:
                step = (pieces.unknown, pieces.fallback(SPACE if codes[at] == LITERAL else chars[at]))
            else:
                continue
            out += [(s + step[0], step[1] + p) for s, p in from_(end)]
        return out

    return from_(0)


def test_nbest_matches_brute_force(pieces):
    rnd = random.Random(1)
    texts = HARD[:9] + ["".join(rnd.choices("the ando ng.é▁", k=rnd.randrange(1, 9))) for _ in range(150)]
    segmenter = Segmenter(model_bytes(MODEL), 6)
    for text, (ids, score, nbest) in zip(texts, segmenter.segment(texts), strict=True):
        paths = all_paths(text, pieces)
        want = sorted((s for s, _ in paths), reverse=True)[:6]
        assert [s for s, _ in nbest] == pytest.approx(want) and score == pytest.approx(want[0])
        found = [tuple(edited(list(ids), edits)) for _, edits in nbest]
        assert len(set(found)) == len(found) and found[0] == tuple(ids)
        scores = {}
        for s, p in paths:
            scores.setdefault(p, []).append(s)
        for (s, _), p in zip(nbest, found, strict=True):
            assert any(abs(s - x) < 1e-6 for x in scores[p])


def nbest_scores(text, pieces, n):
    """The scores of the n best segmentations, by a dynamic programme that keeps the n best of every prefix."""
    codes = lattice_codes(text).tolist()
    chars = ["\0" if c == LITERAL else chr(c) for c in codes]
    best = [[0.0]]
    for end in range(1, len(codes) + 1):
        found = []
        for start in range(max(0, end - pieces.longest), end):
            known = pieces.by_name.get("".join(chars[start:end])) if LITERAL not in codes[start:end] else None
            if known or end == start + 1:
                found += [s + (known[1] if known else pieces.unknown) for s in best[start]]
        best.append(heapq.nlargest(n, found))
    return best[-1]


def own_score(ids, pieces):
    """Score of ids none of which is a byte."""
    scores = dict(pieces.by_name.values())
    return sum(scores[i] for i in ids)


def test_nbest_matches_a_dynamic_programme_on_long_units(pieces):
    rnd = random.Random(3)
    texts = ["-" * 60, "=" * 300, "a" * 299, "ha" * 100, "-=" * 77, " " * 200, "*-_" * 90, "-" * 70 + "x" + "=" * 70, "_" * 64, "é" * 61]
    texts += ["".join(rnd.choices(rnd.choice(["-=", "ab", "aeh", "_-*", "the "]), k=rnd.randrange(60, 301))) for _ in range(60)]
    for n in (1, 4, 7):
        for text, (ids, score, nbest) in zip(texts, Segmenter(model_bytes(MODEL), n).segment(texts), strict=True):
            want = nbest_scores(text, pieces, n)
            assert [s for s, _ in nbest] == pytest.approx(want) and score == pytest.approx(want[0])
            found = [tuple(edited(list(map(int, ids)), edits)) for _, edits in nbest]
            assert len(set(found)) == len(found) == len(want)
            for (s, _), path in zip(nbest, found, strict=True):
                assert own_score(path, pieces) == pytest.approx(s) and decode_ids(path, pieces) == text


@pytest.mark.parametrize("base", ["-", "=", "a", "ha", "ab", "▁", " "])
def test_long_runs_are_cheap(base, pieces):
    segmenter = Segmenter(model_bytes(MODEL))
    for n in (400, 1_000, 10_000, 100_000):
        before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
        ids, _, nbest = segmenter.segment([base * n])[0]
        assert time.process_time() - began < 30
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 * 1024  # KB
        for _, edits in nbest:
            assert decode_ids(edited(list(map(int, ids)), edits), pieces) == base * n


def test_forward_passes_agree(pieces):
    rnd = random.Random(4)
    segmenter = Segmenter(model_bytes(MODEL))
    codes = [lattice_codes("".join(rnd.choices("the ando ng.-é▁", k=rnd.randrange(1, 30)))) for _ in range(80)]
    lengths = np.array([len(c) for c in codes])
    padded = np.zeros((len(codes), lengths.max()), np.int64)
    for row, c in zip(padded, codes, strict=True):
        row[: len(c)] = c
    whole = segmenter.forward(padded, lengths)
    for i, c in enumerate(codes):
        for all_rows, one in zip(whole, segmenter.forward_one(c), strict=True):
            assert all_rows[i, 1 : len(c) + 1].tolist() == list(one)[1:]


def test_round_trip(pieces):
    rnd = random.Random(2)
    alphabet = [chr(c) for c in (*range(1, 300), 0x2581, 0x4E00, 0x1F600, 0x10FFFF)]
    texts = HARD + ["".join(rnd.choices(alphabet, k=rnd.randrange(400))) for _ in range(100)]
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text, (ids, _, nbest) in zip(texts, Segmenter(model_bytes(MODEL)).segment(texts), strict=True):
        assert decode_ids(ids, pieces) == text
        for _, edits in nbest:
            assert decode_ids(edited(list(map(int, ids)), edits), pieces) == text
        if "\0" not in text:
            assert processor.decode([int(i) for i in ids]) == text
    assert all(s > PLACEHOLDER for _, s, _ in Segmenter(model_bytes(MODEL)).segment(["a    b"]))


def test_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(HARD)] + [(99, None, "x"), (None, "no id", "x"), (1, " ", "x"), (98, "long " * 50000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ab string").withColumnRenamed("ab", "a.b")
    encoded = encode_texts(docs)
    assert encoded.columns == ["doc_id", "a.b", "ids", "score", "nbest"]
    got = sorted(((r.doc_id or -1, r.back) for r in encoded.withColumn("back", decoded(spark)).collect()), key=str)
    assert got == sorted(((r[0] or -1, r[1] or "") for r in rows), key=str)
    nothing = encoded.where("doc_id = 99").first()
    assert (nothing.ids, nothing.score, len(nothing.nbest)) == ([], 0.0, 1)
    assert encode_texts(docs.limit(0)).count() == 0


def test_clashing_columns_give_way(spark):
    docs = spark.createDataFrame([(1, "the cat", 7, "x", [1], 2.5)], "doc_id long, text string, ids int, NBest string, score array<int>, `c0` double")
    plain = encode_texts(docs.select("doc_id", "text")).first()
    encoded = encode_texts(docs)
    assert encoded.columns == ["doc_id", "c0", "ids", "score", "nbest"]
    row = encoded.first()
    assert (row.c0, row.ids, row.score, row.nbest) == (2.5, plain.ids, plain.score, plain.nbest)
    odd = docs.select("text", F.struct(F.lit(1).alias("a b"), F.lit("x").alias("c.d")).alias("e-f"))
    assert encode_texts(odd).first()["e-f"].asDict() == {"a b": 1, "c.d": "x"}
