import re

from gleaner.llm.license_scan import PHRASES, license_scan

GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]
    at = sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def scan(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, words string, score double")
    return [r.asDict() for r in license_scan(docs).orderBy("doc_id").collect()]


def test_base_places_match_brute_force(spark):
    texts = [None, "", "  ", "Released under the MIT License.", "UNDER THE MIT LICENSE", "under  the\nmit-license", "under the mit licenses", "xunder the mit license"]
    texts += ["CC BY-NC cc by nc cc by nc 4.0", "Apache License, Version 2.0", "apache license version 2 0 under the mit license cc by nc", "cc by ncé", "under the mİt license"]
    texts += ["K under the mit license K", "word " * 30000 + "cc by nc " * 50 + "tail " * 7, "été 😀 cc by nc", "x" * 100000 + " cc by nc"]
    got = scan(spark, texts + texts[3:4])
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got] == [plain(t) for t in texts + texts[3:4]]
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_diagonals(spark):
    gap = GPL.replace("redistribute it", "redistribute all of it").replace("as published by", "published by")
    half = " ".join(GPL.split()[:14])
    texts = [f"one two three {GPL} four", gap, half, "All rights reserved", "general public license of free software in any later version", " ".join(reversed(GPL.split())), f"{GPL}\n{GPL}", "all rights reserved " * 500]
    got = scan(spark, texts)
    assert [r["labels"] for r in got] == ["gpl-3", "gpl-3", "", "all-rights-reserved", "", "", "gpl-3", "all-rights-reserved"]
    span = got[0]["spans"][0]
    assert (span["start"], span["end"], span["share"]) == (3, 3 + len(re.findall(r"\w+", GPL)), 1.0)
    assert 0.75 <= got[1]["score"] < 1 and len(got[6]["spans"]) == 2 and len(got[7]["spans"]) == 500
