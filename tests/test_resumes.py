import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import resumes as P
from gleaner.functions.phrases import keyword_coverage
from gleaner.operators.calls import embedded, scored_within
from gleaner.operators.rules import Catalog
from gleaner.sources import boards


def column(spark, values, kind, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", build(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


RANGES = {
    "Mar 2019 – Present": ("2019-03", "", True),
    "February 2020 - Dec 2021": ("2020-02", "2021-12", False),
    "2011-2014": ("2011", "2014", False),
    "07/2018 – 9/2019": ("2018-07", "2019-09", False),
    "Winter 2017": ("2017-12", "", False),
    "Sept. 2016 – Jan. 2017": ("2016-09", "2017-01", False),
    "expected June 2027": ("2027-06", "", False),
    "2022-04 to now": ("2022-04", "", True),
    "13/2020": ("2020", "", False),
    "Term 2 of 2020": ("2020", "", False),
    "no date": ("", "", False),
    None: ("", "", False),
}


def test_parsed_dates(spark):
    got = column(spark, list(RANGES), "string", P.parsed_dates)
    assert {k: tuple(x) for k, x in zip(RANGES, got, strict=True)} == RANGES


def test_recent_first(spark):
    jobs = [("a", "2019", False), ("b", "2021-05", False), ("c", "", True), ("d", "2021-11", False), ("e", "", False), ("f", "2021", False), ("g", "", True)]
    frame = spark.createDataFrame([(jobs,)], "j array<struct<name: string, end: string, current: boolean>>")
    assert [e.name for e in frame.select(P.recent_first(F.col("j")).alias("j")).first().j] == ["c", "g", "e", "d", "b", "f", "a"]


def plain_first_sentence(text, n):
    s = text.strip()
    i = s.find(". ")
    if i > 0:
        s = s[: i + 1]
    if len(s.encode()) <= n:
        return s
    s = s.encode()[:n].decode("utf-8", "ignore")
    cut = s.rfind(" ")
    if cut >= 0 and len(s[:cut].encode()) >= n // 2:
        s = s[:cut]
    return s.rstrip(" ,;:") + "…"


def test_first_sentence(spark):
    rnd = random.Random(2)
    texts = ["", "  One. Two", "é" * 60, ". x", "word " * 40, "a" * 100, "one, two, three; " * 9]
    texts += ["".join(rnd.choices("ab é,;. 😀", k=rnd.randrange(90))) for _ in range(200)]
    assert column(spark, texts, "string", lambda v: P.first_sentence(v, 30)) == [plain_first_sentence(t, 30) for t in texts]


def test_keyword_windows(spark):
    rnd = random.Random(3)
    words = ["visa", "sponsor", "c++"]
    texts = ["", "nothing", "Visa", "x" * 700 + "SPONSOR" + "y" * 700]
    texts += ["".join(rnd.choices(["visa", "sponsor", "c++", "\n", " lorem", " ipsum dolor sit amet", "."], [1, 1, 1, 2, 40, 40, 10], k=rnd.randrange(150))) for _ in range(60)]

    def plain(text):
        spans = sorted((max(0, i - 100), min(len(text), i + len(w) + 100)) for w in words for i in range(len(text)) if text.lower().startswith(w, i))
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return " \n ".join(text[a:b] for a, b in merged)

    assert column(spark, texts, "string", lambda v: P.keyword_windows(v, words, 100)) == [plain(t) for t in texts]


def test_known_terms(spark):
    got = column(spark, ["Terraform, K8s; then GO or Golang; ci/cd, linux/bash.", "nothing here", None], "string", P.known_terms)
    assert got == [["terraform", "go", "ci/cd", "linux", "bash", "kubernetes"], [], []]  # one named otherwise stands last


def test_keyword_coverage(spark):
    words = F.array(*map(F.lit, ("Kubernetes", "k8s", "orchestration (Airflow/Dagster)", "Postgres", "Rust", "C++", "")))
    got = column(spark, ["We run k8s, airflow and PostgreSQL.", "", None], "string", lambda v: keyword_coverage(v, words))
    assert (got[0].matched, got[0].missing, got[0].percent) == (["Kubernetes", "orchestration (Airflow/Dagster)", "Postgres"], ["Rust", "C++"], 60)
    assert got[1].percent == got[2].percent == 0 and len(got[1].missing) == 5


def test_embedded(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(70)] + [(70, None)], "id int, text string").repartition(2)
    backwards = lambda texts: [(i, [float(len(t)), float(i)]) for i, t in reversed(list(enumerate(texts)))]
    got = {r.id: r.vector for r in embedded(rows, backwards).collect()}
    assert len(got) == 71 and got[5][0] == 2.0 and got[60][0] == 3.0 and got[70][0] == 0.0
    with pytest.raises(Exception, match="vectors for"):
        embedded(rows, lambda texts: backwards(texts)[1:]).collect()


def test_scored_within(spark):
    rows = spark.createDataFrame([(u, i, 3, f"p{i}") for u in (1, 2) for i in range(5)], "user int, id int, cost int, prompt string")
    got = scored_within(rows, lambda prompts: [p.upper() for p in prompts], ["user"], "cost", F.when(F.col("user") == 1, 7).otherwise(100), F.asc("id"))
    assert sorted((r.user, r.id, r.reply) for r in got.collect()) == [(1, i, f"P{i}") for i in range(3)] + [(2, i, f"P{i}") for i in range(5)]


def test_catalogs_are_checked():
    given = {"families": {"a": ["x"]}, "levels": {"senior": [["sr"], []]}, "overrides": {"o": [["a"], ["y"]]}, "flags": ["z"]}
    made = Catalog.from_mapping(given)
    assert made.levels == {"senior": (["sr"], [])} and made.overrides["o"] == (["a"], ["y"]) and made.refusal_words
    for wrong in ({"other": 1}, {"families": {"a": ["("]}}, {"overrides": {"o": [["b"], []]}}):
        with pytest.raises(ValueError):
            Catalog.from_mapping(given | wrong)


def test_models_and_zones():
    assert P.model_prefixes("BAAI/bge-small-en-v1.5")[0].startswith("Represent") and P.model_prefixes("intfloat/e5-base") == ("query: ", "passage: ")
    assert P.model_prefixes("nomic-embed-text")[1] == "search_document: " and P.model_prefixes("bge-m3") == ("", "")
    assert P.keyed_model("m", "q", "") == "m" and P.keyed_model("m", "q", "x") == "m#q2d711642" and P.keyed_model("m", "d", "y") != P.keyed_model("m", "d", "x")
    assert [P.zone_or_utc(z) for z in ("Europe/Berlin", "", None, "Nowhere/None", "x" * 65, "../etc")] == ["Europe/Berlin", "UTC", "UTC", "UTC", "UTC", "UTC"]


@pytest.mark.parametrize(
    "reader, schema, detail, html, remote, title",
    [
        (boards.oracle_detail, boards.ORACLE_DETAIL, ("1", [(" New ", "<p>a</p>", " ", "<p>c</p>", "2024-05-01T10:00:00Z", "ORA_REMOTE")]), "<p>a</p>\n<p>c</p>", True, "New"),
        (boards.rippling_detail, boards.RIPPLING_DETAIL, ("1", "", ("<p>us</p>", "<p>role</p>"), "2024-05-01T10:00:00.123Z"), "<p>role</p>\n<p>us</p>", None, "Old"),
        (boards.workable_detail, boards.WORKABLE_DETAIL, ("1", ("T", "<p>d</p>", "<ul><li>r</li></ul>", None, "Remote", False)), "<p>d</p>\n<ul><li>r</li></ul>", True, "T"),
        (boards.eightfold_detail, boards.EIGHTFOLD_DETAIL, ("1", "<div>e</div>"), "<div>e</div>", None, "Old"),
    ],
)
def test_details(spark, reader, schema, detail, html, remote, title):
    listed = spark.createDataFrame([("1", "Old", "here", "u", "dep", "", "", None, None), ("2", "Other", "", "", "", "", "", None, None)], "ext_id string, title string, location_raw string, url string, department string, description_html string, description_text string, is_remote boolean, posted_at timestamp").select(*boards.COLUMNS)
    row = reader(listed, spark.createDataFrame([detail], schema)).collect()
    assert len(row) == 1 and (row[0].ext_id, row[0].title, row[0].description_html, row[0].is_remote, row[0].location_raw) == ("1", title, html, remote, "here")
    assert row[0].description_text and "<" not in row[0].description_text


def test_json_patch(spark):
    rows = [
        ('{"b": {"x": [1, null]}, "a": "decline", "é": "q\\"u"}', '{"a": 1}', '{"c": {"d": 2}, "a": null}', '{"a":null,"b":{"x":[1,null]},"c":{"d":2},"é":"q\\"u"}'),
        ('{"a": {"x": 1, "y": 2}}', '{"a": {"x": 3}}', None, '{"a":{"x":3}}'),  # only top fields are merged
        ("{}", "nope", "[1]", "{}"),
        ("nope", '{"a": 1}', None, "nope"),
        ("[1]", '{"a": 1}', None, "[1]"),
        (None, '{"a": 1}', None, None),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d string, p string, q string, want string")
    got = frame.select("i", "want", P.json_patch(F.col("d"), F.col("p"), F.col("q")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [r.want for r in got]
    details = '{"gender":"decline","race":"x","note":"decline","veteran":"decline"}'
    cleared = spark.createDataFrame([(details,)], "d string").select(P.without_stored_defaults(F.col("d")).alias("x")).first().x
    assert cleared == '{"gender":"","note":"decline","race":"x","veteran":""}'
