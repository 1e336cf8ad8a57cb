import random

from gleaner.llm import url_filter as module
from gleaner.llm.url_filter import RULES, featured, parsed, url_filter


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([i for c in "/?#" if (i := rest.find(c)) >= 0] or [len(rest)])
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = rest[: min([i for c in "?#" if (i := rest.find(c)) >= 0] or [len(rest)])]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def urls(seed, n=1500):
    rnd = random.Random(seed)
    out = [None, "", "no scheme.com/", "http://", "HTTP://WWW.Example.COM/en/x?y=1#z", "http://example.com/en/", "http://example.com/en", "http://xexample.com/en/1", "https://a.net?x=/es/", "https://net/es/1"]
    out += ["https://a.net#/fr/", "http://É.COM/ÀB", "http://u:p@a.com:80/", "a://b://c.com/", "http://x.net/es/" + "y" * 5000, "http://com/\nq"]
    for _ in range(n):
        host = rnd.choice(["", "www.", "blog.", "m."]) + rnd.choice(["example", "alpha", "beta-bets"]) + rnd.choice([".com", ".net", ".org"])
        out.append(f"https://{host}/{rnd.choice(['en', 'es', 'fr', 'de'])}/{rnd.randrange(999)}{rnd.choice(['', '?a=1&b=2', '#top', '.html'])}")
    return out


def test_rules_match_brute_force(spark):
    rows = [(i, u, "x", "allow") for i, u in enumerate(urls(1))] + [(4, "http://x.net/es/", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = url_filter(pages, support=10).collect()
    assert len(got) == len(rows)
    want = {(r[0], r[1]): plain(r[1]) for r in rows}
    for r in got:
        options = [v for (i, _), v in want.items() if i == r.page_id]
        assert any((r.host, r.path, r.rule) == o[:3] and r.verdict in ([o[3]] if o[3] else ["allow", "block"]) for o in options)
        assert 0 <= r.score <= 1


def test_trees_learn_what_the_labels_say(spark):
    pages = spark.createDataFrame(list(enumerate(urls(2, 3000))), "page_id long, url string")
    got = url_filter(pages, support=10)
    judged = [r for r in got.collect() if r.rule]
    right = sum((r.score >= 0.5) == (r.verdict == "block") for r in judged)
    assert right > 0.95 * len(judged)


def test_small_tables(spark):
    schema = "page_id long, url string"
    assert url_filter(spark.createDataFrame([], schema)).count() == 0
    assert [r.verdict for r in url_filter(spark.createDataFrame([(1, "http://a.org/"), (2, None)], schema)).collect()] == ["allow", "allow"]
    assert {r.verdict for r in url_filter(spark.createDataFrame([(1, "http://a.net/es/"), (2, "http://b.org/")], schema)).collect()} == {"block"}


def test_features(spark):
    row = featured(parsed(spark.createDataFrame([("http://a.b.org/x/yy-1?p=1&q=2",)], "url string"))).first()
    assert (row.length, row.depth, row.parameters, row.labels, row.hyphens, row.domain, row.section) == (29, 2, 2, 3, 1, "b.org", "org/x")
    text = "http://a.b.org/x/yy-1?p=1&q=2"
    from math import log2

    assert abs(row.entropy + sum(text.count(c) / 29 * log2(text.count(c) / 29) for c in set(text))) < 1e-9


def test_suffixes_count_all_labelled_urls(spark, monkeypatch):
    urls = [f"https://{'a' if i % 2 else 'b'}.{'net/es' if i % 3 else 'com/x'}/{i}" for i in range(4000)] + [f"https://rare.site.com/{i}" for i in range(60)]
    pages, seen = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), []
    rates = module.suffix_rates
    monkeypatch.setattr(module, "suffix_rates", lambda *a: seen.append(rates(*a)) or seen[-1])
    few = url_filter(pages, sample=400, support=10).count()
    assert "rare.site.com" in {r.suffix for r in seen[0].where("kind = 'site'").collect()}
    monkeypatch.setattr(module, "BROADCAST", 0)
    assert url_filter(pages, sample=400, support=10).count() == few == len(urls)


def test_held_out_urls_without_a_rule(spark):
    """Rules label some hosts; the trees judge hosts that no rule and no suffix statistic knows, by how their URLs look."""
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choices("abcdefghij", k=n))

    def url(host, bad):
        if rnd.random() < 0.01:
            bad = not bad  # noise
        if bad:
            return f"http://{host}/{'/'.join(word(2) + str(rnd.randrange(10**5)) for _ in range(rnd.randrange(2, 6)))}?a={rnd.randrange(10**9)}&b={rnd.randrange(10**9)}&c={word(3)}"
        return f"http://{host}/{word(6)}/{word(rnd.randrange(4, 9))}-{word(5)}"

    rows, truth = [], {}
    for i in range(3000):
        bad, known = i % 3 == 0, i % 2 == 0
        host = f"{word(4)}.{'evil' if bad else 'good'}-{i % 4}.org" if known else f"{word(5)}.{word(4)}.net"
        rows.append((i, url(host, bad)))
        if not known:
            truth[i] = bad
    rules = [("block" if kind == "evil" else "allow", f"{kind}-{k}.org", "/") for kind in ("evil", "good") for k in range(4)]
    got = {r.page_id: r for r in url_filter(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert all(got[i].rule is None for i in truth)
    assert sum((got[i].verdict == "block") == bad for i, bad in truth.items()) >= 0.9 * len(truth)
