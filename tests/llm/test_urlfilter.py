import random

from siltstone.llm import urlfilter


def brute(url, rules, listed, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    for entries, named in ((rules, True), (listed, False)):
        fits = [(len(h + p), v, h + p) for h, p, v in entries
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            _, verdict, key = max(fits)
            return host, path, key if named else None, verdict
    return host, path, None, default


def urls():
    rng = random.Random(1)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "EXAMPLE.com", "notexample.com", "x.net", "net",
             "É.net", "", "casino-win.example.org", "m.casino-win.example.org", "org", "com.", "a..net"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/", "/fr/?a", "/es?b=/es/", "#/en/", "?://net/es/", "/EN/", "//", "/es/\nx"]
    hosts.append("a." * 20_000 + "x.example.com")
    some = [rng.choice(["http://", "https://", "://", "x://y://", "http:/", ""]) + rng.choice(hosts) + rng.choice(paths)
            for _ in range(600)]
    return [None, "", "nothing", *some]


def test_verdicts_equal_brute_force(spark):
    rows = [(i if i % 10 else None, u, "x") for i, u in enumerate(urls())]
    listed = urlfilter.entries(spark, urlfilter.RULES, 1).union(urlfilter.entries(spark, urlfilter.LISTED, 0))
    df = spark.createDataFrame(rows, "page_id bigint, url string, key string")
    got = sorted(map(str, (tuple(r) for r in urlfilter.judged(df, listed).collect())))
    want = sorted(map(str, ((i, *brute(u, urlfilter.RULES, urlfilter.LISTED)) for i, u, _ in rows)))
    assert got == want


def test_large_lists_and_false_positives(spark, monkeypatch):
    rng = random.Random(2)
    rules = tuple((f"h{rng.randrange(3000)}.net", rng.choice(["/", "/a/", "/abc"]), rng.choice(["allow", "block"]))
                  for _ in range(2000))
    rules = tuple({(h, p): (h, p, v) for h, p, v in rules}.values())
    rows = [(i, f"http://s.h{rng.randrange(3000)}.net{rng.choice(['/', '/a/b', '/abcd', '/x'])}") for i in range(800)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    want = sorted((i, *brute(u, rules, ())) for i, u in rows)
    listed = urlfilter.entries(spark, rules, 1)
    assert sorted((tuple(r) for r in urlfilter.judged(df, listed).collect()), key=str) == sorted(want, key=str)
    # A filter of one block lets nearly everything pass; the join still decides.
    monkeypatch.setattr(urlfilter, "block_count", lambda n: 1)
    assert sorted((tuple(r) for r in urlfilter.judged(df, listed).collect()), key=str) == sorted(want, key=str)


def test_more_path_lengths_than_the_plan_takes(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "PATH_LENGTHS", 3)
    rng = random.Random(4)
    rules = tuple({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in
                   ((rng.choice(["net", "x.net", "a.x.net", "org"]), "/" + "ab/" * rng.randrange(12)) for _ in range(60))}.values())
    rows = [(i, rng.choice(["http://", "no"]) + rng.choice(["x.net", "b.a.x.net", "net", "y.org", "com", ""]) + "/" + "ab/" * rng.randrange(14))
            for i in range(300)] + [(900, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    got = sorted((tuple(r) for r in urlfilter.judged(df, urlfilter.entries(spark, rules, 1)).collect()), key=str)
    assert got == sorted(((i, *brute(u, rules, ())) for i, u in rows), key=str)


def test_the_filter_rejects_most_keys_and_no_listed_one(spark):
    listed = spark.range(5000).selectExpr("concat('k', id) AS key")
    blocks = urlfilter.block_count(5000)
    words = urlfilter.bloom(listed, blocks)
    passed = lambda keys: (keys.select("key", *urlfilter._masks(urlfilter.F.col("key"), blocks)).join(words, "block")
                           .where(" AND ".join(f"w{k} & m{k} = m{k}" for k in range(4))).count())
    assert passed(listed) == 5000
    assert passed(spark.range(20_000).selectExpr("concat('other', id) AS key")) < 200


def test_empty_lists_tables_and_repeated_entries(spark):
    df = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/")], "page_id bigint, url string")
    none = urlfilter.entries(spark, urlfilter.RULES, 1).limit(0)
    assert [r["verdict"] for r in urlfilter.judged(df, none, default="block").collect()] == ["block"] * 2
    twice = urlfilter.entries(spark, (("com", "/", "allow"), ("com", "/", "block")), 1)
    assert [(r["rule"], r["verdict"]) for r in urlfilter.judged(df, twice).collect()] == [("com/", "block")] * 2
    assert urlfilter.judged(df.limit(0), twice).collect() == []
