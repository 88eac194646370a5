"""URL filter by Bloom filter cascades against plain rules."""

import random

from orderpulse.llm import url_cascade as U


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def brute(pages, rules, listed):
    out = []
    fits = lambda host, h: host == h or host.endswith("." + h)
    for page, url in pages:
        host, path = split(url)
        best = None
        for key, verdict in rules:
            if key is None:
                continue
            h, p = (key[:key.index("/")], key[key.index("/"):]) if "/" in key else (key, "")
            if h and fits(host, h) and path.startswith(p):
                rank = (len(key), len(h), verdict == "block")
                best = max(best or rank + (key, verdict), rank + (key, verdict))
        rule, verdict = best[3:] if best else (None, None)
        if not verdict:
            verdict = "block" if host and any(k and fits(host, k) for k in listed) else "allow"
        out.append((page, host, path, rule, verdict))
    return sorted(out, key=str)


def run(spark, pages, rules, listed, **more):
    p = spark.createDataFrame([(i, u, "h", "k") for i, u in pages],
                              "page_id long, url string, host string, rule string").repartition(3)
    r = spark.createDataFrame(rules, "key string, verdict string")
    k = spark.createDataFrame([(x,) for x in listed], "key string")
    got = U.judge(p, r, k, **more)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted((tuple(x) for x in got.collect()), key=str)


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"),
         ("bare.org", "block"), ("org/fr/x", "block"), ("a.org/", "allow"), ("a.org/", "block"), (None, "block"),
         ("b.org/f", "allow"), ("b.org/f", "allow")]
ODD = [None, "", "no scheme", "http://", "http://NET/", "http://net", "x://a.EXAMPLE.net/en/1?q=/de/", "://.net/",
       "http://example.net?x", "http://example.net#/en/", "http://exämple.NET/É", "http://notexample.com/de/",
       "http://a..net/", "http://net./x", "http://u@net:80/", "http://a.org/fr/x://b.net/", "ftp://b.org/fr\n/x",
       "http://sub.bare.org", "http://a.org", "http://x.a.org/fr/x1", "http://" + "a." * 30_000 + "net/" + "y" * 100_000]


def test_odd_urls(spark):
    pages = list(enumerate(ODD)) + [(3, ODD[5]), (None, ODD[6]), (5, ODD[5])]
    assert run(spark, pages, RULES, ["spam.org", "a..net", None, "spam.org"]) == brute(pages, RULES, ["spam.org", "a..net"])


def test_large_lists_in_several_cascades(spark):
    rng = random.Random(4)
    host = lambda: ".".join(rng.choice(["a", "b", "cc", "d1", "e-e"]) + str(rng.randrange(30))
                            for _ in range(rng.randint(1, 3))) + rng.choice([".com", ".net"])
    pages = [(i, f"http://{host()}/{rng.choice(['en', 'de'])}/{rng.randrange(9)}") for i in range(2500)]
    hosts = sorted({split(u)[0] for _, u in pages})
    listed = rng.sample(hosts, 500) + [host() for _ in range(300)]
    rules = [(f"{h}/{rng.choice(['en', 'de'])}/", rng.choice(["block", "allow"])) for h in rng.sample(hosts, 300)]
    rules = list(dict(rules).items())
    want = brute(pages, rules, listed)
    assert run(spark, pages, rules, listed) == want
    assert run(spark, pages, rules, listed, max_bytes=300) == want  # several shards and passes


def test_cascade_is_exact_on_its_universe_and_small(spark):
    keys = spark.range(20_000).selectExpr("cast(id as string) key")
    inside = U._hashed(keys.where("cast(key as int) % 20 = 0"))
    universe = U._hashed(keys)
    (c,) = U.build("block", inside, universe)
    rows = {(r["h1"], r["h2"]) for r in inside.collect()}
    got = universe.toPandas()
    found = c.member(got["h1"].to_numpy().view("uint64"), got["h2"].to_numpy().view("uint64"))
    assert [tuple(x) in rows for x in got.to_numpy().tolist()] == found.tolist()
    assert len(c.levels) > 3 and c.nbytes * 8 < 16 * 1000  # 1000 listed keys; sorted hashes take 64 bits each


def test_empty_tables(spark):
    assert run(spark, [], RULES, ["x"]) == []
    assert run(spark, [(1, "http://x/")], [], []) == [(1, "x", "/", None, "allow")]
