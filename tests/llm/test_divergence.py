"""Source divergence against sums over every term."""

import random
import re
from collections import Counter, defaultdict

import pytest

from orderpulse.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, top):
    """rows: (text, lang, source)."""
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for t, lang, src in ((t or "", a or "", b or "") for t, a, b in rows):
        words = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        groups.add((lang, src))
        count[lang, src].update(words)
        df[lang].update(set(words))
    out = []
    for lang in {a for a, _ in groups}:
        kept = [w for w, n in df[lang].items() if n >= min_docs]
        v, sources = len(kept), sorted(s for a, s in groups if a == lang)
        whole = sum((count[lang, s] for s in sources), Counter())

        def prob(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 5) // (n + 5 * v) for w in kept}

        p, q = {s: prob(count[lang, s]) for s in sources}, prob(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in sources if o != s]
            terms = [(w, p[s][w] - q[w]) for w in kept if count[lang, s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, y, i + 1) for i, (x, y) in enumerate(items[:most])]
    return sorted(out)


def corpus(seed=5, n=500):
    rng = random.Random(seed)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Été", "中", "été", "don't"]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", "xx", None])
        src = rng.choice(["hot", f"s{rng.randrange(6)}", None])
        rows.append((" ".join(vocab[int(len(vocab) * rng.random() ** 3)] for _ in range(rng.randint(0, 40))), lang, src))
    rows += [(None, "en", "none"), ("", "en", "empty"), ("1 2 3", "fr", "a"), (None, "fr", "b"), (None, None, None),
             ("wa0 " * 40_000 + "W" * 100_000, "en", "long"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("min_docs,tile,span", [(5, 64, 4096), (1, 2, 128), (30, 64, 64), (10**6, 64, 4096)])
def test_equals_sums_over_all_terms(spark, monkeypatch, min_docs, tile, span):
    monkeypatch.setattr(D, "TILE", tile)
    monkeypatch.setattr(D, "SPAN", span)
    rows = corpus()
    df = spark.createDataFrame([(*r, 7, "p", 1) for r in rows],
                               "text string, lang string, source string, n int, term string, bits int").repartition(4)
    got = D.audit(df, min_docs, 5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, min_docs, 5)


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_counts_beyond_a_double(spark):
    row = spark.range(1).select(D.probability(
        D.F.lit(4 * 10**17 + 1), D.F.lit(9 * 10**17), D.F.lit(3)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (4 * 10**17 + 6) // (9 * 10**17 + 15)
