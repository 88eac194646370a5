"""Quality rules: counts against a plain version, outliers, edge cases."""

import random
import re
from collections import Counter

import pyarrow as pa

from orderpulse.llm import common, quality as Q
from orderpulse.llm.queries import QUERIES


def plain(t):
    words, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t or ""), set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            cover.update(range(i, i + 5))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)]


def test_counts_equal_a_plain_version(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\té#|中\x0b\x85") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += ["", None, "\n\n", " a \n a \n", "one two three four five one two three four five"]
    monkeypatch.setattr(common, "SLICE_BYTES", 5000)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got = []
    for b in common.slices([batch.slice(1)]):
        c = Q.text_counts(*common.text_buffer(b.column(0)))
        got += [[int(c[k][i]) for k in Q.COUNTS[:5]] for i in range(b.num_rows)]
    assert got == [plain(t) for t in texts[1:]]


def rows(n=900):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    out = []
    for d in range(n):
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(8, 15))) for _ in range(rng.randint(2, 12))]
        text = "\n".join(lines)
        if d % 30 == 0:
            text = " ".join(w + "###|" for w in text.split())
        elif d % 30 == 1:
            text = text.upper()
        out.append((d, text, "en" if d % 2 else "fr", f"s{d % 3}", "x"))
    return out


def test_outliers_go_and_ordinary_text_stays(spark):
    odd = [(2000, None, "en", "s1", "x"), (2001, "", None, None, "x"), (2002, "few words", "en", "s1", "x"),
           (2003, "same words come here now " * 40, "en", "s1", "x"), (None, rows()[5][1], None, "new", "x")]
    df = spark.createDataFrame(rows() + odd + [rows()[7]], "doc_id long, text string, lang string, source string, kept string")
    got = Q.judge(df).collect()
    assert len(got) == 900 + len(odd) + 1
    kept = {r["doc_id"]: r["kept"] for r in got}
    clean = [d for d in range(900) if d % 30 > 1]
    assert sum(kept[d] for d in clean) >= 0.995 * len(clean) and kept[None]
    assert sum(kept[d] for d in range(900) if d % 30 <= 1) <= 2
    assert not any(kept[d] for d in (2000, 2001, 2002, 2003))
    assert all(r["base_failed"] <= (not r["kept"]) for r in got)


def test_each_repeat_statistic_rejects_by_itself(spark):
    rng = random.Random(6)
    lines = ["alpha beta gamma", "delta epsilon", "zeta eta theta iota", "kappa lambda mu"]
    odd = []
    for d in range(20):  # every line after the first 4 repeats; a change of order keeps most windows apart
        text, last = [], None
        fresh = [" ".join(f"w{d}x{i}y{j}" for j in range(5)) for i in range(12)]
        for i in range(24):
            text.append(fresh[i // 2] if i % 2 == 0 else rng.choice([x for x in lines if x != last]))
            last = text[-1]
        odd.append((3000 + d, "\n".join(text), "en", f"s{d % 3}", "x"))
    df = spark.createDataFrame(rows() + odd, "doc_id long, text string, lang string, source string, kept string")
    got = [r for r in Q.judge(df).collect() if r["doc_id"] >= 3000]
    assert len(got) == 20 and not any(r["kept"] for r in got)
    limit = Q.cutoff(Q.NormalDist().inv_cdf(1 - 1e-7))
    assert 1 / Q.FLOOR[3] ** 2 > limit and 0.2 / Q.FLOOR[4] ** 2 > limit


def test_empty_table_and_small_groups(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert Q.judge(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(1, "w " * 9, "en", "s"), (2, " ".join(map(str, range(40))), "en", None)], schema)
    assert {r["doc_id"]: (r["base_failed"], r["kept"]) for r in Q.judge(df).collect()} == {1: (True, False), 2: (False, True)}


def test_query_follows_the_quality_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_mcd_quality"](spark, sf).join(
        spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.1 * len(bad)
