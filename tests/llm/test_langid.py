"""Cross-parsing: phrases against a plain greedy parse, held-out accuracy, edge cases."""

import random

from orderpulse.llm import langid as L
from orderpulse.llm.queries import QUERIES

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["sch", "ein", "ung", "ge", "ber"], "cc": ["é", "oui", "eau", "tre", "la"]}


def sentence(lang, rng, words=12):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


def greedy(text, sample):
    """Phrases of a lane: longest stretches of ``sample``, an unseen symbol alone."""
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at = max(at + 1, end - 1)
        n += 1
    return n


def test_phrases_equal_a_greedy_parse():
    rng = random.Random(1)
    samples = {k: " ".join(sentence(k, rng) for _ in range(20)) for k in SYLLABLES}
    p = L.CrossParser(samples)
    texts = [sentence(rng.choice("abc") * 2, rng, rng.randint(1, 90)) + rng.choice(["", " zzz 中"]) for _ in range(60)]
    coded = [p.codes.encode(t) for t in texts]
    own = {k: p.codes.encode(samples[k]).tobytes() for k in p.langs}
    got = p.phrases(coded)
    for c, row in zip(coded, got):
        lanes = [c[i:i + L.LANE].tobytes() for i in range(0, len(c), L.LANE)]
        assert row.tolist() == [sum(greedy(x, own[k]) for x in lanes) for k in p.langs]


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(2)
    rows = [(i, sentence(k := rng.choice(list(SYLLABLES)), rng, rng.randint(4, 80)), k, "s") for i in range(600)]
    rows += [(900, None, "aa", "s"), (901, "", None, "s"), (902, "12 !? 3", "bb", "s"), (None, "ka lo mi", None, "s"),
             (903, "ka lo mi tu " * 4000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    samples = L.sample_text(df.where("doc_id % 3 <> 1"), chars=4000)
    assert sorted(samples) == ["aa", "bb", "cc"] and all(len(s) <= 4001 for s in samples.values())
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(df, samples).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got.values())
    held = [r for r in rows[:600] if r[0] % 3 == 1]
    assert sum(got[d][0] == k for d, _, k, _ in held) >= 0.98 * len(held)
    assert all(got[i] == ("und", 0.0) for i in (900, 901, 902)) and got[None][0] == got[903][0] == "aa"


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert L.sample_text(df) == {}
    assert [tuple(r) for r in L.identify(df, {}).collect()] == [(1, "und", 0.0)]
    assert L.identify(df.where("false"), {"aa": "x y"}).collect() == []


def test_query_on_held_out_documents(spark):
    got = QUERIES["op2_cross_parsing"](spark, "/root/testdata/sf0.001")
    truth = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 30 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
