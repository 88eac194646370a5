"""Compression-distance toxicity: held-out accuracy and the defined edge cases."""

import random

from orderpulse.llm import toxicity as T

INSULTS = ["blargface", "snotwaffle", "gruntpig", "fizzlebrain"]


def rows(seed, n):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    out = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        y = int(i % 5 == 0)
        for _ in range(y * rng.randint(1, 4)):
            w.insert(rng.randrange(len(w)), rng.choice(INSULTS).upper() + rng.choice(["", "!", ","]))
        out.append((" ".join(w), y))
    return out


def test_held_out_documents(spark):
    data = rows(1, 1500)
    model = T.fit(data[:1000])
    docs = [(i, t, "x", 9.0) for i, (t, _) in enumerate(data[1000:])] + [(9000, None, "x", 9.0), (9001, "", None, 9.0)]
    got = {r["doc_id"]: r for r in T.score(
        spark.createDataFrame(docs, "doc_id long, text string, saved string, score double"), model).collect()}
    truth = {i: y for i, (_, y) in enumerate(data[1000:])}
    wrong = sum(got[i]["predicted"] != y for i, y in truth.items())
    assert wrong <= 0.02 * len(truth)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert got[9000]["predicted"] == got[9001]["predicted"] == 0 and got[9000]["saved"] == "x"


def test_nothing_to_learn(spark):
    model = T.fit([("plain text", 0), ("more plain text", 0)])
    df = spark.createDataFrame([(1, "anything")], "doc_id long, text string")
    assert [tuple(r) for r in T.score(df, model).collect()] == [(1, "anything", 0.0, 0)]
    assert T.fit([]).toxic is None


def test_labelled_sample_skips_null_labels_and_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 1), (3, 0, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert T.labelled_sample(docs, labels) == [("a b", 1)]


def caught(model, data):
    s = T.Scorer(model)
    hits = [(s.score(t) >= 0.5, y) for t, y in data]
    return (sum(h for h, y in hits if y) / sum(y for _, y in hits), sum(h for h, y in hits if not y))


def test_a_quotation_or_a_wrong_label_costs_no_word():
    data = rows(2, 1500)
    train = data[:1000]
    quoting = [i for i, (_, y) in enumerate(train) if not y][::100]
    for i in quoting:  # one ordinary row in a hundred names all of them
        train[i] = (train[i][0] + " " + " ".join(INSULTS), 0)
    share, wrong = caught(T.fit(train), data[1000:])
    assert share >= 0.9 and wrong <= 4


def test_a_phrase_of_ordinary_words():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    data = []
    for i in range(1500):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        for x in vocab[:3]:
            w.insert(rng.randrange(len(w)), x)  # every row has the words, toxic ones in a row
        if i % 5 == 0:
            at = rng.randrange(len(w))
            w[at:at] = vocab[:3]
        data.append((" ".join(w), int(i % 5 == 0)))
    share, wrong = caught(T.fit(data[:1000]), data[1000:])
    # an ordinary row with two of the three words side by side may be taken for it
    assert share >= 0.9 and wrong <= 0.03 * 400


def test_windows_that_are_not_compressed_would_not_change_the_verdict():
    data = rows(3, 900)
    model = T.fit(data[:800])
    s = T.Scorer(model)
    for text, _ in data[800:]:
        words = T._words(text)
        every = {" ".join(words[i:i + n]).encode() for n in range(1, T.SPAN + 1) for i in range(len(words) - n + 1)}
        best = max(min(saved / model.saved, share / model.share)
                   for saved, share in (s.saving(w) for w in every if len(w) <= T.WINDOW))
        assert (best >= 1) == (s.score(text) >= 0.5)


def test_empty_table_repeated_rows_and_a_very_long_text(spark):
    data = rows(1, 600)
    model = T.fit(data)
    none = spark.createDataFrame([], "doc_id long, text string, predicted string")
    assert T.score(none, model).collect() == [] and T.score(none, model).columns == ["doc_id", "text", "score", "predicted"]
    long = " ".join(t for t, y in data if not y) * 20
    docs = [(1, data[0][0]), (1, data[0][0]), (None, data[0][0]), (2, long), (3, long + " " + INSULTS[0]), (4, "x" * 300_000)]
    got = T.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()
    assert sorted((r["doc_id"] or 0, r["predicted"]) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 1), (4, 0)]
    assert len({r["score"] for r in got if r["doc_id"] in (None, 1)}) == 1
