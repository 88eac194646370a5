"""The corpus pipeline against brute-force versions of its stages."""

import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest

from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_packing import reference
from tests.llm.test_substring import WORD
from tests.llm.test_toxicity import INSULTS

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=8, n=420):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 8))) for _ in range(1500)]
    say = lambda k: [rng.choice(vocab) for _ in range(k)]
    passages, base, rows, labels = [say(70) for _ in range(4)], [say(150) for _ in range(6)], [], []
    for d in range(n):
        kind = d % 7
        w = say(rng.randint(30, 120))
        if kind == 1:
            w = list(base[rng.randrange(6)])
            w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind == 2:
            w += passages[rng.randrange(4)] + say(20)
        elif kind == 3:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        elif kind == 4:
            w.insert(5, "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16)))
            w.insert(15, f"{vocab[0]}.7@mail{d}.example.com")
        rows.append((d, " ".join(w), "en", f"s{d % 3}", 0))
        labels.append((d, 1, int(kind == 3)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", None, 0), rows[0]]
    return [(d, t, a, b, None if t is None else len(t)) for d, t, a, b, _ in rows], labels


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows, labels = corpus()
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, sf_dir)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = docs.collect()
    rows, labels = corpus()
    toxic = {d for d, _, y in labels if y}
    first = kept["toxicity"]
    assert {r["doc_id"] for r in first} == {r[0] for r in rows} - toxic

    # one document of each group of near copies, the least id
    parts = [(r["doc_id"], r["text"]) for r in first]
    want = {d for d, _, c in brute_components(parts, 5, 8, 10) if d == c}
    second = kept["ngram_jaccard_join"]
    assert sorted(r["doc_id"] for r in second) == sorted(want)

    # words of 50-word windows that start earlier elsewhere are gone
    words = {r["doc_id"]: WORD.findall(r["text"] or "") for r in second}
    begin = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            begin.setdefault(tuple(words[d][i:i + 50]), (d, i))
    left = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - 49) if begin[tuple(w[i:i + 50])] < (d, i) for j in range(i, i + 50)}
        if not gone or len(gone) < len(w):
            left[d] = [x for j, x in enumerate(w) if j not in gone]
    third = {r["doc_id"]: r for r in kept["substring_dedup"]}
    assert {d: WORD.findall(r["text"] or "") for d, r in third.items()} == left
    assert all(r["n_chars"] is None if r["text"] is None else r["n_chars"] == len(r["text"]) for r in third.values())
    assert any(len(left[d]) < len(words[d]) for d in left)

    # keys are masked, addresses stay
    fourth = {r["doc_id"]: r for r in kept["secret_scan"]}
    for d, r in third.items():
        new = [("[SECRET]" if w.startswith("AKIA") else w) for w in (r["text"] or "").split(" ")]
        assert (fourth[d]["text"] or "") == " ".join(new)

    # every id of every document once
    ids, pieces = reference(), defaultdict(list)
    for r in kept["packing"]:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    assert set(pieces) == set(fourth)
    for d, r in fourth.items():
        n, at = len(ids(r["text"] or "")) + 1, 0
        for start, length, total in sorted(pieces[d]):
            assert start == at and total == n
            at += length
        assert at == n


def test_run_and_empty_table(spark, sf_dir, tmp_path):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and np.isin(["doc_id", "sequence_id", "offset"], got.columns).all()
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
