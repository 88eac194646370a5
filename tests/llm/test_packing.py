"""Packing: every id once, gapless sequences, little padding; ids equal the tokenizer's."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from orderpulse.llm import packing as P

FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a  b", "É'S don't I'LL <|endoftext|> x y　z é ́a 12 3 ½ İstanbul ΣΑΣ a\tb\nc..",
       "\x1c a\x85b ", "ﬁ ŉ 👍🏽 नमस्ते 中文 字", "x" * 9000, "!!!... --- \n\n\n", "½²ªºµ"]


def reference():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_ids_equal_the_tokenizer():
    rng = random.Random(2)
    with open(FILE, "rb") as f:
        mine = P.WordTokenizer(f.read())
    ids = reference()
    alphabet = "aab EéñÑß  \n\t\x85\x1c 　.,'sStT1²中ß-_İΣ"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    for t in texts:
        assert np.frombuffer(mine.ids(t), "<u4").tolist() == ids(t), repr(t)


def test_pieces_cover_documents_and_sequences(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma,", "d."]) for _ in range(rng.choice([0, 3, 50, 700, 5000])))
             for _ in range(150)] + ODD + [None]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = P.pack(df.repartition(3), FILE).collect()
    ids, pieces, seqs = reference(), defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert set(pieces) == {r[0] for r in rows}
    for d, t, _ in rows:
        want, at = ids(t or "") + [1], 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            part = want[at:at + r["length"]]
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    padding = 0
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_small_window_and_few_open_windows():
    p = P.LevelPacker(8, 3, 0)
    rng = random.Random(1)
    total = 0
    for d in range(300):
        n = rng.choice([1, 5, 5, 5, 6, 7, 8, 9, 23])
        total += n
        p.add(d, bytes(4 * n))
        assert p.n_open <= 3
    p.empty()
    assert sum(x[2] for x in p.done) == total and p.n_open == 0


def test_sum_of_squares_choice():
    p = P.LevelPacker(10, 100, 0)
    p.add(0, bytes(4 * 4))
    p.add(1, bytes(4 * 6))  # completes the open window of level 4
    assert p.n_open == 0 and [x[2] for x in p.done] == [4, 6]
    for d, n in enumerate([7, 7, 7]):
        p.add(10 + d, bytes(4 * n))
    assert p.count[7] == 3
    p.add(20, bytes(4 * 2))  # leaving the crowded level 7 costs less than a new level 2
    assert p.count[7] == 2 and p.count[9] == 1


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), FILE).collect() == []


def brute_levels(sizes, window, most):
    """Fill levels after each piece, by the sum of squares of every choice; the cuts made."""
    count, out, cuts = [0] * (window + 1), [], 0
    total = lambda c: sum(x * x for x in c[1:window])
    for size in sizes:
        best = None
        for cut in (False, True):
            for h in range(window):
                if (h and not count[h]) or (cut and (not h or h + size <= window)) or (not cut and h + size > window):
                    continue
                if sum(count[1:window]) >= most and not h or sum(count[1:window]) < most and cut:
                    continue
                c = list(count)
                c[h] -= 1 if h else 0
                c[h + size - (window if cut else 0)] += 1
                if best is None or total(c) < best[0]:
                    best = (total(c), c, cut)
        count = best[1]
        count[window] = 0
        cuts += best[2]
        out.append(list(count[1:window]))
    return out, cuts


def test_every_choice_has_the_least_sum_of_squares():
    rng = random.Random(6)
    sizes = [rng.choice([1, 2, 3, 5, 7, 11, 12, 13]) for _ in range(500)]
    want, cuts = brute_levels(sizes, 14, 6)
    p, got = P.LevelPacker(14, 6, 0), []
    for d, n in enumerate(sizes):
        p.add(d, bytes(4 * n))
        got.append(p.count[1:14].tolist())
    assert got == want and cuts > 10


def test_most_windows_are_closed_by_the_choice():
    rng = random.Random(8)
    p = P.LevelPacker(2048, 256, 0)
    for d in range(10_000):
        p.add(d, bytes(4 * min(20_000, int(rng.lognormvariate(5.5, 1.2)) + 1)))
    before = p.next_id
    by_choice = len({x[5] for x in p.done if x[2] < 2048})
    p.empty()
    after = p.next_id - before
    assert by_choice > 0.9 * (by_choice + after)
    tokens = sum(x[2] for x in p.done)
    assert 2048 * p.next_id - tokens < 0.005 * tokens  # only the last rests, at powers of two, are shorter
