"""Tree-reduced BPE against tiktoken, and the round trip."""

import base64
import hashlib
import random
import struct

import public_tokenizers
import tiktoken

from orderpulse.llm import bpe as B

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def both():
    with open(FILE, "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return B.TreeBpe(raw, public_tokenizers.PATTERN), ref


def texts():
    rng = random.Random(3)
    alphabet = "aab eéñ  \n\t\x85\x1c 　.,'sStT1²中文नि👍́-__"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    out += ["a" * 3000, "ab" * 2000, " " * 700, "\n " * 200, "", "The  quick\n brown don't  ", "=-" * 600]
    return out + ["".join(rng.choice("etaoinshr") for _ in range(400)) for _ in range(40)]


def test_ids_equal_tiktoken_and_decode():
    mine, ref = both()
    for t in texts():
        ids = mine.encode(t)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == ref.encode_ordinary(t), repr(t[:60])
        assert mine.decode(ids, leaf=7) == t.encode()


def test_join_is_associative():
    mine, _ = both()
    rng = random.Random(5)
    for _ in range(300):
        a, b, c = ("".join(rng.choice("etaoinsh é") for _ in range(rng.randint(0, 9))).encode() for _ in range(3))
        x, y, z = map(mine.encode_bytes, (a, b, c))
        assert mine.join(mine.join(x, y), z) == mine.join(x, mine.join(y, z)) == mine.encode_bytes(a + b + c)


def test_round_trip_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts()[-60:])] + [(900, None, "x"), (None, "no id", "x"), (1, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    _, ref = both()
    want = sorted(((d, len(ids := ref.encode_ordinary(t or "")), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                    hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in rows), key=str)
    got = B.round_trip(df.repartition(3), FILE, public_tokenizers.PATTERN).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    back = B.decode(B.encode(df, FILE, public_tokenizers.PATTERN), FILE, public_tokenizers.PATTERN).collect()
    assert sorted((tuple(r) for r in back), key=str) == sorted(((d, t or "") for d, t, _ in rows), key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert B.round_trip(df, FILE, public_tokenizers.PATTERN).collect() == []
