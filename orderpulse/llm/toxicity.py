"""Toxicity by compression distance with separate zstandard dictionaries.

One dictionary is trained on toxic, one on ordinary labelled text. Overlapping
windows of up to ``SPAN`` words (in a fixed carrier, at most ``WINDOW`` bytes) are
compressed with each; the bytes that the toxic dictionary saves, and the share of
the window that they are, measure how much nearer the window is to toxic text. A
document is toxic when one of its windows reaches both calibrated thresholds.

What toxic and ordinary text share tells nothing, so both dictionaries hold the
same ordinary part. The toxic one adds a part trained on the word runs that are
much more frequent in toxic rows (copies of one text are left out of the samples),
the ordinary one as much trained ordinary text. Windows that have nothing of the
toxic part cannot be shortened by it and are not compressed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderpulse.llm.common import held, ship, stage

WINDOW = 48
SHARED_BYTES = 16 * 1024  # of the ordinary part in both dictionaries
OWN_BYTES = 4096  # of the part that differs
SPAN = 3  # words of a window at most
PIECE = 5  # characters of a word that the toxic dictionary can match inside another
_CARRIER = b" the carrier of one window, between fixed neighbours " * 2
_CACHE_WORDS = 150_000
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Model:
    """Dictionaries and thresholds; ``toxic`` is None when nothing could be learned."""

    shared: bytes
    ordinary: bytes
    toxic: bytes | None
    saved: float = 3.0
    share: float = 0.35


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _different(texts: list[str], gram: int = 5, part: int = 8) -> list[str]:
    """The texts without those that mostly repeat earlier ones (copies would count as support).

    Judged by the word runs that start with an eighth of the words (by hash).
    """
    first: dict[str, bool] = {}
    seen: set[int] = set()
    out = []
    for t in texts:
        w = _words(t)
        for x in set(w):
            if x not in first:
                first[x] = zlib.crc32(x.encode()) % part == 0
        grams = {hash(tuple(w[i:i + gram])) for i in range(max(1, len(w) - gram + 1)) if w and first[w[i]]}
        if 2 * len(grams & seen) <= len(grams):
            out.append(t)
        seen |= grams
    return out


def _train(words: list[bytes], size: int) -> bytes:
    """Dictionary content from words: all of them, the most frequent last, when they fit."""
    ranked = [w for w, _ in reversed(Counter(words).most_common())]
    if sum(map(len, ranked)) > size:
        try:
            return zs.train_dictionary(size, words, k=32, d=6).as_bytes()
        except zs.ZstdError:  # too few samples to train on
            pass
    return b"".join(ranked)[-size:]


class Scorer:
    """Windows' savings under a model, remembered per worker."""

    def __init__(self, model: Model):
        self.model = model
        self.hot: dict[str, bool] = {}
        self.known: dict[bytes, tuple[int, float]] = {}
        if model.toxic is not None:
            self.shared, self.ordinary, self.toxic = (
                self._compressor(d) for d in (model.shared, model.ordinary, model.toxic))
            own = model.toxic[:len(model.toxic) - len(model.shared)].decode(errors="ignore")
            self.words = set(_WORD.findall(own))
            self.pieces = {w[i:i + PIECE] for w in self.words for i in range(len(w) - PIECE + 1)}

    @staticmethod
    def _compressor(content: bytes) -> zs.ZstdCompressor:
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        params = zs.ZstdCompressionParameters(
            window_log=17, hash_log=17, chain_log=17, search_log=7, min_match=3, target_length=256,
            strategy=zs.STRATEGY_BTULTRA, **plain)
        held = zs.ZstdCompressionDict(content + _CARRIER, dict_type=zs.DICT_TYPE_RAWCONTENT)
        return zs.ZstdCompressor(dict_data=held, compression_params=params)

    def may_match(self, word: str) -> bool:
        """Has the toxic dictionary's own part anything of the word? Windows without such
        a word are not shortened by it, so they need not be compressed."""
        got = self.hot.get(word)
        if got is None:
            got = word in self.words or any(word[i:i + PIECE] in self.pieces for i in range(len(word) - PIECE + 1))
            if len(word) <= WINDOW:
                if len(self.hot) >= _CACHE_WORDS:
                    self.hot.clear()
                self.hot[word] = got
        return got

    def windows(self, text: str) -> set[bytes]:
        """The windows of up to SPAN words with a word that the toxic dictionary may
        match; they overlap, and a long word is cut into windows of its own."""
        words = _words(text)
        hot = [i for i, w in enumerate(words) if self.may_match(w)]
        out = set()
        for i in hot:
            for n in range(1, SPAN + 1):
                for lo in range(max(0, i - n + 1), min(i, len(words) - n) + 1):
                    raw = " ".join(words[lo:lo + n]).encode()
                    if n == 1 or len(raw) <= WINDOW:
                        out.update(raw[at:at + WINDOW] for at in range(0, len(raw), WINDOW // 2)
                                   if at == 0 or len(raw) - at > WINDOW // 2)
        return out

    def saving(self, window: bytes) -> tuple[int, float]:
        """Bytes saved by the toxic dictionary, and as a share of the window."""
        got = self.known.get(window)
        if got is None:
            part = _CARRIER + window + b" "
            toxic = len(self.toxic.compress(part))
            saved = len(self.ordinary.compress(part)) - toxic
            if saved > 1:  # an unlucky parse with one ordinary dictionary is no saving
                saved = min(saved, len(self.shared.compress(part)) - toxic)
            got = saved, saved / (len(window) + 2)
            if len(self.known) >= _CACHE_WORDS:
                self.known.clear()
            self.known[window] = got
        return got

    def score(self, text: str) -> float:
        if self.model.toxic is None:
            return 0.0
        each = [max(0.0, min(saved / self.model.saved, share / self.model.share))
                for saved, share in map(self.saving, self.windows(text))]
        top = max(each, default=0.0)
        if top >= 1:
            top *= 1 + 0.25 * np.log(sum(x >= 1 for x in each))
        return float(top / (1 + top))


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[i:i + n]) for n in range(1, SPAN + 1) for i in range(len(words) - n + 1)}


def _marked(toxic: list[str], ordinary: list[str], ratio: float, evidence: float) -> dict[str, int]:
    """Runs of up to SPAN words that toxic texts have ``ratio`` times as often, with the
    texts that have them. Frequencies are compared (log-likelihood ratio of ``evidence``
    or more), so a quotation or a wrong label does not clear a run. A run that hardly
    occurs outside a longer marked one gives way to it; other longer ones that hold a
    marked run say nothing new."""
    enough = evidence / (2 * np.log((len(toxic) + len(ordinary)) / len(toxic)))
    # counted by hash first: only runs that can be frequent enough are held by name
    bucket = lambda g: zlib.crc32(g.encode()) & 0x3FFFFF
    sizes = np.zeros(0x400000, np.int32)
    for t in toxic:
        np.add.at(sizes, np.array([bucket(g) for g in _grams(_words(t))], np.int64), 1)
    have: dict[str, int] = Counter()
    for t in toxic:
        have.update(g for g in _grams(_words(t)) if sizes[bucket(g)] >= enough)
    have = {g: n for g, n in have.items() if n >= enough}
    other: dict[str, int] = Counter()
    for t in ordinary:
        other.update(g for g in _grams(_words(t)) if g in have)
    found: dict[str, int] = {}
    part = len(toxic) / (len(toxic) + len(ordinary))
    for g in sorted(have):
        a, b = have[g], other[g]
        g2 = 2 * (a * np.log(a / ((a + b) * part)) + (b * np.log(b / ((a + b) * (1 - part))) if b else 0.0))
        if a * (len(ordinary) + 1) < ratio * (b + 0.5) * len(toxic) or g2 < evidence:
            continue
        found[g] = a
    inner = {g: [x for x in _grams(g.split(" ")) if x in found and x != g] for g in found}
    explained = {x for g in found for x in inner[g] if found[g] >= 0.9 * found[x]}
    return {g: a for g, a in found.items() if g not in explained and all(x in explained for x in inner[g])}


def fit(rows: list[tuple[str, int]], ratio: float = 8.0, evidence: float = 30.0) -> Model:
    """Train on two thirds of the rows (text, label), choose thresholds on the others.

    Three dictionaries are trained: one on words of the ordinary texts that both
    others end with, one on more of them, and one on the word runs that mark toxic
    texts (``_marked``), each sample as often as it occurs. Of equal thresholds the
    largest are taken.
    """
    part = {y: _different([t for t, z in rows if z == y]) for y in (0, 1)}
    train = {y: t[:max(1, 2 * len(t) // 3)] for y, t in part.items()}
    held = [(t, y) for y in (0, 1) for t in part[y][len(train[y]):]]
    common: Counter[str] = Counter()
    for t in train[0]:
        common.update(set(_words(t)))
    marked = _marked(train[1], train[0], ratio, evidence) if train[0] and train[1] else {}
    rng = np.random.default_rng(7)

    def samples(counts: dict[str, int], top: int) -> list[bytes]:
        out = [f" {w} ".encode() for w in sorted(counts) for _ in range(min(counts[w], top))]
        return [out[i] for i in rng.permutation(len(out))]

    ordinary = samples({w: n for w, n in common.items() if w not in marked}, 50)
    half = len(ordinary) // 2
    shared = _train(ordinary[:half][:200_000], SHARED_BYTES)
    if not marked:
        return Model(shared, shared, None)
    model = Model(shared, _train(ordinary[half:][:200_000], OWN_BYTES) + shared,
                  _train(samples(marked, 1000), OWN_BYTES) + shared)
    if not held:
        return model
    scorer = Scorer(model)
    seen = [({scorer.saving(w) for w in scorer.windows(t)}, y) for t, y in held]
    best = (-1.0, model.saved, model.share)
    for saved in range(2, 11):
        for share in np.arange(0.1, 0.61, 0.05).round(2).tolist():
            hit = [(any(s >= saved and r >= share for s, r in ws), y) for ws, y in seen]
            right = sum(h and y for h, y in hit)
            f1 = 2 * right / max(1, sum(h for h, _ in hit) + sum(y for _, y in hit))
            best = max(best, (f1, float(saved), share))
    return Model(shared, model.ordinary, model.toxic, best[1], best[2])


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int = 3000, ordinary: int = 9000,
                    max_chars: int = 20_000) -> list[tuple[str, int]]:
    """A bounded sample of labelled whole texts (no longer than ``max_chars``), by id hash."""
    labels = labels.where("toxic is not null").select(
        F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic"))
    count = {r["__toxic"]: r["count"] for r in labels.groupBy("__toxic").count().collect()}
    unit = F.xxhash64("__id") / F.lit(2.0**64) + 0.5
    chosen = stage(labels.where(
        unit < F.when(F.col("__toxic") == 1, toxic / max(1, count.get(1, 0)))
        .when(F.col("__toxic") == 0, ordinary / max(1, count.get(0, 0)))), "toxic-sample")
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("__id")).where(
        F.col("text").isNotNull() & (F.length("text") <= max_chars)).select("text", "__toxic", "__id").collect()
    rows.sort(key=lambda r: (hash_order(r["__id"]), r["text"]))
    return [(r["text"], r["__toxic"]) for r in rows]


def hash_order(i: int) -> int:
    return (i * 0x9E3779B97F4A7C15 + 0x2545F491) & (2**64 - 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of each whole text.

    Null and empty texts, and all texts under a model that learned nothing, score
    0; an empty table gives an empty table; texts of any length are scored
    whole, their best window counts. Rows are independent, so repeated rows get equal scores; all columns are
    kept, except those named ``score`` or ``predicted``, which are replaced.
    """
    ship(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = held("toxicity")
        if model not in scorers:
            scorers.clear()
            scorers[model] = Scorer(model)
        scorer = scorers[model]
        for b in batches:
            got = [scorer.score(t.as_py() or "") for t in b.column(text_at)]
            cols = [b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())],
                [*names, "score", "predicted"])

    kept = docs.select(*names)
    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
