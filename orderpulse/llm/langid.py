"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed
greedily against each automaton: from every phrase start the longest stretch
that occurs in the labelled text is one phrase. The language whose text explains
the input with the fewest phrases, normalised by length, wins.

Texts are compared as lower-case letters; every other run is one blank. Parsing
restarts every ``LANE`` characters, so all lanes of a batch advance together as
array steps, in all languages at once: at most one phrase per lane more than a
parse without restarts, the same for every language.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import held, ship

PREDICTED = "doc_id long, lang_pred string, score double"
UNKNOWN = "und"
LANE = 256  # characters of a lane
ALPHABET = 64  # symbols: blank, the most frequent letters, 12 shared codes for the others
_SHARED = 12
_STEP_CHARS = 2_000_000  # characters handled by one vectorised step


def sample_text(docs: DataFrame, per_language: int = 400, chars: int = 40_000,
                total_chars: int = 400_000) -> dict[str, str]:
    """Bounded labelled text per language, from the rows of ``docs``.

    About ``per_language`` rows of each language with the smallest id hashes
    give whole texts until ``chars`` (or an even part of ``total_chars``, when
    there are many languages) are reached; the last text is cut there.
    """
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    chars = max(1000, min(chars, total_chars // len(counts)))
    share = F.create_map(*(F.lit(x) for lang, n in counts.items()
                           for x in (lang, min(1.0, per_language / n))))
    unit = F.col("h") / F.lit(2.0**64) + 0.5
    # no text longer than a quarter of the bound, unless the language has no other
    rows = docs.where(unit <= share[F.col("lang")]).select(
        "lang", "h", F.substring("text", 1, chars).alias("text")).collect()
    out: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (len(r["text"]) > chars // 4, r["h"], r["text"])):
        have = out.get(r["lang"], "")
        if len(have) < chars:
            out[r["lang"]] = have + r["text"][:chars - len(have)] + "\n"
    return {k: out[k] for k in sorted(out)}


class Codes:
    """Characters to symbols: 0 blank, then letters by frequency, then shared codes."""

    def __init__(self, texts: list[str]):
        own = ALPHABET - 1 - _SHARED
        seen = Counter(c for t in texts for c in t.lower() if c.isalpha())
        ranked = sorted(seen, key=lambda c: (-seen[c], c))[:own]
        point = np.arange(0x110000)
        self.of = (ALPHABET - _SHARED + point % _SHARED).astype(np.uint8)
        self.of[~np.array([chr(i).isalpha() for i in point.tolist()])] = 0
        for i, c in enumerate(ranked):
            self.of[ord(c)] = i + 1

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a text, with runs of blanks as one and none at the ends."""
        got = self.of[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        keep = got != 0
        keep[1:] |= got[:-1] != 0
        got = got[keep]
        return got[:-1] if len(got) and got[-1] == 0 else got


def suffix_automaton(symbols: np.ndarray) -> np.ndarray:
    """Transitions [state, symbol] of the suffix automaton; -1 where there is none."""
    n = len(symbols)
    step = np.full((2 * n + 2, ALPHABET), -1, np.int32)
    nxt: list[dict[int, int]] = [{} for _ in range(2 * n + 2)]
    length, link, size, last = [0] * (2 * n + 2), [-1] * (2 * n + 2), 1, 0
    for c in symbols.tolist():
        cur = size
        size += 1
        length[cur] = length[last] + 1
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = size
                size += 1
                length[clone] = length[p] + 1
                nxt[clone] = dict(nxt[q])
                link[clone] = link[q]
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    for s in range(size):
        for c, t in nxt[s].items():
            step[s, c] = t
    return step[:size]


class CrossParser:
    """Automata of all languages as one table of moves."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.codes = Codes([samples[k] for k in self.langs])
        tables, at, self.idle = [], 0, []
        for lang in self.langs:
            step = suffix_automaton(self.codes.encode(samples[lang]))
            idle = at + len(step)  # between phrases: every symbol starts one
            # a move that fails ends the phrase, and the symbol starts the next one; a
            # symbol the language never shows is a phrase by itself
            start = (np.where(step[0] >= 0, step[0] + at, idle) + (1 << 30)).astype(np.int32)
            tables += [np.where(step >= 0, step + at, start[None, :]).astype(np.int32), start[None, :]]
            self.idle.append(idle)
            at = idle + 1
        self.moves = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases per text and language."""
        k = len(self.langs)
        lanes = [t[i:i + LANE] for t in texts for i in range(0, len(t), LANE)]
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // LANE) for t in texts])
        if not lanes:
            return np.zeros((len(texts), k), np.int64)
        size = np.array([len(x) for x in lanes])
        order = np.argsort(-size, kind="stable")  # lanes that end leave from the back
        grid = np.zeros((LANE, len(lanes)), np.uint8)
        for j, i in enumerate(order):
            grid[:size[i], j] = lanes[i]
        live = np.searchsorted(-size[order], -np.arange(LANE), "left")
        state = np.repeat(np.array(self.idle, np.int32)[:, None], len(lanes), 1)
        count = np.zeros((k, len(lanes)), np.int32)
        for pos in range(LANE):
            n = int(live[pos])
            if not n:
                break
            got = self.moves[state[:, :n] * ALPHABET + grid[pos, :n]]
            count[:, :n] += got >> 30
            state[:, :n] = got & ((1 << 30) - 1)
        out = np.zeros((len(texts), k), np.int64)
        np.add.at(out, owner[order], count.T)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= _STEP_CHARS):
                chars += len(texts[hi])
                hi += 1
            coded = [self.codes.encode(t) for t in texts[lo:hi]]
            for i, (c, n) in enumerate(zip(coded, self.phrases(coded))):
                if len(c) and self.langs:
                    ranked = np.argsort(n, kind="stable")
                    best = int(ranked[0])
                    langs[lo + i] = self.langs[best]
                    second = n[ranked[1]] if len(ranked) > 1 else n[best]
                    scores[lo + i] = float(second / (n[best] + second))
            lo = hi
        return langs, scores


def _parser(samples: dict[str, str]) -> CrossParser:
    """One parser per Python worker and set of samples."""
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    parsers = held("langid")
    if key not in parsers:
        parsers.clear()
        parsers[key] = CrossParser(samples)
    return parsers[key]


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every whole text.

    ``samples`` is labelled text per language (``sample_text``). Null texts and
    texts without a letter are ``und`` with score 0, as is everything when there
    is no sample. The score is the runner-up's share of the phrases of the two
    best languages, from 0.5 (a tie; the first name wins) towards 1. Rows are
    independent: repeated rows and null ids are kept, extra columns ignored.
    """
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shipped.value)
        for b in batches:
            langs, scores = parser.predict([t.as_py() or "" for t in b.column(1)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, PREDICTED)
