"""Substring deduplication by seed and extend.

A window is ``min_words`` consecutive words of a text. Every window whose word
sequence also starts earlier (in a document with a smaller id, or earlier in the
same document) is a repeat, and each word that a repeat covers is removed.

Seeds: winnowing keeps the smallest hash of every ``min_words - GRAM + 1``
neighbouring 8-word grams, so equal windows hold an equal anchor at the same
place. Only anchors that occur twice (``seeds``) go on.

Extension, both ways, by content instead of by pairs:

1. The neighbourhood of an anchor is all the words that windows around it can
   reach. An anchor whose whole neighbourhood occurs earlier lies inside a longer
   repeat, and all its windows are repeats. This resolves copies and passages.
2. The other seeds (first of their neighbourhood, or alone in it) lie at the
   edge of a repeat or are its first occurrence. Their windows are compared one
   by one. The earliest occurrence of any window is always among them.

Overlapping repeats are then merged into maximal ones. Everything is grouped by
hash with partial aggregates (count, least position) and joined back, so neither
a hot passage nor a group of copies meets in one task, and no pair of
occurrences is ever listed.

Hashes have 64 bits; grouping also compares a second, 32-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import Words, _powers, held, mix, slices, stage, text_buffer

GRAM = 8
_SEED2 = 0x8F1BBCDCCA62C1D7
_SPAN = 0xC2B2AE3D27D4EB4F | 1
_SPAN_INV = pow(_SPAN, -1, 1 << 64)
_ROW = np.uint64(0xD6E8FEB86659FD93)


def _slide(a: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) over ``size`` values from each position on; tails shrink."""
    out, span = a.copy(), 1
    while span < size:
        step = min(span, size - span)
        out[:-step] = best(out[:-step], out[step:]) if step < len(out) else out[:-step]
        span += step
    return out


class Seeds:
    """Anchors and windows of a slice of texts."""

    def __init__(self, col: pa.Array, min_words: int):
        self.size = min_words
        self.words = w = Words(*text_buffer(col))
        n = len(w.hash)
        self.row = np.repeat(np.arange(len(w.n_words)), w.n_words)
        self.first = np.repeat(w.row0[:-1], w.n_words)  # first word of the same text
        self.end = np.repeat(w.row0[1:], w.n_words)
        if not n:
            self.anchors = np.zeros(0, np.int64)
            return
        gram, valid = w.grams(GRAM)
        gram = np.where(valid, gram, np.uint64(2**64 - 1))
        reach = min_words - GRAM + 1
        at = np.arange(n)
        window = at + min_words <= self.end
        least = np.where(window, _slide(gram, reach, np.minimum), np.uint64(0))
        # a gram is an anchor when it is the least of one of the windows that hold it
        # (a window of another text ends before the gram, so it never holds it)
        back = np.concatenate([np.zeros(reach - 1, np.uint64), least])
        best = _slide(back, reach, np.maximum)[:n]
        self.anchors = np.flatnonzero(valid & (best == gram) & (self.end - self.first >= min_words))
        self.gram = gram

    def hoods(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, 32-bit hash) of the words that windows around an anchor can reach."""
        w, far = self.words.hash, self.size - GRAM
        lo = np.maximum(anchors - far, self.first[anchors])
        hi = np.minimum(anchors + self.size, self.end[anchors])
        shape = ((anchors - lo) * 4096 + hi - anchors).astype(np.uint64)
        out = []
        for word in (w, mix(w ^ np.uint64(_SEED2))):
            pref = np.zeros(len(w) + 1, np.uint64)
            np.cumsum(word * _powers(_SPAN, len(w)), out=pref[1:])
            out.append(mix((pref[hi] - pref[lo]) * _powers(_SPAN_INV, len(w) + 1)[lo] + mix(shape)))
        return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, 32-bit hash, valid) of the window at each word."""
        a, valid = self.words.grams(self.size)
        b, _ = self.words.grams(self.size, _SEED2)
        return a, (b >> np.uint64(32)).astype(np.uint32), valid

    def first_in_text(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mask of the positions whose key does not occur earlier in the same text."""
        key = key + self.row[at].astype(np.uint64) * _ROW
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        out = np.empty(len(key), bool)
        out[order] = new
        return out


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.view(np.int32))


def _ids(col: pa.Array) -> np.ndarray:
    """Ids as an array; null ids rank last."""
    return col.fill_null(2**63 - 1).to_numpy(zero_copy_only=False)


def anchors(docs: DataFrame, min_words: int) -> DataFrame:
    """(gram, hood, hood2, doc, pos): the first anchor of each neighbourhood in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("sets")
        for b in slices(batches):
            s = Seeds(b.column(1), min_words)
            hood, hood2 = s.hoods(s.anchors)
            new = s.first_in_text(hood, s.anchors)
            at = s.anchors[new]
            yield pa.RecordBatch.from_arrays(
                [_signed(s.gram[at]) if len(at) else pa.array([], pa.int64()),
                 _signed(hood[new]), _signed(hood2[new]), pa.array(_ids(b.column(0))[s.row[at]]),
                 pa.array((at - s.first[at]).astype(np.int32))],
                ["gram", "hood", "hood2", "doc", "pos"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "gram long, hood long, hood2 int, doc long, pos int")


def edge_windows(marked: DataFrame, min_words: int) -> DataFrame:
    """(win, win2, doc, pos): the windows around the ``edge`` anchors of each text, first ones only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("sets")
        for b in slices(batches):
            s = Seeds(b.column(1), min_words)
            win, win2, valid = s.windows()
            near = _around(s, _listed(s, b.column(2))[0]) & valid
            at = np.flatnonzero(near)
            at = at[s.first_in_text(win[at], at)]
            yield pa.RecordBatch.from_arrays(
                [_signed(win[at]), _signed(win2[at]), pa.array(_ids(b.column(0))[s.row[at]]),
                 pa.array((at - s.first[at]).astype(np.int32))], ["win", "win2", "doc", "pos"])

    return marked.select("doc_id", "text", "edge").mapInArrow(
        run, "win long, win2 int, doc long, pos int")


def _listed(s: Seeds, positions: pa.Array, values: pa.Array | None = None) -> tuple:
    """(word indices, values) of columns of lists; positions beyond the text are left out."""
    sizes = np.nan_to_num(pc.list_value_length(positions).to_numpy(zero_copy_only=False)).astype(np.int64)
    row = np.repeat(np.arange(len(positions)), sizes)
    pos = positions.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    here = pos < s.words.n_words[row]
    at = s.words.row0[:-1][row[here]] + pos[here]
    return at, None if values is None else values.flatten().to_numpy(zero_copy_only=False)[here]


def _around(s: Seeds, at: np.ndarray) -> np.ndarray:
    """Mask of the window starts whose window holds one of the anchors, inside the same text."""
    cover = np.zeros(len(s.row) + 1, np.int64)
    if len(at):
        np.add.at(cover, np.maximum(at - (s.size - GRAM), s.first[at]), 1)
        np.add.at(cover, at + 1, -1)
    return np.cumsum(cover)[:-1] > 0


def removed_words(s: Seeds, inside: pa.Array, hood2: pa.Array, repeats: pa.Array,
                  win: pa.Array) -> np.ndarray:
    """Mask of the words covered by repeated windows.

    ``inside``: anchors whose whole neighbourhood (hash ``hood2``) occurs earlier.
    ``repeats``: single windows (hash ``win``) that occur earlier. The hashes tell
    apart texts that share an id.
    """
    size, n = s.size, len(s.row)
    hashes, _, valid = s.windows()
    at, want = _listed(s, inside, hood2)
    if len(at):
        at = at[s.hoods(at)[1].view(np.int32) == want]
    dup = _around(s, at) & valid
    at = np.flatnonzero(valid)
    dup[at[~s.first_in_text(hashes[at], at)]] = True
    at, want = _listed(s, repeats, win)
    dup[at[hashes[at].view(np.int64) == want]] = True
    cover = np.zeros(n + size + 1, np.int64)
    starts = np.flatnonzero(dup)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + size, -1)
    return np.cumsum(cover)[:n] > 0


def _earlier(rows: DataFrame, key: list[str], extra: list[Column]) -> DataFrame:
    """``rows`` with ``first``: whether no equal key has a smaller (doc, pos)."""
    least = rows.groupBy(*key).agg(F.min(F.struct("doc", "pos")).alias("least"),
                                   F.count(F.lit(1)).alias("n"))
    least = least.where("n > 1").select(*key, "least")
    return rows.join(least, key, "left").select(
        "doc", "pos", *extra,
        F.coalesce((F.col("least.doc") == F.col("doc")) & (F.col("least.pos") == F.col("pos")),
                   F.lit(True)).alias("first"))


def repeats(docs: DataFrame, min_words: int) -> DataFrame:
    """``docs`` with the arguments of ``removed_words`` as ``__inside`` .. ``__win``."""
    found = anchors(docs, min_words)
    seeds = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    seeds = stage(found.join(stage(seeds, "seed-grams"), "gram").select("hood", "hood2", "doc", "pos"), "seeds")
    judged = _earlier(seeds, ["hood", "hood2"], [F.col("hood2")])
    lists = stage(judged.groupBy("doc").agg(
        F.collect_list(F.when(F.col("first"), F.col("pos"))).alias("edge"),
        F.collect_list(F.when(~F.col("first"), F.struct("pos", "hood2"))).alias("inside")), "seed-lists")
    key = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    edges = lists.where(F.size("edge") > 0).select("doc", "edge")
    marked = docs.join(edges, key == edges["doc"]).select("doc_id", "text", "edge")
    windows = stage(edge_windows(marked, min_words), "edge-windows")
    late = _earlier(windows, ["win", "win2"], [F.col("win")]).where(~F.col("first"))
    late = late.groupBy("doc").agg(F.collect_list(F.struct("pos", "win")).alias("late"))
    inside = lists.where(F.size("inside") > 0).select("doc", "inside")
    marks = stage(inside.join(late, "doc", "full").select(
        F.col("doc").alias("__mark"),
        F.col("inside.pos").alias("__inside"), F.col("inside.hood2").alias("__hood2"),
        F.col("late.pos").alias("__repeats"), F.col("late.win").alias("__win")), "repeats")
    return docs.join(marks, key == marks["__mark"], "left").drop("__mark")


MARKS = ["__inside", "__hood2", "__repeats", "__win"]
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _kept(s: Seeds, gone: np.ndarray, i: int) -> bytes:
    """The kept words of row ``i``, one blank between."""
    lo, hi = s.words.row0[i], s.words.row0[i + 1]
    words = s.words.raw[s.words.offs[i]:s.words.offs[i + 1]].tobytes().split()
    return b" ".join(compress(words, (~gone[lo:hi]).tolist()) if gone[lo:hi].any() else words)


def kept_digest(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """Words, removed words and the digest of the kept words (one blank between) per row.

    Words are compared unchanged. Null and empty texts have no words; an empty
    table gives an empty table; other columns are ignored. Rows with one id are
    one document: equal rows keep the same words, and windows of different texts
    with one id rank by their place. Null ids rank last, as one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("sets")
        for b in slices(batches):
            s = Seeds(b.column(1), min_words)
            gone = removed_words(s, *(b.column(i) for i in range(2, 6)))
            removed = np.diff(np.concatenate([[0], np.cumsum(gone, dtype=np.int64)])[s.words.row0])
            sha = [hashlib.sha256(_kept(s, gone, i)).hexdigest() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s.words.n_words.astype(np.int64)), pa.array(removed),
                 pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    found = repeats(docs.select("doc_id", "text"), min_words)
    return found.select("doc_id", "text", *MARKS).mapInArrow(run, RESULT)


def dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with repeated words removed from ``text``; a column ``n_chars`` follows.

    A text that loses words keeps its other words, one blank between them; a row
    that loses all of them is dropped. Other rows stay as they are, nulls and
    empty texts included, with all their columns, whatever their names. Texts of any
    length are compared whole, rows that repeat an id and text lose nothing to each
    other, and an empty table gives an empty table.
    """
    names, schema = docs.columns, docs.schema
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else None
    own = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)]  # no clash with the marks
    docs = docs.toDF(*own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("sets")
        for b in slices(batches):
            s = Seeds(b.column(text_at), min_words)
            marks = [b.column(b.schema.get_field_index(c)) for c in MARKS]
            gone = removed_words(s, *marks)
            removed = np.diff(np.concatenate([[0], np.cumsum(gone, dtype=np.int64)])[s.words.row0])
            cols = [b.column(i) for i in range(len(names))]
            if removed.any():
                texts, changed = cols[text_at].to_pylist(), np.flatnonzero(removed)
                for i in changed:
                    texts[i] = _kept(s, gone, i).decode()
                cols[text_at] = pa.array(texts, cols[text_at].type)
                if chars_at is not None:
                    chars = cols[chars_at].to_pylist()
                    for i in changed:
                        chars[i] = len(texts[i])
                    cols[chars_at] = pa.array(chars, cols[chars_at].type)
            out = pa.RecordBatch.from_arrays(cols, names)
            yield out.filter(pa.array((removed == 0) | (removed < s.words.n_words)))

    return repeats(docs, min_words).select(*own, *MARKS).mapInArrow(run, schema)
