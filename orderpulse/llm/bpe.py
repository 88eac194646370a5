"""Byte-level BPE by monoid tree reduction.

The encodings of byte strings form a monoid: the identity is the empty list, and
two neighbours are joined by re-encoding a window at their border. A piece (one
match of the split pattern) is encoded by halves, recursively.

Why the join is exact: rank-ordered BPE with leftmost ties yields the list
``t1 .. tn`` if and only if every adjacent pair ``ti ti+1`` encodes to itself
(inside the pair, and inside the whole, the same merges are open in the same
order until the first one that crosses a border). So the window's first token
may stay next to the untouched tokens on its left when re-encoding did not
change it, and likewise its last token on the right. Otherwise the window grows.

Decoding concatenates the tokens' bytes up a tree of halves.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from orderpulse.llm.common import held, ship

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_CACHE_ENTRIES = 400_000
_NONE = 1 << 62  # rank of a pair that is no token
_GAP = re.compile(r"\s ")  # a blank after white space is no place to cut
_SHORT = 48  # bytes: longer pieces and halves are not remembered


class TreeBpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, file: bytes, pattern: str):
        pairs = (line.split() for line in file.splitlines() if line)
        self.rank = {base64.b64decode(tok): int(rank) for tok, rank in pairs}
        self.token = {rank: tok for tok, rank in self.rank.items()}
        self.pattern = regex.compile(pattern)
        self.halves: dict[bytes, list[int]] = {}
        self.windows: dict[bytes, list[int]] = {}
        self.chunks: dict[str, bytes] = {}  # ids of a blank and the chunk

    def _window(self, raw: bytes) -> list[int]:
        """Plain rank-ordered merges on the few bytes of a border window."""
        got = self.windows.get(raw)
        if got is not None:
            return got
        rank, parts = self.rank, [raw[i:i + 1] for i in range(len(raw))]
        pair = [rank.get(raw[i:i + 2], _NONE) for i in range(len(raw) - 1)]
        while pair and (best := min(pair)) < _NONE:
            at = pair.index(best)
            parts[at] += parts.pop(at + 1)
            del pair[at]
            if at:
                pair[at - 1] = rank.get(parts[at - 1] + parts[at], _NONE)
            if at < len(pair):
                pair[at] = rank.get(parts[at] + parts[at + 1], _NONE)
        got = [rank[p] for p in parts]
        if len(raw) <= _SHORT:
            if len(self.windows) >= _CACHE_ENTRIES:
                self.windows.clear()
            self.windows[raw] = got
        return got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's product: the encoding of both byte strings together."""
        if not left or not right:
            return left or right
        token, k = self.token, 1
        while True:
            a, b = left[-k:], right[:k]
            now = self._window(b"".join([token[t] for t in a]) + b"".join([token[t] for t in b]))
            if (k >= len(left) or now[0] == a[0]) and (k >= len(right) or now[-1] == b[-1]):
                return left[:-k] + now + right[k:]
            k += 1 if k < 4 else k

    def encode_bytes(self, raw: bytes) -> list[int]:
        """Encode by halves."""
        if len(raw) < 2:
            return [self.rank[raw]] if raw else []
        got = self.halves.get(raw)
        if got is None:
            mid = len(raw) // 2
            got = self.join(self.encode_bytes(raw[:mid]), self.encode_bytes(raw[mid:]))
            if len(raw) <= _SHORT:
                if len(self.halves) >= _CACHE_ENTRIES:
                    self.halves.clear()
                self.halves[raw] = got
        return got

    def encode_piece(self, piece: str) -> list[int]:
        """A piece that is itself a token is that token, before any merge."""
        raw = piece.encode()
        whole = self.rank.get(raw)
        return self.encode_bytes(raw) if whole is None else [whole]

    def _chunk(self, chunk: str) -> bytes:
        ids = [t for piece in self.pattern.findall(chunk) for t in self.encode_piece(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers.

        The text is cut before every blank that follows a non-space character.
        No match of the split pattern spans such a place and none looks back, so
        the matches of the chunks are the matches of the text.
        """
        parts, known = text.split(" "), self.chunks
        if _GAP.search(text):
            whole, parts = parts, parts[:1]
            for part in whole[1:]:
                if not parts[-1] or parts[-1][-1].isspace():
                    parts[-1] = f"{parts[-1]} {part}"
                else:
                    parts.append(part)
        out = [self._chunk(parts[0])]
        for part in parts[1:]:
            got = known.get(part)
            if got is None:
                got = self._chunk(" " + part)
                if len(part) <= _SHORT:
                    if len(known) >= _CACHE_ENTRIES:
                        known.clear()
                    known[part] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes, leaf: int = 4096) -> bytes:
        """Bytes of the ids: leaves are looked up, halves are concatenated."""
        if len(ids) <= 4 * leaf:
            return b"".join(map(self.token.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))
        mid = len(ids) // 8 * 4
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)


def _encoder(file: bytes, pattern: str) -> TreeBpe:
    """One encoder per Python worker."""
    key = (zlib.crc32(file), pattern)
    encoders = held("bpe")
    if key not in encoders:
        encoders[key] = TreeBpe(file, pattern)
    return encoders[key]


def _ship(docs: DataFrame, rank_file: str):
    ship(docs.sparkSession)
    with open(rank_file, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids``: the token ids of each whole text, as an array.

    Null and empty texts have no ids. Rows are independent: repeated rows and
    null ``doc_id`` are kept as they are, an empty table gives an empty table,
    extra columns are ignored.
    """
    shipped = _ship(docs, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(shipped.value, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = [bpe.encode(t.as_py() or "") for t in part.column(1)]
                ids = [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id``, ``text``: the inverse of ``encode``; null ids count as none."""
    shipped = _ship(tokens, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(shipped.value, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = [x.as_py() or [] for x in part.column(1)]
                texts = [bpe.decode(struct.pack(f"<{len(x)}I", *x)).decode("utf-8", "replace")
                         for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Digests of the ids and of the bytes decoded from them, one row per document."""
    shipped = _ship(docs, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(shipped.value, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)
