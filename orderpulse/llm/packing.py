"""Sum-of-squares online packing of tokenised documents into fixed windows.

Every input partition packs its own rows in one pass, so no document and no
count crosses a task border. A document's ids are cut into full windows, which
are closed at once, and one rest. The rest is placed online: among the fill
levels it fits on, and an empty window, it takes the one that minimises the sum
of the squared numbers of open windows per level. The level array holds the open
windows of each level.

Windows stay open in memory until they are full. When ``max_open`` windows are
open, and at the end of the partition, the open windows are emptied: their
content is laid end to end and cut into full windows. What is left at the end
(under one window per partition) is closed at lengths that are powers of two,
which need no padding.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from orderpulse.llm.common import held, ship

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
_CACHE_WORDS = 500_000


#: The vocabulary's pre-tokenizer pattern.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Latin text where lower case works by single characters, NFC changes nothing
#: and every library agrees on white space.
_PLAIN = re.compile("[\t-\r !-~\xa1-\u012f\u0131-\u024f]*")


def _byte_alphabet() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (i for i in range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordTokenizer:
    """Token ids of texts, word by word.

    The normaliser (NFC, lower case by code point) and the pre-tokenizer never
    join text across a white-space character, so the ids of a text are the ids
    of its blank-separated chunks one after another. Chunks, and the pre-tokens
    in them, repeat: both are looked up first, in tables that are emptied when
    they reach a fixed number of entries.
    """

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_buffer(file)
        self.tok.encode_special_tokens = True
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.alphabet = _byte_alphabet()
        self.chunks: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _run(self, run: str) -> bytes:
        """Ids of one normalised pre-token."""
        got = self.runs.get(run)
        if got is None:
            if len(self.runs) >= _CACHE_WORDS:
                self.runs.clear()
            shown = run if run.isascii() else "".join([self.alphabet[b] for b in run.encode()])
            ids = [t.id for t in self.model.tokenize(shown)]
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(run) <= 64:
                self.runs[run] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        if len(chunk) <= 4096 and _PLAIN.fullmatch(chunk):
            return b"".join([self._run(r) for r in _SPLIT.findall(chunk.lower())])
        return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        chunks, known = text.split(" "), self.chunks
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            pass
        out = []
        for c in chunks:
            got = known.get(c)
            if got is None:
                got = self._chunk(c)
                if len(c) <= 64:
                    if len(known) >= _CACHE_WORDS:
                        known.clear()
                    known[c] = got
            out.append(got)
        return b"".join(out)


class LevelPacker:
    """Open windows by fill level and the sum-of-squares choice among them."""

    def __init__(self, window: int, max_open: int, first_id: int):
        self.window, self.max_open, self.next_id = window, max_open, first_id
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.done: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def add(self, doc: int, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.window
        full = len(ids) // step * step
        for lo in range(0, full, step):
            self._close([(doc, lo // 4, ids[lo:lo + step], total)])
        if full < len(ids):
            self._place((doc, full // 4, ids[full:], total))

    def _place(self, piece: tuple) -> None:
        """Put a piece where the sum of squared counts grows least.

        At fewer than ``max_open`` windows: a new window or a level it fits on. At
        that number: a level it fits on, or one whose window it fills, cut there,
        its rest being a window of its own. Of equal choices an uncut one, then the
        lowest level.
        """
        size, count, w = len(piece[2]) // 4, self.count, self.window
        none = np.iinfo(np.int64).max
        # change of the sum of squares when a window goes from level h to h + size
        change = 2 * count[size:] + 2
        change[:w + 1 - size] -= 2 * count[:w + 1 - size]
        change[0] = 2 * count[size] + 1
        change[w - size] -= 2 * count[w] + 2 - 1  # a full window leaves the count
        change[1:][count[1:w + 1 - size] == 0] = none
        if size == w:
            change[0] = 0
        level, cut = -1, False
        if self.n_open >= self.max_open:
            change[0] = none
            # h fills up and leaves the count, the rest of the piece opens level h + size - w
            over = np.where(count[w - size + 1:w] > 0, 2 * count[1:size] + 2 - 2 * count[w - size + 1:w], none)
            if len(over) and over.min() < change.min():
                level, cut = int(over.argmin()) + w - size + 1, True
        if not cut:
            level = int(change.argmin())
        pieces = self.open[level].pop() if level else []
        if level:
            count[level] -= 1
            self.n_open -= 1
        if cut:
            doc, start, ids, total = piece
            room = w - level
            self._close([*pieces, (doc, start, ids[:4 * room], total)])
            pieces, piece, level, size = [], (doc, start + room, ids[4 * room:], total), 0, size - room
        pieces.append(piece)
        if level + size == w:
            self._close(pieces)
            return
        self.open[level + size].append(pieces)
        count[level + size] += 1
        self.n_open += 1

    def empty(self) -> None:
        """At the end: lay the open windows end to end, cut them into full ones and the rest at powers of two."""
        room, now = self.window, []
        for level in range(self.window, 0, -1):
            for pieces in self.open[level]:
                for doc, start, ids, total in pieces:
                    while ids:
                        part = ids[:4 * room]
                        now.append((doc, start, part, total))
                        room -= len(part) // 4
                        start += len(part) // 4
                        ids = ids[len(part):]
                        if not room:
                            self._close(now)
                            room, now = self.window, []
            self.open[level] = []
        self.count[:] = 0
        self.n_open = 0
        if not now:
            return
        left = self.window - room
        for bit in range(left.bit_length() - 1, -1, -1):
            need = left & (1 << bit)
            group = []
            while need:
                doc, start, ids, total = now.pop(0)
                part = ids[:4 * need]
                group.append((doc, start, part, total))
                need -= len(part) // 4
                if len(part) < len(ids):
                    now.insert(0, (doc, start + len(part) // 4, ids[len(part):], total))
            if group:
                self._close(group)


def _tokenizer(file: bytes) -> WordTokenizer:
    """One tokenizer per Python worker; its word tables stay until another operator's tasks come."""
    key = zlib.crc32(file)
    tokenizers = held("packing")
    if key not in tokenizers:
        tokenizers[key] = WordTokenizer(file)
    return tokenizers[key]


def pack(docs: DataFrame, tokenizer_file: str, window: int = 2048, end_id: int = 1,
         max_open: int = 256) -> DataFrame:
    """One row per piece of a document, with its place in a sequence.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A null or
    empty text is the end id alone. Repeated rows are packed once each, in input
    order; a null ``doc_id`` stays null. An empty table gives no rows. Texts of
    any length are cut into windows as they are read. Sequence ids are the
    partition number times 2**32 plus a running number. At most ``max_open``
    windows (under 2048 ids each) are open at a time; from then on a piece that fits
    on no better level fills a window and is cut there, so that windows are closed
    by the choice of level and only what is open at a partition's end is laid end to
    end. Of equal levels the lowest is taken, of one level's windows the newest.
    """
    ship(docs.sparkSession)
    with open(tokenizer_file, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()
    names = [c.split()[0] for c in PIECES.split(", ")]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        packer = LevelPacker(window, max_open, (ctx.partitionId() if ctx else 0) << 32)
        tok = _tokenizer(shipped.value)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*packer.done)) or [[]] * len(names)
            packer.done = []
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, tok.ids(text.as_py() or "") + end)
                if len(packer.done) >= 20_000:
                    yield flush()
        packer.empty()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
