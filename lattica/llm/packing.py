"""Sum-of-squares packing of tokenised documents into sequences.

A document's ids, closed by an end id, are cut into full windows and a rest; a full window is a
sequence of its own. The rests go online, one after the other as their ids come and never looked at
again, to the fill level that makes the sum of the squared counts of partially filled windows least
(Csirik et al.); the counts stand in one level array, ties prefer the fullest window and an open
window over a new one. Rests are dealt to shards of SHARD_ROWS by a hash of document and place, so a
shard's state is one level array and its windows; each shard leaves at most a few windows open.

Tokens are counted and checked in the scan, where each distinct word is encoded once a worker; what
is shuffled is a row of numbers a piece.

Nulls: a null text is empty, and is one piece that holds the end id. Rows that repeat a doc_id are
documents of their own; a null doc_id stays null. Empty tables give an empty result. Texts are whole
at any length.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import pretok
from lattica.llm.common import U64, Stage, bytes_of, cut_rows, flat_ranges, span_hashes

WINDOW = 4096
END_ID = 2
SHARD_ROWS = 1 << 17
PIECE_BYTES = 2 << 20
#: Words that a worker remembers; beyond it starts anew.
CACHE_WORDS = 1 << 21

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


# ---------------------------------------------------------------- tokens


class WordTokenizer:
    """A tokenizers file whose pre-tokeniser splits lower-cased words, run over arrays of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        self.whole = Tokenizer.from_file(path)
        self.lower = normalizers.Lowercase()
        self.special = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        self.classes = pretok.tokenizers_classes()
        self.lowered = np.full(0x110000, -1, np.int32)  # -1 not seen, -2 more than one character
        self.forget()

    def forget(self):
        self.hashes = np.zeros(0, U64)
        self.first = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.flat = [np.zeros(0, np.uint32)]
        self.used = 0

    def _lower(self, points: np.ndarray) -> np.ndarray:
        found = self.lowered[points]
        if (found == -1).any():
            for c in np.unique(points[found == -1]).tolist():
                low = self.lower.normalize_str(chr(c))
                self.lowered[c] = ord(low) if len(low) == 1 else -2
            found = self.lowered[points]
        return found

    def _plain(self, text: str) -> bool:
        return text.isascii() or unicodedata.is_normalized("NFC", text) and "İ" not in text

    def _points(self, data, offsets):
        """Lower-cased code points and the rows' first places; None where a row needs the library's own path."""
        points = pretok.code_points(data)
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(pretok.utf8_widths(points), out=at[1:])
        low = self._lower(points)
        return low, np.searchsorted(at, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edges): the ids of row k are ids[edges[k]:edges[k + 1]]."""
        text = data.tobytes().decode()
        odd = [x for x in self.special if x in text]
        if not odd and self._plain(text):
            low, edges = self._points(data, offsets)
            if not (low == -2).any():
                return self._encode(low, edges)
        if len(offsets) == 2:
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
            return ids, np.array([0, len(ids)])
        found = [self.encode(data[a:b], np.array([0, b - a])) for a, b in zip(offsets, offsets[1:], strict=False)]
        return np.concatenate([f[0] for f in found]), np.append(0, np.cumsum([len(f[0]) for f in found]))

    def _encode(self, low, edges):
        if not len(low):
            return np.zeros(0, np.uint32), np.zeros(len(edges), np.int64)
        starts, ends = pretok.split_words(low, self.classes(low), edges[:-1])
        hashes = span_hashes(low, starts, ends)
        some, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        self._learn(some, low, starts[first], ends[first])
        word = np.searchsorted(self.hashes, some)[back]
        counts = self.counts[word]
        flat = self.flat[0]
        ids = flat[flat_ranges(self.first[word], counts)]
        upto = np.zeros(len(word) + 1, np.int64)
        np.cumsum(counts, out=upto[1:])
        return ids, upto[np.searchsorted(starts, edges)]

    def _learn(self, some, low, starts, ends):
        if len(self.hashes) > CACHE_WORDS:
            self.forget()
        new = np.ones(len(some), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
            new = self.hashes[at] != some
        if not new.any():
            return
        words = [low[a:b].astype(np.uint32).tobytes().decode("utf-32-le") for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
        got = [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        counts = np.array([len(x) for x in got], np.int64)
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(counts.sum()))
        hashes = np.concatenate([self.hashes, some[new]])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.first = np.concatenate([self.first, self.used + np.cumsum(counts) - counts])[order]
        self.counts = np.concatenate([self.counts, counts])[order]
        self.flat = [np.concatenate([self.flat[0], flat])]
        self.used += len(flat)


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def tokenise(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of whole texts, without special tokens and without the end id."""

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            for lo, hi in cut_rows(offsets, PIECE_BYTES):
                ids, edges = tok.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def cut_pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id: str = "doc_id", text: str = "text") -> DataFrame:
    """PIECES: full windows and the rest of each document, with the crc of their ids."""

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            for lo, hi in cut_rows(offsets, PIECE_BYTES):
                ids, edges = tok.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ids = ids.astype("<u4")
                names = batch.column(0).slice(lo, hi - lo)
                row, start, length, crc = [], [], [], []
                end = np.array([end_id], "<u4").tobytes()
                for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    total = b - a + 1
                    for s in range(0, total, window):
                        n = min(window, total - s)
                        part = zlib.crc32(ids[a + s : min(b, a + s + n)].tobytes())
                        row.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(end, part) if s + n == total else part)
                row = np.array(row)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(np.diff(edges)[row] + 1, pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


# ---------------------------------------------------------------- packing


def sum_of_squares(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of items in the given order, by the sum-of-squares rule on one level array."""
    count = np.zeros(window + 1, np.int64)  # open windows by fill level; level 0 and the full level count nothing
    at_level: list[list[int]] = [[] for _ in range(window + 1)]
    sequence, offset, windows = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        if not 0 < s <= window:
            raise ValueError(f"an item of {s} tokens does not fit a window of {window}")
        best, level = 2 * int(count[s]) + 1 if s < window else 0, 0
        if s < window:
            open_ = np.flatnonzero(count[1 : window - s + 1]) + 1
            if len(open_):
                after = np.where(open_ + s < window, 2 * count[open_ + s] + 1, 0)
                change = after - 2 * count[open_] + 1
                least = int(change.min())
                if least <= best:
                    best, level = least, int(open_[np.flatnonzero(change == least)[-1]])
        if level:
            count[level] -= 1
            number = at_level[level].pop()
        else:
            number, windows = windows, windows + 1
        sequence[k], offset[k] = number, level
        if level + s < window:
            count[level + s] += 1
            at_level[level + s].append(number)
    return sequence, offset


def pack(pieces: DataFrame, window: int = WINDOW, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Adds sequence_id and offset to PIECES. Pieces of a full window are sequences of their own."""
    stage = Stage(pieces, "pieces")
    shards = stage.df.count() // shard_rows + 1
    place = F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens")
    rows = stage.df.withColumn("shard", F.pmod(place, F.lit(shards)))

    def run(table):
        length = np.asarray(table["length"])
        order = np.lexsort((length, np.asarray(table["ids_crc32"]), np.asarray(table["start"]), np.asarray(table["doc_id"].fill_null(0))))
        sequence, offset = sum_of_squares(length[order], window)
        shard = int(table["shard"][0].as_py())
        out = table.drop_columns(["shard"]).take(pa.array(order))
        return out.append_column("sequence_id", pa.array(sequence * shards + shard, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return rows.groupBy("shard").applyInArrow(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    return pack(cut_pieces(docs, path, window, end_id), window)
