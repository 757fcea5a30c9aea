"""Byte-level BPE by a global shuffle of distinct words, and its decoding by the token-byte table.

A scan task cuts its rows into chunks of text and explodes each into pre-tokens with positions, once. Of a
chunk two kinds of rows are written: its distinct words by bucket, and for each piece of the chunk the word
at each position (as numbers in an array, not a row each: rows of words with positions would be several times
the text). The words meet in buckets by hash, where each distinct word of the corpus is encoded once; the ids
join their chunk again and are put at the words' positions. A word that fills a third of the corpus is one
entry a chunk. Buckets grow in number with the text. Decoding joins ids with the token-byte table, which is the
tokenizer's own vocabulary and so of one size; every task holds it.

Both kinds come from one written pass, in a table whose files are bucketed by chunk: the positions are read where
they lie and only the words and their ids cross the network. A chunk whose answers do not fit its words fails
the job rather than lose rows.

Nulls: a null text is empty and has no tokens; ids may be null or repeat, each row is encoded. An
empty table gives an empty result. Texts of any length are whole: a long one is a chunk of its own.
Columns of other names are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import pretok
from lattica.llm.common import U64, bytes_of, cut_rows, flat_ranges, new_path, shuffle_width, span_hashes

CHUNK_BYTES = 24 << 20
PIECE_BYTES = 1 << 20
#: A bucket gets the distinct words of about so many bytes of text.
BUCKET_BYTES = 64 << 20


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TokenTable:
    """id -> bytes as one flat array."""

    def __init__(self, tokens: list[bytes]):
        lengths = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.lengths = lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, length of each id's part)"""
        lengths = self.lengths[ids]
        return self.flat[flat_ranges(self.starts[ids], lengths)], lengths


@functools.cache
def token_bytes(path: str) -> TokenTable:
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return TokenTable(tokens)


@functools.cache
def decimals(size: int) -> TokenTable:
    return TokenTable([b"%d " % i for i in range(size)])


@functools.cache
def _classes():
    return pretok.tiktoken_classes()


@functools.cache
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def word_starts(data: np.ndarray, offsets: np.ndarray, pattern: str) -> np.ndarray:
    """Byte positions where the pattern's words begin; rows do not run into each other."""
    import public_tokenizers

    if not len(data):
        return np.zeros(0, np.int64)
    if pattern != public_tokenizers.PATTERN:  # any other pattern, word by word
        import regex

        found, compiled = [], regex.compile(pattern)
        for a, b in zip(offsets, offsets[1:], strict=False):
            for word in compiled.findall(data[a:b].tobytes().decode()):
                found.append(a)
                a += len(word.encode())
            if a != b:
                raise ValueError("the pattern must cover every character")
        return np.array(found, np.int64)
    points = pretok.code_points(data)
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(pretok.utf8_widths(points), out=at[1:])
    starts = pretok.split_all(points, _classes()(points), np.searchsorted(at, offsets[:-1]))
    return at[starts]


def _squeeze(*arrays) -> bytes:
    """Arrays as a compressed blob: count, then kind, length and bytes of each; of numbers all first bytes, all second bytes, and so on."""
    parts = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a).ravel()
        raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
        parts += [a.dtype.str.encode().ljust(4), len(raw).to_bytes(8, "little"), raw]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unsqueeze(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 1
    for _ in range(raw[0]):
        kind, size = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        planes = np.frombuffer(raw, np.uint8, size, at + 12).reshape(kind.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += 12 + size
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=0).astype(np.uint32)


class _Chunk:
    """The distinct words of a chunk, numbered as they come, and the word at each position of its pieces."""

    def __init__(self, pattern: str):
        self.pattern = pattern
        self.name = uuid.uuid4().hex  # both kinds of rows are written by one attempt, so any name that is not given twice will do
        self.hashes, self.numbers = np.zeros(0, U64), np.zeros(0, np.int64)  # by hash
        self.words: list[bytes] = []
        self.of_word: list[np.ndarray] = []
        self.pieces: list[bytes] = []
        self.size = 0

    def add(self, ids, data, offsets):
        starts = word_starts(data, offsets, self.pattern)
        ends = np.append(starts[1:], len(data))
        some, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, some)
        new = np.ones(len(some), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != some[inside]
        if new.any():
            raw, fresh = data.tobytes(), first[new]
            numbers = len(self.words) + np.arange(len(fresh))
            self.words += [raw[a:b] for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)]
            self.of_word.append(some[new])
            hashes = np.concatenate([self.hashes, some[new]])
            order = np.argsort(hashes)
            self.hashes, self.numbers = hashes[order], np.concatenate([self.numbers, numbers])[order]
        word = self.numbers[np.searchsorted(self.hashes, some)][back].astype(np.uint32)
        edges = np.searchsorted(starts, offsets).astype(np.int64)  # the first position of each row
        self.pieces.append(_squeeze(np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null()), edges, word))
        self.size += len(data)

    def rows(self, buckets: int):
        """(kind, place, chunk, blob): kind 0 the words of bucket `place` with the steps of their numbers, kind 1 the piece `place`."""
        hashes = np.concatenate(self.of_word) if self.of_word else np.zeros(0, U64)
        bucket = ((hashes >> U64(32)) % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for b, some in zip(*_split(bucket[order], order), strict=True):
            words = [self.words[k] for k in some.tolist()]
            blob = _squeeze(_steps(some), np.array([len(w) for w in words], np.uint32), np.frombuffer(b"".join(words), np.uint8))
            yield self._row(0, b, blob)
        for k, blob in enumerate(self.pieces):
            yield self._row(1, k, blob)

    def _row(self, kind, place, blob):
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([place], pa.int64()), pa.array([self.name]), pa.array([blob], pa.binary())], names=["kind", "place", "chunk", "blob"])


def _split(keys: np.ndarray, rows: np.ndarray):
    """(keys, rows of each) of sorted keys."""
    some, first = np.unique(keys, return_index=True)
    return some.tolist(), np.split(rows, first[1:]) if len(some) else []


def _explode(pattern: str, buckets: int):
    def run(batches):
        chunk = _Chunk(pattern)
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            for lo, hi in cut_rows(offsets, PIECE_BYTES):
                chunk.add(batch.column(0).slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                if chunk.size >= CHUNK_BYTES:
                    yield from chunk.rows(buckets)
                    chunk = _Chunk(pattern)
        if chunk.pieces:
            yield from chunk.rows(buckets)

    return run


def _encode(path: str, pattern: str):
    """(chunk, ids) for a bucket's (place, chunk, blob): each distinct word is encoded once; the ids of a chunk's words go back by their numbers."""

    def run(batches):
        piece = _encoder(path, pattern)._core_bpe.encode_single_piece
        done: dict[bytes, list[int]] = {}
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                steps, lengths, flat = _unsqueeze(blob)
                raw, counts, ids, at = flat.tobytes(), [], [], 0
                for n in lengths.tolist():
                    word = raw[at : at + n]
                    at += n
                    got = done.get(word)
                    if got is None:
                        got = done[word] = piece(word)
                    counts.append(len(got))
                    ids += got
                answer = _squeeze(steps, np.array(counts, np.uint32), np.array(ids, np.uint32))
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "ids": pa.array([answer], pa.binary())})

    return run


def _reassemble(finish):
    def run(pieces, answers):
        got = [_unsqueeze(x.as_py()) for x in answers["ids"]]
        numbers = np.concatenate([np.cumsum(g[0], dtype=np.uint32) for g in got]) if got else np.zeros(0, np.uint32)
        counts = np.concatenate([g[1] for g in got]).astype(np.int64) if got else np.zeros(0, np.int64)
        flat = np.concatenate([g[2] for g in got]) if got else np.zeros(0, np.uint32)
        order = np.argsort(numbers)
        first, counts = (np.cumsum(counts) - counts)[order], counts[order]
        whole = (numbers[order] == np.arange(len(order))).all()  # every word has one answer
        out = []
        for blob in pieces["blob"]:
            ids, null, edges, word = _unsqueeze(blob.as_py())
            if not whole or len(word) and int(word.max()) >= len(order):
                raise RuntimeError("a chunk's words have no answer each")
            tokens = flat[flat_ranges(first[word], counts[word])]
            upto = np.zeros(len(word) + 1, np.int64)
            np.cumsum(counts[word], out=upto[1:])
            out.append(finish(pa.array(ids, mask=null), tokens, upto[edges]))
        return pa.concat_tables([pa.Table.from_batches([b]) for b in out])

    return run


def real_output(path: str):
    """finish(): the ids and the bytes that they decode to."""

    def finish(ids, tokens, edges):
        data, lengths = token_bytes(path).join(tokens)
        upto = np.zeros(len(tokens) + 1, np.int64)
        np.cumsum(lengths, out=upto[1:])
        return pa.RecordBatch.from_arrays(
            [ids, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(tokens, pa.int32())), pa.array([data[a:b].tobytes() for a, b in zip(upto[edges], upto[edges[1:]], strict=False)], pa.binary())],
            names=["doc_id", "ids", "decoded"],
        )

    return finish, "doc_id long, ids array<int>, decoded binary"


def digest_output(path: str):
    """finish(): digests of the same output."""

    def finish(ids, tokens, edges):
        table = token_bytes(path)
        told, decoded = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            said, plain = hashlib.sha256(), hashlib.sha256()
            for lo in range(a, b, 1 << 18):
                some = tokens[lo : min(b, lo + (1 << 18))]
                text = decimals(len(table.lengths)).join(some)[0]
                said.update(text[: len(text) - (lo + (1 << 18) >= b)])
                plain.update(table.join(some)[0])
            told.append(said.hexdigest())
            decoded.append(plain.hexdigest())
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(edges), pa.int64()), pa.array(told), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, pattern: str, output=real_output, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_width(spark), size // BUCKET_BYTES)
    finish, schema = output(path)
    chunks = max(shuffle_width(spark), size // CHUNK_BYTES)
    kept = new_path(spark, "words")
    name = "lattica_words_" + kept.rsplit("-", 1)[1]
    exploded = rows.mapInArrow(_explode(pattern, buckets), "kind int, place long, chunk string, blob binary")
    exploded.write.partitionBy("kind").bucketBy(chunks, "chunk").option("path", kept).option("compression", "none").saveAsTable(name)
    made = spark.table(name)
    words = made.where("kind = 0").repartition(buckets, "place").select("chunk", "blob")
    answers = words.mapInArrow(_encode(path, pattern), "chunk string, ids binary")
    pieces = made.where("kind = 1").select("chunk", "blob")
    return pieces.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_reassemble(finish), schema)


def decode_ids(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded` binary, the bytes of an array<int> column of ids (null: null; null ids are skipped)."""
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        table = token_bytes(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            out = []
            for x in column:
                out.append(None if x.values is None else table.join(np.asarray(x.values.drop_null(), np.int64))[0].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)
