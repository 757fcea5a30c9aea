"""Exact deduplication screened by static binary-fuse filters.

Rows fall into an immutable snapshot and an incoming batch. Each batch is first reduced to one row
per digest (map-side combined, so a text that fills a third of the table costs one row a task).
The snapshot's digests become one three-wise binary-fuse filter per digest shard; the incoming
digests are screened shard by shard. Only positives join the snapshot's exact buckets; digests
that repeat within a batch are grouped without the filter. The filters of a snapshot can be kept: save_filters()
writes them, and exact_dedup() takes them as they were saved.

The texts behind every digest that is shared are then compared byte by byte: a filter of fixed size lets the
suspects' texts (and, of very many, others with them) through the second scan, each task sends a distinct one
once, compressed, and a join takes the suspects' alone; a group is one text exactly when its least and its
greatest text are the same, which combines map-side; a digest with several texts is regrouped by the text
itself. Digests of many rows are joined by broadcast, of which there are at most four a partition.

Nulls: a null text is an empty one, and empty texts equal each other. Null ids sort behind all
others. Repeated rows are members of their group like any other. An empty table gives an empty
result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import U64, Stage, join_heavy, mix, presence_filter, present, shuffle_width

#: Keys of one filter, at most about this many.
SHARD_KEYS = 1 << 18
#: Distinct texts that a task holds at a time, by their compressed bytes and by number.
TASK_BYTES = 16 << 20
TASK_TEXTS = 1 << 17


class FuseFilter:
    """Three-wise binary-fuse filter with 8-bit fingerprints over distinct 64-bit keys."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def _places(keys, seed, segment, segments):
        h = mix(keys ^ mix(np.full(1, seed, U64)))
        first = ((h >> U64(32)) * U64(segments) >> U64(32)).astype(np.int64) * segment
        step = U64(segment - 1)
        return (
            h,
            first + (h & step).astype(np.int64),
            first + segment + ((h >> U64(18)) & step).astype(np.int64),
            first + 2 * segment + (mix(h) & step).astype(np.int64),
        )

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(U64))
        n = len(keys)
        segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
        segment = min(segment, 1 << 18)
        room = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 3 * segment
        segments = max(1, -(-room // segment) - 2)
        for seed in range(1, 200):
            table = cls._fill(keys, seed, segment, segments)
            if table is not None:
                return cls(seed, segment, segments, table)
            segments += max(1, segments // 50)
        raise RuntimeError("binary-fuse filter did not peel")

    @classmethod
    def _fill(cls, keys, seed, segment, segments):
        size = segment * (segments + 2)
        h, *places = cls._places(keys, seed, segment, segments)
        spots = np.stack(places, 1)
        count = np.bincount(spots.ravel(), minlength=size)
        members = np.zeros(size, np.int64)  # sum of the keys' numbers at a slot: the last one left is known
        for k in range(3):
            np.add.at(members, spots[:, k], np.arange(len(keys)))
        left = np.ones(len(keys), bool)
        order = []
        while True:
            slots = np.flatnonzero(count == 1)
            if not len(slots):
                break
            who, at = np.unique(members[slots], return_index=True)
            order.append((who, slots[at]))
            left[who] = False
            gone = spots[who]
            np.subtract.at(count, gone.ravel(), 1)
            np.subtract.at(members, gone.ravel(), np.repeat(who, 3))
        if left.any():
            return None
        table = np.zeros(size, np.uint8)
        prints = cls._print(h)
        for who, slots in reversed(order):
            around = spots[who]
            table[slots] = 0
            table[slots] = prints[who] ^ table[around[:, 0]] ^ table[around[:, 1]] ^ table[around[:, 2]]
        return table

    @staticmethod
    def _print(h):
        return (h ^ (h >> U64(32))).astype(np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        h, a, b, c = self._places(keys.astype(U64), self.seed, self.segment, self.segments)
        return self.table[a] ^ self.table[b] ^ self.table[c] == self._print(h)

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], np.int64).tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> FuseFilter:
        seed, segment, segments = np.frombuffer(blob, np.int64, 3)
        return cls(int(seed), int(segment), int(segments), np.frombuffer(blob, np.uint8, offset=24))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def _key(digest: str) -> Column:
    return F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long")


def _keys(column) -> np.ndarray:
    return np.asarray(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).astype(U64)


def build_filters(snapshot: DataFrame) -> DataFrame:
    """(shard, filter) of a snapshot's (shard, key) rows."""

    def build(table: pa.Table) -> pa.Table:
        made = FuseFilter.build(_keys(table["key"]))
        return pa.table({"shard": table["shard"].slice(0, 1), "filter": pa.array([made.to_bytes()], pa.binary())})

    return snapshot.select("shard", "key").groupBy("shard").applyInArrow(build, "shard long, filter binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The incoming (shard, key, digest) rows that a filter holds: all true members, and about one other in 256."""

    def ask(rows: pa.Table, made: pa.Table) -> pa.Table:
        if not rows.num_rows or not made.num_rows:
            return rows.slice(0, 0)
        found = FuseFilter.from_bytes(made["filter"][0].as_py()).holds(_keys(rows["key"]))
        return rows.filter(pa.array(found))

    rows = incoming.select("shard", "key", "digest")
    return rows.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(ask, "shard long, key long, digest binary")


def _digests(docs: DataFrame, in_snapshot: Column | None, id: str, text: str, digest) -> DataFrame:
    """(id, old, norm, n) of each row."""
    if in_snapshot is None:
        in_snapshot = F.pmod(F.xxhash64(id), F.lit(2)) == 0
    return docs.select(F.col(id).alias("id"), F.coalesce(in_snapshot, F.lit(False)).alias("old"), normalised(F.col(text)).alias("norm"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"))


def _sharded(digests: DataFrame, shards: int) -> DataFrame:
    return digests.withColumn("key", _key("digest")).withColumn("shard", F.pmod(F.col("key"), F.lit(shards)))


def save_filters(snapshot: DataFrame, path: str, text: str = "text", digest=sha256) -> None:
    """Writes the filters of an immutable snapshot's texts under path, for later batches to be screened by."""
    digests = snapshot.select(digest(normalised(F.col(text))).alias("digest")).distinct()
    digests = Stage(digests, "snapshot")
    shards = max(shuffle_width(snapshot.sparkSession), digests.df.count() // SHARD_KEYS + 1)
    build_filters(_sharded(digests.df, shards)).withColumn("shards", F.lit(shards)).write.parquet(path)
    digests.drop()


def exact_dedup(docs: DataFrame, in_snapshot: Column | None = None, id: str = "doc_id", text: str = "text", digest=sha256, filters: str | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row.

    in_snapshot: true for rows of the immutable snapshot; by default half of the ids, by hash.
    filters: where save_filters() has put those of the snapshot; else they are built from its rows.
    """
    spark = docs.sparkSession
    rows = _digests(docs, in_snapshot, id, text, digest)
    light = Stage(rows.select("id", "old", digest(F.col("norm")).alias("digest"), "n"), "digests")
    total = light.df.count()
    best = F.max(F.struct(F.col("n"), F.bitwise_not("id").alias("less"))).alias("best")  # of the longest, the least id; a null id last
    groups = light.df.groupBy("old", "digest").agg(F.count("*").alias("size"), best)
    saved = spark.read.parquet(filters) if filters else None
    shards = saved.agg(F.max("shards")).first()[0] if filters else None
    shards = shards or max(shuffle_width(spark), total // SHARD_KEYS + 1)
    groups = Stage(_sharded(groups, shards), "batches")
    old, new = groups.df.where("old"), groups.df.where("not old")

    positives = screen(new, saved.select("shard", "filter") if filters else build_filters(old)).select("digest")
    confirmed = positives.join(old.select("digest"), "digest")
    repeated = groups.df.where("size > 1").select("digest")
    suspects = Stage(confirmed.union(repeated).distinct(), "suspects")

    shared = presence_filter(suspects.df.select(F.xxhash64("digest").alias("key")), "key")
    texts = rows.select(digest(F.col("norm")).alias("digest"), "norm").select("digest", F.xxhash64("digest").alias("key"), "norm")
    texts = texts.mapInArrow(lambda batches: _distinct_texts(batches, shared.value), "digest binary, text binary")
    texts = texts.join(suspects.df.hint("merge"), "digest", "left_semi").groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    checked = Stage(texts.select("digest", (F.col("lo") == F.col("hi")).alias("one")), "checked")

    one = checked.df.where("one").select("digest")
    joined = groups.df.join(one, "digest", "left_semi").groupBy("digest").agg(F.sum("size").alias("group_size"), F.max("best").alias("best"))
    joined = Stage(joined.select("digest", "group_size", F.bitwise_not("best.less").alias("keep_id")), "groups").df
    mixed = checked.df.where("not one").select("digest")
    out = join_heavy(light.df.select("id", "digest"), joined, "digest", "group_size", total).join(mixed, "digest", "left_anti")
    out = out.select("id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "digest")
    if mixed.limit(1).count():  # texts of one digest that differ: group by the bytes themselves
        texts = rows.select("id", "n", digest(F.col("norm")).alias("digest"), "norm").join(mixed, "digest", "left_semi")
        split = texts.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), best).select("digest", "norm", "group_size", F.bitwise_not("best.less").alias("keep_id"))
        out = out.union(texts.join(split, ["digest", "norm"]).select("id", "keep_id", "group_size", "digest"))
    for stage in (groups, suspects):
        stage.drop()
    return out.select(F.col("id").alias(id), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _distinct_texts(batches, filter_):
    """(digest, compressed text) of the distinct texts of a task's rows that pass the filter; equal texts have equal bytes here too."""
    zip_ = zstandard.ZstdCompressor(level=3)
    held: set[tuple[bytes, bytes]] = set()
    size = 0

    def flush():
        pairs = sorted(held)
        for lo in range(0, len(pairs), 1000):
            some = pairs[lo : lo + 1000]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.binary()), pa.array([t for _, t in some], pa.binary())], names=["digest", "text"])

    for batch in batches:
        batch = batch.filter(pa.array(present(filter_, np.asarray(batch.column(1)))))
        for digest, text in zip(batch.column(0), batch.column(2), strict=True):
            pair = digest.as_py(), zip_.compress(text.as_buffer() or b"")
            if pair not in held:
                held.add(pair)
                size += len(pair[1])
                if size >= TASK_BYTES or len(held) >= TASK_TEXTS:
                    yield from flush()
                    held.clear()
                    size = 0
    yield from flush()
