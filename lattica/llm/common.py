"""Shared plumbing: the cluster's shared folder, Arrow slicing, vectorised text kernels."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where the setting is unset and everything runs on one machine, a local folder is made and set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="lattica-shared-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lattica-{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Stage:
    """A table written to the shared folder: cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, label)
        df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        delete_path(self.spark, self.path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_heavy(left: DataFrame, right: DataFrame, on: str, weight: str, rows: int, how: str = "left") -> DataFrame:
    """left joined with right, which has one row for each value of `on`; weight: how many of left's `rows` rows have it.

    Values that hold more than a quarter of a partition's share are joined by broadcast, so that none fills a task;
    there are at most four for each shuffle partition, whatever the data. The others meet in the shuffle.
    """
    most = rows // (4 * shuffle_width(left.sparkSession)) + 1
    heavy = F.broadcast(right.where(F.col(weight) > most))
    light = right.where(F.col(weight) <= most)
    return left.join(heavy, on).unionByName(left.join(heavy.select(on), on, "left_anti").join(light, on, how))


#: Bits of a presence filter, whatever the number of keys: 4 MB. With more keys it lets more others through, never fewer of its own.
PRESENCE_BITS = 1 << 25
_BITMAP = 32768  # Spark's bitmaps


def presence_filter(keys: DataFrame, key: str):
    """A broadcast Bloom filter of fixed size over a long column; present() asks it.

    The bits are set by Spark's bitmap aggregate, so what reaches the driver is the filter's size at any number of keys.
    """
    spots = F.explode(F.array(*(F.pmod(F.shiftrightunsigned(F.col(key), k), F.lit(PRESENCE_BITS)) + 1 for k in (0, 32))))
    bits = keys.where(F.col(key).isNotNull()).select(spots.alias("at"))
    made = bits.groupBy(F.bitmap_bucket_number("at").alias("nr")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    table = np.zeros((PRESENCE_BITS // _BITMAP, _BITMAP // 8), np.uint8)
    for r in made.collect():  # at most PRESENCE_BITS / 8 bytes
        table[r["nr"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table.ravel())


def present(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be in the filter: all that are, and some others."""
    keys = keys.view(U64)
    found = np.ones(len(keys), bool)
    for shift in (0, 32):
        at = (keys >> U64(shift)) % U64(PRESENCE_BITS)
        found &= (table[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1).astype(bool)
    return found


# ---------------------------------------------------------------- Arrow helpers


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut_rows(offsets: np.ndarray, most: int):
    """Row ranges whose bytes sum to at most `most`, a longer row standing alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def batches(rows: dict, schema: pa.Schema, most: int = 20_000):
    n = len(next(iter(rows.values())))
    arrays = [rows[f.name] if isinstance(rows[f.name], pa.Array) else pa.array(rows[f.name], f.type) for f in schema]
    for lo in range(0, n, most):
        yield pa.RecordBatch.from_arrays([a.slice(lo, most) for a in arrays], schema=schema)


# ---------------------------------------------------------------- hashing kernels

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, U64), "i": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd base and of its inverse, modulo 2**64."""
    if len(_powers["p"]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for key, base in (("p", _P), ("i", _PINV)):
            out = np.ones(size, U64)
            filled = 1
            while filled < size:
                out[filled : 2 * filled] = out[:filled] * U64(pow(base, filled, 1 << 64))
                filled *= 2
            _powers[key] = out
    return _powers["p"][:n], _powers["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of (symbol + 1) * P**k for i <= k < j."""
    p, _ = powers(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, U64)
    np.cumsum((symbols.astype(U64) + U64(1)) * p[: len(symbols)], out=out[1:])
    return out


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each span of symbols; spans are in order and do not overlap.

    Works through windows of `most` symbols, so memory stays flat for a text of any length
    (a single span longer than that is one window).
    """
    out = np.empty(len(starts), U64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + most, "right")))
        base = starts[lo]
        sums = prefix_sums(symbols[base : ends[hi - 1]])
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        _, inv = powers(len(sums))
        out[lo:hi] = mix((sums[b] - sums[a]) * inv[a] + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93))
        lo = hi
    return out


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row) of runs without ASCII white space; rows do not run into each other."""
    solid = ~SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)
