"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is compressed twice, with a dictionary of each class; the difference of the two sizes over
the text's length says which class it resembles. A logistic curve, fitted on labelled rows that
neither dictionary holds, turns it into a probability.

The fit reads at most FIT_ROWS labelled rows of each class, those of smallest hash. In that order whole
texts go into the class's dictionary as long as they fit in its bound: DICTIONARY_BYTES or, if less, TENTHS
tenths of the smaller class, so that both dictionaries are about as large; no text is cut. All other chosen
rows are for the curve: each is compressed where it lies, and only its difference comes to the driver. The
curve's shift is then moved to the shares of all labelled rows. Scores read whole texts.

Nulls: a null text is empty and gets the curve's value at 0; null labels are not fitted on. Without
labelled rows of both classes every score is the share of ones, or 0.5 without any. Repeated rows
each get a row; of rows that share a labelled id the fit takes the least text. An empty table gives an
empty result. Columns of other names, whatever they are, are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattica.llm.common import Stage

#: Bounds of the fit: labelled rows of each class, bytes of each dictionary.
FIT_ROWS = 3000
DICTIONARY_BYTES = 512 << 10
#: The dictionaries take at most so many tenths of the bytes of the smaller class.
TENTHS = 6
#: With fewer rows than this outside the dictionaries, the curve is fitted on all of them.
LEAST_CURVE_ROWS = 20
LEVEL = 6


class CompressionModel:
    def __init__(self, bad: bytes, good: bytes, slope: float, shift: float):
        self.parts = (bad, good, slope, shift)
        self.slope, self.shift = slope, shift
        self.zips = []
        if bad and good:
            for raw in (bad, good):
                held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=LEVEL)
                self.zips.append(zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_dict_id=False))

    def difference(self, text: bytes) -> float:
        """Compressed size by the bad dictionary less that by the good one, a byte of text."""
        if not self.zips or not text:
            return 0.0
        bad, good = (len(z.compress(text)) for z in self.zips)
        return (bad - good) / len(text)

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.difference(text) + self.shift, -500, 500))))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope and shift by Newton's method, with targets drawn in as Platt has it."""
    ones, zeros = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    scale = max(float(np.std(x)), 1e-9)
    design = np.stack([x / scale, np.ones(len(x))], 1)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (p - target) + 1e-6 * beta
        curve = design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        beta -= np.clip(np.linalg.solve(curve, gradient), -3, 3)
    return float(beta[0] / scale), float(beta[1])


def _constant(share: float) -> CompressionModel:
    return CompressionModel(b"", b"", 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))


def dictionary_rows(quality: np.ndarray, size: np.ndarray, most: int = DICTIONARY_BYTES) -> np.ndarray:
    """Which rows, in the given order, go whole into the dictionary of their class: those that still fit in."""
    least = min(int(size[quality == k].sum()) for k in (0, 1))
    bound, used = min(most, least * TENTHS // 10), [0, 0]
    inside = np.zeros(len(size), bool)
    for i, (k, n) in enumerate(zip(quality.tolist(), size.tolist(), strict=True)):
        if n and used[k] + n + 1 <= bound:
            used[k] += n + 1
            inside[i] = True
    return inside


def fit_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> CompressionModel:
    """labels: the rows to learn from; held-out rows are the caller's to leave out."""
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"))
    ranked = [known.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(rows) for k in (0, 1)]
    some = ranked[0].union(ranked[1])  # bounded: 2 * rows ids
    picked = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(some), "id")
    picked = Stage(picked.groupBy("id", "y").agg(F.min("text").alias("text")), "labelled")
    try:
        return _fit(picked.df, known)
    finally:
        picked.drop()


def _fit(picked: DataFrame, known: DataFrame) -> CompressionModel:
    """picked: at most 2 * rows (id, y, text) rows; known: all labels."""
    sized = picked.select("id", "y", F.octet_length("text").alias("size"), F.xxhash64("id").alias("rank")).collect()  # bounded numbers
    sized.sort(key=lambda r: (r["rank"], r["id"]))
    quality, size = np.array([r["y"] for r in sized], int), np.array([r["size"] for r in sized], int)
    if not len(quality) or quality.all() or not quality.any():
        return _constant(float(quality.mean()) if len(quality) else 0.5)
    inside = dictionary_rows(quality, size)
    ids = [r["id"] for r in sized]
    place = {i: k for k, i in enumerate(ids)}
    chosen = [i for i, held in zip(ids, inside, strict=True) if held]
    spark = picked.sparkSession
    named = F.broadcast(spark.createDataFrame([(i,) for i in chosen], picked.select("id").schema))
    texts = sorted(picked.join(named, "id", "left_semi").collect(), key=lambda r: place[r["id"]])  # at most two dictionaries' bytes
    raws = [b"\n".join(r["text"].encode() for r in texts if r["y"] == k) or b"\n" for k in (0, 1)]
    rest = picked.join(named, "id", "left_anti") if (~inside).sum() >= LEAST_CURVE_ROWS else picked
    shared = spark.sparkContext.broadcast((*raws, 0.0, 0.0))

    def compare(batches):
        model = _model(shared.value)
        for batch in batches:
            x = [model.difference(t.as_py().encode()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(x, pa.float64())], names=["id", "y", "x"])

    schema = StructType(picked.schema.fields[:1]).add("y", "integer").add("x", "double")
    told = sorted(rest.select("id", "y", "text").mapInArrow(compare, schema).collect(), key=lambda r: place[r["id"]])  # bounded numbers
    x, y = np.array([r["x"] for r in told]), np.array([r["y"] for r in told])
    if y.all() or not y.any():
        return _constant(float(quality.mean()))
    slope, shift = _curve(x, y)
    shares = known.agg(F.sum("y").alias("ones"), F.count("*").alias("all")).first()
    ones, zeros = shares["ones"], shares["all"] - shares["ones"]
    # the curve was fitted in other shares than the classes have: the shift says the shares of all labelled rows
    return CompressionModel(*raws, slope, float(shift + np.log(ones / zeros) - np.log(y.sum() / (len(y) - y.sum()))))


@functools.lru_cache(2)
def _model(parts) -> CompressionModel:
    return CompressionModel(*parts)


def score_quality(docs: DataFrame, model: CompressionModel, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, predicted) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts)  # two dictionaries, at most DICTIONARY_BYTES each

    def run(batches):
        model = _model(shared.value)
        for batch in batches:
            scores = np.array([model.score((t.as_py() or "").encode()) for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[id, "score", "predicted"])

    rows = docs.select(F.col(id), F.col(text).alias("_text"))
    return rows.mapInArrow(run, StructType(rows.schema.fields[:1]).add("score", "double").add("predicted", "integer"))
