"""Toxicity: cumulative-link ordinal regression on sparse text features.

Features are the words of a text and their first bytes, by hash; a feature's value is the logarithm
of one plus its count. Severity grades are ordered: 0 for a document labelled clean; the toxic ones
are graded 1 to GRADES by how many marked words they hold (thirds of the fitted rows), marked being
the features that toxic rows hold significantly more often. One weight vector w is shared by all
thresholds: P(grade <= k) = sigmoid(theta_k - w x), fitted by gradient descent. The score is the
expected severity; a document is rejected when P(grade >= 1) is at least one half.

The labels say toxic or not, no more: the grades above 0 are made of the fitted features, and their order is
as good as those are.

The fit reads at most FIT_ROWS labelled rows of each class, those of smallest hash. Their whole texts are
tallied where they lie; rows that hold a feature are counted by class, and only the tallies of features
that tell the classes apart go to the task that fits. Scoring reads every whole text, map-side.

Nulls: a null text has no features; null labels are not fitted on. Without labelled rows of both
classes nothing is toxic and every severity is 0. Repeated rows each get a row; of rows that share a labelled
id the fit takes the least text. An empty table gives an empty result. Texts are whole at any length.
Columns of any other name may come with the rows; carried along, those named like a result give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from lattica.llm.common import LOWER, U64, Stage, bytes_of, cut_rows, mix, span_hashes, words_of

FIT_ROWS = 4000
GRADES = 3
PREFIXES = (4, 5, 6, 7)
#: A feature is fitted if so many rows hold it, and as many as this share of the toxic ones.
LEAST_ROWS = 4
LEAST_SHARE = 0.005
PIECE_BYTES = 1 << 20
STEPS = 600
RIDGE = 1e-3


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each word and prefix of the rows' texts."""
    data = LOWER[data]
    starts, ends, first = words_of(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    letters = np.ones(256, bool)
    letters[:128] = [chr(c).isalnum() for c in range(128)]
    while len(ends) and (loose := (ends - starts > 1) & ~letters[data[ends - 1]]).any():  # punctuation behind a word
        ends = ends - loose
    found = [span_hashes(data, starts, ends)]
    rows = [row]
    for n in PREFIXES:
        long = ends - starts >= n
        found.append(mix(span_hashes(data, starts[long], starts[long] + n) + U64(n)))
        rows.append(row[long])
    return np.concatenate(rows), np.concatenate(found)


def tally(row: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of each distinct pair."""
    order = np.lexsort((name, row))
    row, name = row[order], name[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (name[1:] != name[:-1])
    at = np.flatnonzero(new)
    return row[at].astype(np.int32), name[at], np.diff(np.append(at, len(row))).astype(np.int32)


class OrdinalModel:
    def __init__(self, names: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        order = np.argsort(names)
        self.names, self.weights, self.thresholds = names[order], weights[order], thresholds

    def severity(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected severity, P(grade >= 1)) of the rows."""
        n = len(offsets) - 1
        if not len(self.thresholds):
            return np.zeros(n), np.zeros(n)
        row, name = features(data, offsets)
        x = np.zeros(n)
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
            hit = self.names[at] == name
            cell, count = np.unique(row[hit] * len(self.names) + at[hit], return_counts=True)
            np.add.at(x, cell // len(self.names), np.log1p(count) * self.weights[cell % len(self.names)])
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None] - x[:, None], -50, 50)))
        return above.sum(1), above[:, 0]


def _grades(toxic: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """0 for clean rows; 1 to GRADES for toxic ones, by thirds of their number of marked words."""
    cuts = np.quantile(marked[toxic], np.arange(1, GRADES) / GRADES)
    return np.where(toxic, 1 + (marked[:, None] > cuts[None]).sum(1), 0)


def telling(with_: np.ndarray, without: np.ndarray, toxic: int, clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Which features tell the classes apart, and which of those speak for toxic: by the rows of each class that hold them."""
    odds = np.log((with_ + 0.5) / (toxic - with_ + 0.5)) - np.log((without + 0.5) / (clean - without + 0.5))
    spread = np.sqrt(1 / (with_ + 0.5) + 1 / (toxic - with_ + 0.5) + 1 / (without + 0.5) + 1 / (clean - without + 0.5))
    return (np.abs(odds) - 2 * spread > 1) & (with_ + without >= max(LEAST_ROWS, toxic * LEAST_SHARE)), odds > 0


def fit_ordinal(row: np.ndarray, name: np.ndarray, count: np.ndarray, toxic: np.ndarray) -> OrdinalModel:
    """row, name, count: the tally of the fitted rows' features; toxic: a boolean for each row."""
    n = len(toxic)
    if toxic.all() or not toxic.any():
        return OrdinalModel(np.zeros(0, U64), np.zeros(0), np.zeros(0))
    known, at = np.unique(name, return_inverse=True)
    with_, without = np.bincount(at[toxic[row]], minlength=len(known)), np.bincount(at[~toxic[row]], minlength=len(known))
    chosen, positive = telling(with_, without, toxic.sum(), n - toxic.sum())
    number = np.cumsum(chosen) - 1
    held = chosen[at]
    row, at, value = row[held], number[at[held]], np.log1p(count[held])
    size = int(chosen.sum())
    positive = positive[chosen]
    marked = np.bincount(row[positive[at]], count[held][positive[at]], minlength=n)
    grade = _grades(toxic, marked)
    weights, raw = np.zeros(size), np.array([1.0] + [0.0] * (GRADES - 1))  # thresholds: first, then logs of steps
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, raw)]
    for step in range(1, STEPS + 1):
        theta = np.cumsum(np.append(raw[:1], np.exp(raw[1:])))
        x = np.bincount(row, value * weights[at], minlength=n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        with np.errstate(over="ignore"):
            below = 1 / (1 + np.exp(-(edges[None] - x[:, None])))
        slope = below * (1 - below)
        rows = np.arange(n)
        share = np.maximum(below[rows, grade + 1] - below[rows, grade], 1e-12)
        dx = (slope[rows, grade + 1] - slope[rows, grade]) / share / n
        dtheta = np.zeros(GRADES + 2)
        np.add.at(dtheta, grade + 1, -slope[rows, grade + 1] / share / n)
        np.add.at(dtheta, grade, slope[rows, grade] / share / n)
        dtheta = np.cumsum(dtheta[1:-1][::-1])[::-1]
        gradients = [np.bincount(at, value * dx[row], minlength=size) + RIDGE * weights, np.append(dtheta[:1], dtheta[1:] * np.exp(raw[1:]))]
        for p, g, (m, v) in zip((weights, raw), gradients, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(known[chosen], weights, np.cumsum(np.append(raw[:1], np.exp(raw[1:]))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> OrdinalModel:
    """The model of at most `rows` labelled rows of each class."""
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    some = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(rows) for k in (0, 1)]
    some = some[0].union(some[1])  # bounded: 2 * rows ids
    picked = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(some), "id")
    picked = Stage(picked.groupBy("id", "toxic").agg(F.min("text").alias("text")), "labelled")
    try:
        return _fit(picked.df)
    finally:
        picked.drop()


def _tallies(batches):
    """(row's number in the batch, feature, count) of each piece, with the piece's rows."""
    for batch in batches:
        data, offsets = bytes_of(batch.column(2))
        for lo, hi in cut_rows(offsets, PIECE_BYTES):
            row, name, count = tally(*features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            yield batch.slice(lo, hi - lo), row, name, count


def _fit(picked: DataFrame) -> OrdinalModel:
    """picked: at most 2 * rows (id, toxic, text) rows."""
    sizes = {r["toxic"]: r["count"] for r in picked.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return OrdinalModel(np.zeros(0, U64), np.zeros(0), np.zeros(0))

    def held_by(batches):
        """(feature, toxic rows, clean rows), each feature once a piece."""
        for batch, row, name, _ in _tallies(batches):
            is_toxic = np.asarray(batch.column(1)) == 1
            known, at = np.unique(name, return_inverse=True)
            with_ = np.bincount(at[is_toxic[row]], minlength=len(known))
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(with_), pa.array(np.bincount(at, minlength=len(known)) - with_)], names=["name", "with_", "without"])

    counted = picked.select("id", "toxic", "text").mapInArrow(held_by, "name long, with_ long, without long").groupBy("name").agg(F.sum("with_").alias("with_"), F.sum("without").alias("without"))

    def tell(batches):
        for batch in batches:
            chosen, _ = telling(np.asarray(batch.column(1)), np.asarray(batch.column(2)), toxic, clean)
            yield batch.select([0]).filter(pa.array(chosen))

    names = np.sort(np.array([r["name"] for r in counted.mapInArrow(tell, "name long").collect()], np.int64))  # of at most 2 * FIT_ROWS rows
    shared = picked.sparkSession.sparkContext.broadcast(names)

    def send(batches):
        """(id, toxic, names, counts) of each row: the tallies of the chosen features."""
        names = shared.value
        for batch, row, name, count in _tallies(batches):
            name = name.view(np.int64)
            kept = names[np.minimum(np.searchsorted(names, name), len(names) - 1)] == name if len(names) else np.zeros(len(name), bool)
            row, name, count = row[kept], name[kept], count[kept]
            edges = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            arrays = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (name, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), *arrays], names=["id", "toxic", "names", "counts"])

    def fit(table):
        table = table.sort_by([("id", "ascending")])
        names, counts = (table[c].combine_chunks() for c in ("names", "counts"))
        row = np.repeat(np.arange(table.num_rows), np.asarray(pc.list_value_length(names)))
        model = fit_ordinal(row, np.asarray(names.flatten()).view(U64), np.asarray(counts.flatten()), np.asarray(table["toxic"]) == 1)
        return pa.table({"names": pa.array([model.names.view(np.int64)], pa.list_(pa.int64())), "weights": pa.array([model.weights], pa.list_(pa.float64())), "thresholds": pa.array([model.thresholds], pa.list_(pa.float64()))})

    schema = StructType(picked.select("id").schema.fields).add("toxic", "integer").add("names", ArrayType(LongType())).add("counts", ArrayType(IntegerType()))
    told = picked.select("id", "toxic", "text").mapInArrow(send, schema)
    made = told.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(fit, "names array<long>, weights array<double>, thresholds array<double>").first()
    return OrdinalModel(np.array(made["names"], np.int64).view(U64), np.array(made["weights"], float), np.array(made["thresholds"], float))


def _scored(docs: DataFrame, model: OrdinalModel, text: str) -> DataFrame:
    """(doc, expected_severity, grade, toxic): doc is the whole row as a struct, so that no name of its columns matters."""
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.weights, model.thresholds))  # at most the fitted rows' features

    def run(batches):
        model = OrdinalModel(*shared.value)
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            for lo, hi in cut_rows(offsets, PIECE_BYTES):
                severity, toxic = model.severity(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(severity), pa.array(np.rint(severity).astype(np.int32)), pa.array(toxic >= 0.5)], names=["doc", "expected_severity", "grade", "toxic"])

    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("text"))
    schema = StructType(rows.schema.fields[:1]).add("expected_severity", "double").add("grade", "integer").add("toxic", "boolean")
    return rows.mapInArrow(run, schema)


RESULTS = ("expected_severity", "grade", "toxic")


def score_toxicity(docs: DataFrame, model: OrdinalModel, id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """(id, expected_severity, grade, toxic) for each row; carry: behind all columns of docs instead of the id."""
    columns = [c for c in docs.columns if c.lower() not in RESULTS] if carry else [id]
    rows = _scored(docs if carry else docs.select(*dict.fromkeys([id, text])), model, text)
    return rows.select(*(F.col("doc")[c].alias(c) for c in columns), *RESULTS)


def reject_toxic(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """The rows of docs that are not toxic, with its columns as they are."""
    return _scored(docs, model, text).where("not toxic").select(*(F.col("doc")[c].alias(c) for c in docs.columns))
