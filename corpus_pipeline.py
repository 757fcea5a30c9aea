"""A corpus pipeline: reject toxic documents, keep one of equal and one of similar texts, redact
personal data, and pack what is left into sequences.

Each stage is given what the stage before kept, with the columns of documents; the last returns
the packed pieces. run() writes each stage's rows to the cluster's shared folder and reads them again.

Null and repeated ids: the two dedup stages tell rows apart by id and text and keep exactly one row of
each group. The exact stage keeps the longest text, then the least id; the near stage the least id, then
the least SHA-256 of the text. Null ids come last in both, and rows that are still alike go by the order
of their text and then of the whole row as JSON. A null text is equal to an empty or blank one, is never
toxic, has nothing to redact and is packed as its end id. An empty table goes through all stages as one.
Further columns of any name and type are kept as they are by all stages but the last, which packs doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import Stage, load
from lattica.llm.exact_dedup import exact_dedup, normalised
from lattica.llm.minhash import minhash_dedup
from lattica.llm.packing import pack_documents
from lattica.llm.pii import redact
from lattica.llm.toxicity import fit_toxicity, reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_toxicity(docs, load(spark, sf_dir, "labels"))
    return reject_toxic(docs, model)


def _first_of(docs: DataFrame, row: Column, verdicts: DataFrame, row_of: str) -> DataFrame:
    """One row of docs for each (doc_id, row) that a verdict keeps; docs' rows stand in a struct, whatever their names."""
    key = lambda i, r: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("-")), F.coalesce(r, F.lit("-")))
    kept = verdicts.where("kept").select(key(F.col("doc_id"), F.col(row_of)).alias("key")).distinct()
    doc = F.col("doc")
    held = docs.select(key(F.col("doc_id"), row).alias("key"), F.struct(*docs.columns).alias("doc")).join(kept, "key", "left_semi")
    first = Window.partitionBy("key").orderBy(F.length(doc["text"]).desc_nulls_last(), doc["text"], F.to_json(doc))
    return held.withColumn("place", F.row_number().over(first)).where("place = 1").select(*(doc[c].alias(c) for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _first_of(docs, F.sha2(normalised(F.col("text")).cast("binary"), 256), exact_dedup(docs), "text_sha256")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.sha2(F.col("text").cast("binary"), 256)
    return _first_of(docs, row, minhash_dedup(docs, row=row), "row")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("personal data", personal_data), ("packing", packing)]

#: The model, the signatures and the packing are not SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Stage(stage(spark, docs, sf_dir), name.replace(" ", "-")).df
    return STAGES[-1][1](spark, docs, sf_dir)
