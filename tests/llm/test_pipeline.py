"""The pipeline's stages against plain versions of what they keep."""

import hashlib

import pyarrow.parquet as pq

import corpus_pipeline
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_its_predecessor_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    held, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in held.collect()}
        held = stage(spark, held, SF)
        assert held.columns == names
        held = spark.createDataFrame(held.collect(), docs.schema)
        seen[name] = (before, {r["doc_id"]: r["text"] for r in held.collect()})
    before, after = seen["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [k for k in before if labels.get(k) == 0]
    assert sum(k in after for k in clean) >= 0.98 * len(clean)
    before, after = seen["exact dedup"]
    groups = {}
    for k, t in before.items():
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append(k)
    assert set(after) == {min(g, key=lambda k: (-len(before[k] or ""), k)) for g in groups.values()}
    before, after = seen["near dedup"]
    assert set(after) == {c for _, c in brute.near_duplicates(before).values()}
    before, after = seen["personal data"]
    assert set(before) == set(after)
    for k, t in before.items():
        counts, _ = brute.personal_data(t)
        assert (after[k] == t) == (not any(counts))
    assert pq.read_table(f"{SF}/documents.parquet").num_rows > len(after) > 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} == set(rows.columns)
    assert rows.count() > 0


def test_dedup_stages_keep_one_row_of_a_group_with_null_and_repeated_ids(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "a"), (1, "a"), (2, "A"), (1, "A"), (None, "alone"), (None, "alone"), (None, "b c"), (3, "bc"), (4, "p q"), (4, "pq")]
    rows += [(None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.exact(spark, df, SF).collect()
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in [(1, "a"), (1, "A"), (None, "alone"), (None, "b c"), (4, "p q"), (None, "")])
    rows = [(1, long), (1, long), (1, long + " x"), (2, long.upper()), (None, long + " y"), (None, "alone here"), (None, "Alone here"), (1, "other"), (None, None), (5, "last"), (None, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near(spark, df, SF).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, min(long, long + " x", key=digest)), (None, min("alone here", "Alone here", key=digest)), (1, "other"), (None, None), (5, "last")]
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in want)


def test_run_packs_what_the_stages_keep(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    held = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = spark.createDataFrame(stage(spark, held, SF).collect(), held.schema)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r["doc_id"]: len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in held.collect()}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r["doc_tokens"] == want[r["doc_id"]]
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


NAMES = ("toxic", "grade", "Expected_Severity", "_text", "_kept", "_row", "_place", "key", "doc", "place", "kept", "row", "hash", "digest", "norm", "class", "size", "_doc", "_spans")


def test_names_of_further_columns_do_not_matter(spark):
    from pyspark.sql import functions as F

    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "a b"), (2, "ab"), (3, long), (4, long + " x"), (None, None), (5, "mail a@b.co"), (6, "mail a@b.co now"), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(k).alias(c) for k, c in enumerate(NAMES)), F.create_map(F.lit("k"), F.lit(1)).alias("map"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        kept[name] = sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect())
        assert all(r[c] == k for r in out.collect() for k, c in enumerate(NAMES))
        none = stage(spark, df.limit(0), SF)
        assert none.columns == df.columns and none.count() == 0
    every = sorted((str(i), str(t)) for i, t in rows)
    assert kept["toxicity"] == every
    # of the two empty texts, whose ids are null, one stays
    assert [k for k in kept["exact dedup"] if k[0] != "None"] == sorted((str(i), t) for i, t in rows if i not in (None, 2)) and len(kept["exact dedup"]) == 6
    assert kept["near dedup"] == sorted(x for x in every if x[0] != "4")
    assert ("5", "mail [EMAIL]") in kept["personal data"] and len(kept["personal data"]) == len(rows)
    packed = corpus_pipeline.packing(spark, df, SF)
    assert sum(r["length"] == r["doc_tokens"] for r in packed.collect()) == len(rows)
    assert corpus_pipeline.packing(spark, df.limit(0), SF).count() == 0
