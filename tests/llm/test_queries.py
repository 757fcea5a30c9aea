"""Registered queries against their SQL, or against plain versions, on the smallest tables."""

import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from lattica.llm import queries
from tests.compare import same, tables
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] for r in rows}


def collected(spark, name):
    return queries.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    tables(con, SF)
    same(queries.queries()[name](spark, SF), con.execute(queries.oracle_sql()[name]))


def test_op2_against_the_library(spark, docs):
    import tiktoken

    from lattica.llm.bpe import read_ranks

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: tuple(r)[1:4] for r in collected(spark, "op2_byte_bpe")}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = {}
    for k, t in docs.items():
        ids = enc.encode_ordinary(t or "")
        want[k] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))
    assert got == want


def test_op3_against_the_library(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = {}, {}
    for r in collected(spark, "op3_packing"):
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    for k, t in docs.items():
        ids, at = tok.encode(t or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(pieces[k], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), brute.piece_rows(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    for spots in sequences.values():
        assert [o for o, _ in sorted(spots)] == [sum(n for _, n in sorted(spots)[:k]) for k in range(len(spots))]
        assert sum(n for _, n in spots) <= 4096


def test_op5_against_all_pairs(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collected(spark, "op5_minhash")}
    assert got == brute.near_duplicates(docs)


def test_op6_against_every_string(spark, docs):
    assert {r["doc_id"]: tuple(r)[1:5] for r in collected(spark, "op6_suffix_array")} == brute.repeats(docs)


def test_op7_base_against_plain_patterns(spark, docs):
    for r in collected(spark, "op7_pii"):
        counts, told = brute.personal_data(docs[r["doc_id"]])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == counts
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(r["spans"].split(","))


def test_op1_scores_are_the_model_s(spark, docs):
    from lattica.llm import toxicity
    from lattica.llm.common import load

    model = toxicity.fit_toxicity(load(spark, SF, "documents"), load(spark, SF, "labels"))
    got = {r["doc_id"]: r for r in collected(spark, "op1_toxicity")}
    assert set(got) == set(docs)
    for k, t in docs.items():
        severity, above = brute.severity(t, model)
        assert got[k]["expected_severity"] == pytest.approx(severity, abs=1e-9)
        assert got[k]["kept"] != got[k]["toxic"] and got[k]["toxic"] == (above >= 0.5)
    labels = {r["doc_id"]: r["toxic"] for r in load(spark, SF, "labels").collect() if r["toxic"] is not None}
    assert sum(got[k]["toxic"] == (y == 1) for k, y in labels.items()) >= 0.9 * len(labels)


def test_op9_dictionaries_hold_whole_texts_and_scores_are_the_model_s(spark, docs):
    from lattica.llm import quality
    from lattica.llm.common import load

    third = F.crc32(F.col("doc_id").cast("string")) % 3
    learnt = load(spark, SF, "labels").where((third != 1) & F.col("quality").isNotNull())
    model = quality.fit_quality(load(spark, SF, "documents"), learnt)
    bad, good, slope, shift = model.parts
    rows = [(r["rank"], r["doc_id"], r["quality"]) for r in learnt.select("doc_id", "quality", F.xxhash64("doc_id").alias("rank")).collect() if r["doc_id"] in docs]
    raw = [((docs[i] or "").encode(), y) for _, i, y in sorted(rows)]
    bound = min(quality.DICTIONARY_BYTES, min(sum(len(t) for t, y in raw if y == k) for k in (0, 1)) * quality.TENTHS // 10)
    for k, made in ((0, bad), (1, good)):
        held, used = [], 0
        for t in (t for t, y in raw if y == k and t):
            if used + len(t) + 1 <= bound:
                held.append(t)
                used += len(t) + 1
        assert made == b"\n".join(held)
    zips = []
    for part in (bad, good):
        zips.append(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(part, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=quality.LEVEL, write_content_size=False, write_dict_id=False))
    got = {r["doc_id"]: r for r in collected(spark, "op9_quality")}
    assert set(got) == set(docs) and {r["held_out"] for r in got.values()} == {True, False}
    for k, t in docs.items():
        text = (t or "").encode()
        x = (len(zips[0].compress(text)) - len(zips[1].compress(text))) / len(text) if text else 0.0
        assert got[k]["score"] == pytest.approx(1 / (1 + np.exp(-(slope * x + shift))), abs=0.02)
        assert got[k]["predicted"] == (got[k]["score"] >= 0.5)
