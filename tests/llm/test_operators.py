"""Each operator on small tables, against plain versions, with nulls, blanks, ties, repeats and clashing columns."""

import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import bpe, embedding, exact_dedup, minhash, packing, pii, quality, suffix, toxicity, warc
from tests.llm import brute

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: Names that operators use inside; as further columns of an input they must not disturb.
CLASH = {"id": "x", "text_sha256": "y", "class": "z", "row": 3, "component_id": 9, "size": 1, "kept": "no", "norm": "n", "_hash": 1, "label_": 0}


def prose(rng, n, words=None):
    words = words or [f"w{k}" for k in range(3000)]
    return " ".join(rng.choice(words) for _ in range(n))


def near_texts():
    rng = random.Random(1)
    base = prose(rng, 120).split()
    docs = {}
    for k in range(40):  # a dense group around a base, many pairs of which are not similar
        t = base[:]
        for _ in range(rng.randrange(8)):
            t[rng.randrange(len(t))] = f"edit{k}x{rng.randrange(99)}"
        docs[100 + k] = " ".join(t)
    for k in range(30):
        docs[k] = prose(rng, rng.randrange(3, 60))
    chain = prose(rng, 100).split()
    for k in range(12):  # each similar to the next only
        docs[200 + k] = " ".join(chain[6 * k :] + [f"tail{j}" for j in range(6 * k)])
    docs[300], docs[301] = docs[100].upper().replace(" ", "\n\t"), docs[100]
    docs.update({400: None, 401: "", 402: " \n", 403: "one two", 404: "one  TWO", 405: "one two three", 406: "ÄÖ é", 407: "äö é"})
    docs[500] = prose(rng, 4000)
    docs[501] = docs[500] + " end"
    return docs


def frame(spark, docs, clash=True):
    df = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit(v).alias(k) for k, v in CLASH.items()]) if clash else df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_near_duplicates(spark):
    docs = near_texts()
    got = {r["doc_id"]: r for r in minhash.minhash_dedup(frame(spark, docs)).collect()}
    want = brute.near_duplicates(docs)
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == want
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())
    assert len({c for _, c in want.values()}) < len(want) - 25
    assert minhash.minhash_dedup(empty(spark)).count() == 0


def shared_clause_texts():
    """Two similar texts whose buckets all hold longer, unlike texts of the same clause with lesser classes."""
    rng = random.Random(7)
    clause = prose(rng, 100)
    docs = {k: f"{clause} {prose(rng, 62, [f'o{k}x{j}' for j in range(900)])}" for k in range(400)}

    def class_of(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return minhash.class_of(minhash.shingle_sets(data, np.array([0, len(data)]))[0])

    for k in (1000, 1001):
        docs[k] = max((f"{clause} {prose(rng, 9)}" for _ in range(2000)), key=class_of)
    return docs


def test_near_duplicates_that_meet_beside_an_unlike_centre(spark):
    docs = shared_clause_texts()
    want = brute.near_duplicates(docs)
    assert want[1001][1] == 1000 and len({c for _, c in want.values()}) == len(docs) - 1
    got = minhash.minhash_dedup(frame(spark, docs)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize("rows", [2000, 7])
def test_blocks_of_a_bucket(spark, monkeypatch, rows):
    monkeypatch.setattr(minhash, "MEET_ROWS", rows)
    rng = np.random.default_rng(3)
    signatures = rng.integers(0, 9, (40, minhash.SYMBOLS)).astype(np.uint16)
    signatures[30] = signatures[11]
    signatures[30, :40] += 20
    blob = minhash._squeeze(minhash._spread_sorted(np.full(40, 5, np.uint64)), np.arange(40), np.arange(40))
    members = minhash._mixed(pa.table({"blob": pa.array([blob], pa.binary())})).to_pylist()
    frame_ = spark.createDataFrame([(m["meet"], m["class"], m["cluster"], m["part"], m["parts"], 50, signatures[m["class"]].tobytes()) for m in members], "meet long, class long, cluster long, part int, parts int, n long, signature binary")
    blocks = minhash._blocks(frame_, "meet", ["class", "cluster", "n", "signature"]).groupBy("meet", "p", "q")
    assert [tuple(r) for r in blocks.applyInArrow(minhash._across_signatures, "a long, b long").collect()] == [(11, 30)]


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rng = random.Random(2)
    a, b = prose(rng, 50), prose(rng, 50)
    rows = [(1, a), (1, a), (1, b), (None, a), (2, b + " x"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in minhash.minhash_dedup(df).collect())
    assert got == sorted([("1", "1"), ("1", "1"), ("1", "1"), ("None", "1"), ("2", "1"), ("None", "None")])


def test_exact_duplicates(spark):
    docs = {1: "a b", 2: "ab\n", 3: "a  b ", 4: None, 5: "", 6: " \t\x0b", 7: "a\xa0b", 8: "long", 9: "l o n g", 10: "L"}
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(frame(spark, docs)).collect()}
    assert {k: (r["keep_id"], r["group_size"], r["kept"]) for k, r in got.items()} == {
        1: (3, 3, False), 2: (3, 3, False), 3: (3, 3, True), 4: (6, 3, False), 5: (6, 3, False), 6: (6, 3, True),
        7: (7, 1, True), 8: (9, 2, False), 9: (9, 2, True), 10: (10, 1, True),
    }
    assert got[1]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_duplicates_when_digests_collide(spark):
    """Texts that share a digest are told apart by their bytes."""
    docs = {k: f"text {k % 7}" for k in range(40)}
    weak = lambda norm: F.unhex(F.lpad(F.hex(F.length(norm)), 64, "0"))
    got = exact_dedup.exact_dedup(frame(spark, docs), digest=weak).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(k, k % 7, len(range(k % 7, 40, 7))) for k in docs}


def test_snapshot_and_batch(spark):
    docs = {k: f"text {k % 10}" for k in range(60)}
    df = frame(spark, docs, clash=False)
    for old in (F.col("doc_id") < 30, F.lit(True), F.lit(False), F.lit(None).cast("boolean")):
        got = exact_dedup.exact_dedup(df, in_snapshot=old).collect()
        assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(k, k % 10, 6) for k in docs}


def test_repeats(spark):
    rng = random.Random(3)
    passage, other = prose(rng, 40, ["alpha", "beta", "gamma", "delta", "é"]), "x" * 400
    docs = {k: prose(rng, 30) + passage[k:] + prose(rng, 10) for k in range(12)}
    docs.update({20: None, 21: "", 22: passage[:30], 23: other, 24: other + "y", 25: other[:60], 26: docs[0], 27: docs[0], 28: "ab" * 100, 29: "ab" * 60 + "c"})
    docs[30] = passage[:49] + "#" + passage[50:99]
    docs[31] = prose(rng, 20) + passage[:50] + passage[10:60]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.remove_repeats(frame(spark, docs), finish=suffix.digest_output).collect()}
    assert got == brute.repeats(docs)
    real = {r["doc_id"]: r for r in suffix.remove_repeats(frame(spark, docs)).collect()}
    for k, r in real.items():
        raw = (docs[k] or "").encode()
        kept = b"".join(raw[a:b] for a, b in zip([0] + [s["end"] for s in r["spans"]], [s["start"] for s in r["spans"]] + [len(raw)], strict=True))
        assert bytes(r["kept"]) == kept
    assert suffix.remove_repeats(empty(spark)).count() == 0


def test_repeats_with_null_and_repeated_ids(spark):
    rng = random.Random(14)
    a, b = prose(rng, 30), prose(rng, 30)
    rows = [(1, a), (1, a), (None, a), (1, a + b), (2, b), (2, b), (3, "short"), (3, "short"), (None, None), (None, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix.remove_repeats(df, finish=suffix.digest_output).collect())
    x, y = len(a), len(b)
    assert got == sorted([("1", x, 0, 0), ("1", x, 0, 0), ("None", x, x, 1), ("1", x + y, 0, 0), ("2", y, y, 1), ("2", y, y, 1), ("3", 5, 0, 0), ("3", 5, 0, 0), ("None", 0, 0, 0), ("None", y, y, 1)])


@pytest.mark.parametrize("segment", [1 << 20, 256])
def test_repeat_groups(spark, monkeypatch, segment):
    """Each group has all occurrences of its string over the anchor, and the groups cover every repeat."""
    monkeypatch.setattr(suffix, "SEGMENT_BYTES", segment)
    rng = random.Random(13)
    passage = prose(rng, 40)
    docs = {k: prose(rng, 10) + passage[7 * k :] + prose(rng, 5) + passage[: 60 + k] for k in range(9)} | {20: None, 21: passage, 22: passage}
    found = {}
    for r in suffix.repeat_groups(frame(spark, docs)).collect():
        found.setdefault((r["repeat"], r["length"]), set()).add((r["doc_id"], r["start"]))
    want = brute.repeat_groups({k: t for k, t in docs.items() if k != 22}, 50, 18)
    assert {frozenset((d, s, n) for d, s in places) for (_, n), places in found.items()} == want
    assert suffix.repeat_groups(empty(spark)).count() == 0


def test_repeats_over_segments(spark, monkeypatch):
    rng = random.Random(4)
    long = prose(rng, 300)
    docs = {1: long, 2: prose(rng, 20) + long[500:900] + prose(rng, 30), 3: long[:700]}
    monkeypatch.setattr(suffix, "SEGMENT_BYTES", 256)
    table = suffix.remove_repeats(frame(spark, docs), finish=suffix.digest_output)
    assert {r["doc_id"]: tuple(r)[1:] for r in table.collect()} == brute.repeats(docs)


def test_byte_bpe(spark):
    rng = random.Random(5)
    docs = {k: prose(rng, rng.randrange(50), ["it's", "a", "\n\n", "Tab\t", "né", "12", "!!", " we'll", "  "]) for k in range(40)}
    docs.update({50: None, 51: "", 52: " " * 300 + "x", 53: "<|endoftext|>"})
    enc = bpe._encoder(RANKS, PATTERN)
    want = {k: enc.encode_ordinary(t or "") for k, t in docs.items()}
    real = bpe.encode_documents(frame(spark, docs), RANKS, PATTERN)
    got = {r["doc_id"]: r for r in real.collect()}
    assert {k: list(r["ids"]) for k, r in got.items()} == want
    assert {k: bytes(r["decoded"]).decode() for k, r in got.items()} == {k: t or "" for k, t in docs.items()}
    again = bpe.decode_ids(real.select("doc_id", "ids"), RANKS).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in again} == {k: t or "" for k, t in docs.items()}
    digests = {r["doc_id"]: r for r in bpe.encode_documents(frame(spark, docs), RANKS, PATTERN, bpe.digest_output).collect()}
    for k, ids in want.items():
        assert digests[k]["n_tokens"] == len(ids)
        assert digests[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_documents(empty(spark), RANKS, PATTERN).count() == 0
    odd = bpe.encode_documents(frame(spark, {1: "ab 12", 2: None}), RANKS, r"[a-z]+|\s+|\d")
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in odd.collect()} == {1: "ab 12", 2: ""}


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    docs = {k: prose(rng, rng.randrange(80)) for k in range(60)} | {100: None, 101: "", 102: prose(rng, 900)}
    rows = packing.pack_documents(frame(spark, docs), WORDS, window=256).collect()
    tok = Tokenizer.from_file(WORDS)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, t in docs.items():
        ids, at = tok.encode(t or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(pieces[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == brute.piece_rows(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for spots in sequences.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in rows)
    assert total >= 0.93 * 256 * len(sequences)
    assert packing.pack_documents(empty(spark), WORDS).count() == 0
    ids = packing.tokenise(frame(spark, {1: "Hello WORLD", 2: None}), WORDS).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in ids} == {1: tok.encode("Hello WORLD", add_special_tokens=False).ids, 2: []}


PERSONAL = [
    "mail a.b+c@x-1.example.com, or a@b.c.d@e.f and a@b.com_x@y.com; not a@b",
    "hosts 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 1.2.3",
    "cards 4539 1488 0343 6467 and 4539148803436468, 4111-1111-1111-1111; 1  2",
    "call +1 (988) 555-2485 or +44 20 7946 0958. +1 ( and +12345678 then ++1 22 333 4444",
    "é+1 (988) 555-2485 4111111111111111 10.1.1.1 q@é.com q@e.com",
    None,
    "",
    "7" * 5000 + " " + "a" * 5000 + "@x.yz " + "1-" * 3000 + "1",
    "x@y.z" * 40,
    "call me at (212) 555-0187 or 212.555.0188, version 212.555.0189",
]


def test_personal_data(spark):
    docs = dict(enumerate(PERSONAL))
    got = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, docs)).collect()}
    for k, t in docs.items():
        counts, told = brute.personal_data(t)
        r = got[k]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == counts, t
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest(), t
        assert set(filter(None, told.split(","))) <= set(r["spans"].split(","))
    assert pii.find_personal_data(empty(spark)).count() == 0
    plan = pii.find_personal_data(frame(spark, docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_personal_data_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (1, "10.0.0.1"), (None, "a@b.co")], "doc_id long, text string")
    got = sorted((r["n_email"], r["n_ip"], r["spans"]) for r in pii.find_personal_data(df).collect())
    assert got == [(0, 1, "ip:0:8"), (1, 0, "email:0:6"), (1, 0, "email:0:6"), (1, 0, "email:0:6")]


def test_redaction(spark):
    docs = {1: "é a@b.co, 10.0.0.1!", 2: "clean", 3: None, 4: "a@b.co"}
    rows = pii.redact(frame(spark, docs)).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {1: "é [EMAIL], [IP]!", 2: "clean", 3: None, 4: "[EMAIL]"}
    assert rows[0].asDict().keys() == {"doc_id", "text", *CLASH}


def test_labelers_are_weighed_by_agreement():
    table = [("email", (1, 1, 1), 80), ("email", (1, 1, -1), 15), ("email", (-1, -1, -1), 60), ("email", (-1, -1, 1), 20), ("email", (-1, 1, 0), 3)]
    truth, hit = pii.estimate(table)
    assert truth["email", (1, 1, -1)] > 0.8 > 0.2 > truth["email", (-1, -1, 1)]
    assert hit["email", 0, 1] > hit["email", 2, 1]
    weights = pii.train(table, truth)["email"]
    assert weights[1] > weights[3]
    assert pii.estimate([]) == ({}, {}) and pii.train([], {}) == {}


def test_archives(spark, tmp_path):
    big = "<p>é</p>" * 200
    pages = {1: big, 2: big, 3: "small", 4: "small", 5: None, 6: big + " ", 7: ""}
    rows = [(k, None if k == 3 else f"http://x/{k}", h) for k, h in pages.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    df = df.select("*", *[F.lit("x").alias(c) for c in ("size", "digest", "sha", "_sha", "part", "pages", "refers_to", "response", "records")])
    made = warc.archive(df, f"{tmp_path}/out")
    got = {r["page_id"]: r for r in made.collect()}
    for k, h in pages.items():
        raw = (h or "").encode()
        assert (got[k]["payload_bytes"], got[k]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {k: r["refers_to"] for k, r in got.items()} == {1: 2, 2: None, 3: None, 4: None, 5: None, 6: None, 7: None}
    assert {k for k, r in got.items() if r["record_type"] == "revisit"} == {1}
    assert got[1]["url"] == "http://x/1" and got[3]["url"] == ""
    assert any(n.endswith(".warc.gz") for n in os.listdir(tmp_path / "out"))
    assert warc.archive(df.limit(0)).count() == 0


def test_archives_with_null_and_repeated_pages(spark, tmp_path):
    big, other = "x" * 1200, "y" * 1000
    rows = [(1, "a", big), (1, "a", big), (9, "b", big), (9, "c", big), (None, "d", big), (4, None, other), (4, None, other), (None, None, None), (None, "e", "s"), (2, "f", "s")]
    made = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"{tmp_path}/out").collect()
    got = sorted(((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in made), key=str)
    want = [("1", 1200, "revisit", 9)] * 2 + [("9", 1200, "response", None)] * 2 + [("None", 1200, "response", None)] + [("4", 1000, "response", None)] * 2
    assert got == sorted([*want, ("None", 0, "response", None), ("None", 1, "response", None), ("2", 1, "response", None)], key=str)


def test_only_counted_parts_are_read(spark, tmp_path):
    """What a lost attempt leaves in the folder is not read; a part that is cut short or a lost record fails the job."""
    df = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), F.col("id").cast("string")).alias("html"))
    rows = df.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("refers_to", F.lit(None).cast("long"))
    path = f"{tmp_path}/parts"
    first = warc.write_archives(rows, path, part_bytes=2000).collect()
    parts = warc.write_archives(rows, path, part_bytes=3000).collect()  # a second attempt, cut elsewhere
    kind = "part string, records long, bytes long"
    table = spark.createDataFrame(parts, kind)
    assert sorted(r["page_id"] for r in warc.read_parts(table, path).collect()) == list(range(40))
    assert warc.read_archives(spark, path).count() == 80 and not {p["part"] for p in first} & {p["part"] for p in parts}
    wrong = spark.createDataFrame([(p["part"], p["records"] + 1, p["bytes"]) for p in parts], kind)
    with pytest.raises(Exception, match="records of"):
        warc.read_parts(wrong, path).collect()
    with pytest.raises(Exception, match="part-none"):
        warc.read_parts(spark.createDataFrame([("part-none.warc.gz", 1, 1)], kind), path).collect()


def test_small_archive_parts(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), F.col("id").cast("string")).alias("html"))
    rows = df.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("refers_to", F.lit(None).cast("long"))
    parts = warc.write_archives(rows, f"{tmp_path}/parts", part_bytes=2000).collect()
    assert len(parts) > 4 and sum(p["records"] for p in parts) == 50
    assert sorted(r["page_id"] for r in warc.read_archives(spark, f"{tmp_path}/parts").collect()) == list(range(50))


def vectors():
    rng = np.random.default_rng(7)
    rows = []
    centre = rng.standard_normal((4, 16))
    for k in range(160):
        rows.append((k, (centre[k % 4] + 0.07 * rng.standard_normal(16)).astype(np.float32).tolist(), k % 3))
    rows += [(200, rows[5][1], rows[5][2]), (201, [2 * x for x in rows[5][1]], rows[5][2]), (202, rows[5][1], None), (203, None, 1), (204, [0.0] * 16, 1)]
    rows += [(205, [None, *rows[5][1][1:]], 1), (206, [float("nan"), *rows[5][1][1:]], 1), (207, [float("inf"), *rows[5][1][1:]], 1), (208, rows[5][1][:5], 1), (209, [-0.0] * 15 + [1.0], 1), (210, [0.0] * 15 + [1.0], 1), (211, [], 1)]
    return rows


@pytest.mark.parametrize(("blocks", "grid", "cell"), [(4, 2, 2000), (8, 1, 7), (1, 3, 2000), (16, 1, 3)])
def test_embedding_links(spark, monkeypatch, blocks, grid, cell):
    monkeypatch.setattr(embedding, "CELL_ROWS", cell)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).withColumn("class", F.lit("c")).withColumn("size", F.lit(5))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding.embedding_dedup(df, blocks=blocks, grid=grid).collect()}
    assert got == brute.embedding_links(rows)


def test_embedding_edge_cases(spark):
    kind = "vec_id long, embedding array<double>, label string"
    assert embedding.embedding_dedup(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (None, [1.0, 0.0], "a"), (2, [1e200, 1e199], "a"), (3, [1e-200, 0.0], "a")]
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in embedding.embedding_dedup(spark.createDataFrame(rows, kind)).collect())
    assert got == [("1", 0, 1), ("1", 4, 1), ("1", 4, 1), ("2", 4, 1), ("3", 4, 1), ("None", 4, 1)]


def test_toxicity(spark):
    rng = random.Random(8)
    words = [f"word{k}" for k in range(400)]
    docs = {k: prose(rng, 40, words) + (" idiot scum" if k % 9 == 0 else "") for k in range(600)} | {900: None, 901: "", 902: "Idiot! " * 30}
    df = frame(spark, docs)
    labels = spark.createDataFrame([(k, int(k % 9 == 0)) for k in range(0, 400)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(df, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model).collect()}
    assert {k for k, r in got.items() if r["toxic"]} == {k for k in docs if k % 9 == 0 and k < 900} | {902}
    assert got[902]["expected_severity"] > got[9]["expected_severity"] > got[1]["expected_severity"]
    carried = toxicity.score_toxicity(df, model, carry=True)
    assert carried.columns == [*df.columns, "expected_severity", "grade", "toxic"]
    for bare in (labels.limit(0), labels.where("toxic = 0")):
        none = toxicity.fit_toxicity(df, bare)
        assert toxicity.score_toxicity(df, none).where("toxic or expected_severity > 0").count() == 0
    assert toxicity.score_toxicity(empty(spark), model).count() == 0


def test_quality(spark):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("bar", "ten", "lo", "mir") for b in ("na", "ti", "sho", "ke", "len")]
    docs = {k: prose(rng, 60, words) if k % 4 else (prose(rng, 6, words).upper() + "!! ") * 10 for k in range(400)} | {900: None, 901: ""}
    df = frame(spark, docs)
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(300)] + [(1, None)], "doc_id long, quality int")
    model = quality.fit_quality(df, labels)
    got = {r["doc_id"]: r for r in quality.score_quality(df, model).collect()}
    held = [k for k in range(300, 400)]
    assert sum(got[k]["predicted"] == int(k % 4 > 0) for k in held) >= 95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert got[900]["score"] == got[901]["score"]
    none = quality.fit_quality(df, labels.limit(0))
    assert {r["score"] for r in quality.score_quality(df, none).collect()} == {0.5}
    assert quality.score_quality(empty(spark), model).count() == 0


def test_components(spark):
    from lattica.llm.components import connected_components

    rng = random.Random(10)
    links = [(k, k + 1) for k in range(60)] + [(100, 160 + k) for k in range(30)] + [(200, 200), (5, 5), (301, 300), (300, 301)]
    links += [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(60)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    nodes = {x for e in links if e[0] != e[1] for x in e}
    assert got == brute.components(nodes, [e for e in links if e[0] != e[1]])
    assert connected_components(df.limit(0)).count() == 0
