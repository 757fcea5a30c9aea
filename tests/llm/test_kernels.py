import random
import re

import numpy as np
import public_tokenizers
import pytest

from lattica.llm import bpe, common, exact_dedup, minhash, packing, pretok, suffix, toxicity, warc
from tests.llm import brute

ALPHABET = ["a", "b", " ", "  ", "'s", "'re", "'", "''", "\n", "\t", "é", "中", "٣", "7", "!", "…", " x", "'ll", " ", " ", "\x1c", "\x85", "İ", "é", "😀", "Don't", "I'M"]


def texts(n, seed, size=25):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(size))) for _ in range(n)]


def packed(strings):
    raw = [s.encode() for s in strings]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)


def test_byte_level_words_are_the_library_s():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    single = {bytes([i]): i for i in range(256)}
    enc = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=single, special_tokens={})
    whole = bpe._encoder(path, public_tokenizers.PATTERN)
    strings = texts(400, 1) + ["", " ", "\n", "'", "it's  a\n\n 'test' we'll 12'3"]
    data, offsets = packed(strings)
    starts = bpe.word_starts(data, offsets, public_tokenizers.PATTERN)
    for k, s in enumerate(strings):
        mine = starts[(starts >= offsets[k]) & (starts < offsets[k + 1])]
        cut = np.append(mine, offsets[k + 1])
        words = [data[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
        assert b"".join(words) == s.encode()
        assert [i for w in words for i in whole._encode_single_piece(w)] == whole.encode_ordinary(s), s
    assert enc.encode_ordinary("ab") == [97, 98]


def test_lower_case_words_give_the_library_s_ids():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, plain = packing.WordTokenizer(path), Tokenizer.from_file(path)
    strings = texts(300, 2) + ["", "<|endoftext|> x", "ΑΣ ΟΔΟΣ", "ǅ İstanbul", "A1B22c's 'Tis"]
    data, offsets = packed(strings)
    for some in (strings, [s for s in strings if "<|" not in s and tok._plain(s)]):
        data, offsets = packed(some)
        ids, edges = tok.encode(data, offsets)
        for k, s in enumerate(some):
            assert ids[edges[k] : edges[k + 1]].tolist() == plain.encode(s, add_special_tokens=False).ids, s


def test_words_and_shingles():
    strings = ["A b c", "", "  x\ty\x0bz w v u  ", "one two three four five six", " q  "]
    data, offsets = packed(strings)
    starts, ends, first = common.words_of(data, offsets)
    for k, s in enumerate(strings):
        assert [data[a:b].tobytes().decode() for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)] == re.findall(r"[^\x20\x09-\x0D]+", s)
    sets = minhash.shingle_sets(data, offsets)
    assert [len(x) for x in sets] == [len(brute.shingles(s)) for s in strings]
    upper = minhash.shingle_sets(*packed([s.upper() if s.isascii() else s for s in strings]))
    assert all((a == b).all() for a, b in zip(sets, upper, strict=True))


def test_long_spans_hash_alike_in_any_window():
    data = np.frombuffer(random.Random(3).randbytes(5000), np.uint8)
    starts = np.arange(0, 5000, 50)
    whole = common.span_hashes(data, starts, starts + 50)
    assert (common.span_hashes(data, starts, starts + 50, most=64) == whole).all()
    again = common.span_hashes(np.tile(data, 2), np.append(starts, starts + 5000), np.append(starts, starts + 5000) + 50)
    assert (again[:100] == again[100:]).all() and len(np.unique(whole)) == 100


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 20_000])
def test_fuse_filter(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    made = exact_dedup.FuseFilter.from_bytes(exact_dedup.FuseFilter.build(keys).to_bytes())
    assert made.holds(keys).all()
    others = np.random.default_rng(n + 1).integers(0, 1 << 63, 50_000, dtype=np.uint64)
    assert made.holds(others).mean() < 0.01 or n == 0
    assert n < 1000 or len(made.table) < 1.3 * n + 2000


def test_pigeonhole_finds_every_pair_under_the_distance():
    rng = np.random.default_rng(4)
    for _ in range(200):
        one = rng.integers(0, 1 << 16, minhash.SYMBOLS, dtype=np.uint16)
        two = one.copy()
        wrong = rng.choice(minhash.SYMBOLS, 2 * minhash.CHUNKS - 1, replace=False)
        two[wrong] ^= 1
        a, b = minhash.bucket_keys(np.stack([one, two]))
        assert set(a.tolist()) & set(b.tolist())


def test_sum_of_squares_rule():
    rng = np.random.default_rng(5)
    lengths = np.sort(rng.integers(1, 60, 300))[::-1]
    sequence, offset = packing.sum_of_squares(lengths, 64)
    fill = np.zeros(65, int)
    where = {}
    for s, seq, at in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        def after(level):
            new = fill.copy()
            if level:
                new[level] -= 1
            if level + s < 64:
                new[level + s] += 1
            return int((new**2).sum())

        choices = [h for h in range(1, 64 - s + 1) if fill[h]] + [0]
        assert after(at) == min(map(after, choices))
        assert where.get(seq, 0) == at
        if at:
            fill[at] -= 1
        if at + s < 64:
            fill[at + s] += 1
        where[seq] = at + s
    assert max(where.values()) <= 64 and lengths.sum() >= 0.9 * 64 * len(where)


def plain_intervals(lcp, least):
    n, out = len(lcp), set()
    for a in range(n):
        for b in range(a + 1, n):
            d = min(lcp[a + 1 : b + 1])
            if d >= least and (a == 0 or lcp[a] < d) and (b == n - 1 or lcp[b + 1] < d):
                out.add((a, b, d))
    return out


def test_interval_tree():
    rng = np.random.default_rng(6)
    for _ in range(200):
        lcp = np.append(0, rng.integers(0, 6, rng.integers(0, 14)))
        tree = suffix.lcp_intervals(lcp, 2)
        assert {tuple(x[:3]) for x in tree.tolist()} == plain_intervals(lcp.tolist(), 2)
        for a, b, d, parent in tree.tolist():
            outside = [z for x, y, z, _ in tree.tolist() if x <= a and b <= y and z < d]
            assert parent == max([1, *outside])


def test_maximal_repeats():
    rng = random.Random(7)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(3)]
        want = {}
        every = {t[i:j] for t in strings for i in range(len(t)) for j in range(i + 2, len(t) + 1)}
        for s in every:
            at = [(d, i) for d, t in enumerate(strings) for i in range(len(t) - len(s) + 1) if t[i : i + len(s)] == s]
            if len(at) < 2:
                continue
            before = {strings[d][i - 1] if i else (d, i) for d, i in at}
            after = {strings[d][i + len(s)] if i + len(s) < len(strings[d]) else (d, i) for d, i in at}
            if len(before) > 1 and len(after) > 1:
                want[s] = at
        assert dict(suffix.maximal_repeats(strings, 2)) == want


def test_equal_strings_have_equal_anchors():
    rng = random.Random(8)
    passage = bytes(rng.choice(b"abc ") for _ in range(300))
    places = []
    for k in range(20):
        text = bytes(rng.choice(b"abc ") for _ in range(rng.randrange(200))) + passage + bytes(rng.choice(b"abc ") for _ in range(100))
        a = suffix.Anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 50, 18)
        at = text.index(passage)
        of = {}
        for p, lo, hi in zip(a.place, a.first, a.last, strict=True):
            for s in range(lo, hi + 1):
                of[s] = p
        assert sorted(of) == list(range(len(text) - 49))
        places.append([of[at + s] - at for s in range(251)])
    assert all(p == places[0] for p in places)


def test_warc_records():
    import gzip
    import hashlib

    body = "<p>é</p>" * 300
    digest = hashlib.sha1(body.encode()).digest()
    raw = warc.warc_record(7, "http://a/\r\nb", body.encode(), digest, len(body.encode()), None)
    raw += warc.warc_record(None, None, b"", hashlib.sha1(b"").digest(), 0, None)
    raw += warc.warc_record(3, "u", None, digest, len(body.encode()), 7)
    for step in (1, 7, 1 << 20):
        got = list(warc.read_records(raw[k : k + step] for k in range(0, len(raw), step)))
        assert [b for _, b in got] == [body.encode(), b"", b""]
        assert [h["WARC-Type"] for h, _ in got] == ["response", "response", "revisit"]
        for headers, block in got:
            warc.verify(headers, block)
    assert gzip.decompress(raw).count(b"WARC/1.1") == 3
    with pytest.raises(warc.DigestError):
        warc.verify(got[0][0], b"other")
    with pytest.raises(EOFError):
        list(warc.read_records([raw[:-3]]))
    bomb = gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\n" + b"0" * 50_000_000)
    seen = []
    with pytest.raises(ValueError, match="inflates past"):
        list(warc.read_records(seen.append(k) or bomb[k : k + 1000] for k in range(0, len(bomb), 1000)))
    assert len(seen) < 3
    with pytest.raises(ValueError, match="inflates past"):
        list(warc.read_records([gzip.compress(b"x" * 50_000_000)]))


def test_ordinal_model_orders_severity():
    rng = random.Random(9)
    clean = [" ".join(rng.choice(["sun", "rain", "tree", "road"]) for _ in range(60)) for _ in range(300)]
    toxic = [" ".join(rng.choice(["sun", "rain", "tree", "road"]) for _ in range(60)) + " idiot," * rng.choice([1, 3, 9]) for _ in range(100)]
    tallied = toxicity.tally(*toxicity.features(*packed(clean + toxic)))
    model = toxicity.fit_ordinal(*tallied, np.arange(400) >= 300)
    severity, above = model.severity(*packed(["", "sun rain", "Idiot", "idiot idiot idiot idiot", "idiot! " * 12]))
    assert (np.diff(severity) >= -1e-9).all() and severity[-1] > 2 > severity[2] > 0.5
    assert (above >= 0.5).tolist() == [False, False, True, True, True]
    assert np.all(np.diff(model.thresholds) > 0)


def test_characters_are_classed_once():
    classes = pretok.tiktoken_classes()
    points = np.frombuffer("aé1 \n!　".encode("utf-32-le"), np.uint32)
    assert classes(points).tolist() == [0, 0, 1, 3, 3, 2, 3]
