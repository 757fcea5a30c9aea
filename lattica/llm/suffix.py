"""Repeated-passage removal by common-prefix interval trees over an enhanced suffix array.

Every string of `least` bytes has an anchor: its leftmost smallest q-gram by hash, the same wherever
the string stands. So the suffixes that can share such a string meet by their anchor's hash:

1. Texts are compressed into blocks by a hash of the text, equal texts once, under their smallest id.
2. Each block asks which of its anchors stand in a second text; buckets by anchor answer.
3. The surroundings of those anchors go to their bucket, equal ones of a block only once, under
   their smallest id. There the anchors' suffixes are sorted into a suffix array with its LCP
   array, and a stack scan gives the tree of common-prefix intervals. The members of an interval
   are sorted again by what stands to their left, and a second scan gives the intervals of common
   left extension. One whose members differ to the left (by its making) and to the right (they lie
   in more than one child of the interval) is a maximal repeat group, with all its occurrences. Of
   each group of `least` bytes or more all occurrences but those of its smallest id go.
4. The verdicts return to the blocks, which cut the texts once each; rows get their text's result by its
   digest, and a row that repeats a text of smaller id goes whole.

A group is maximal within the surroundings of its anchor, which hold every string of `least` bytes over
that anchor (at most 2 * least - q bytes): a longer repeat comes as the groups of its anchors, which overlap and
whose union is the repeat. So the removed bytes are those of the contract, and repeat_groups() gives the groups.

An anchor or passage that a third of the corpus holds costs each block one row. Matches never cross
documents. Ids decide, so rows of equal id never remove each other; a null id counts as the largest.
Nulls: a null text is empty. Texts shorter than `least` are kept. An empty table gives an empty
result. Texts of any length are whole: a long one is scanned in segments that overlap by least - 1.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.bpe import _squeeze, _unsqueeze
from lattica.llm.common import U64, Stage, bytes_of, cut_rows, flat_ranges, join_heavy, mix, powers, prefix_sums, shared_dir, shuffle_width

LEAST = 50
QGRAM = 18
BLOCK_BYTES = 24 << 20
SEGMENT_BYTES = 1 << 20
TASK_BYTES = 24 << 20
#: A bucket task gets the anchors of about so many bytes of text.
BUCKET_BYTES = 64 << 20
#: Bits of an anchor's hash that are sent in step 2; a chance match costs only a useless row in step 3.
SENT_BITS = 48
NO_ID = np.iinfo(np.int64).max

_LOW = U64((1 << 22) - 1)


# ---------------------------------------------------------------- suffix arrays


def lcp_intervals(lcp: np.ndarray, least: int) -> np.ndarray:
    """(left, right, depth, parent's depth) of each interval of depth >= least; lcp[i] is that of suffixes i - 1 and i.

    A stack scan; the parent's depth is at least least - 1.
    """
    out, stack = [], []
    for i, depth in enumerate(lcp.tolist()):
        left = i - 1
        while stack and stack[-1][0] > depth:
            d, left = stack.pop()
            out.append((left, i - 1, d, max(depth, stack[-1][0] if stack else 0, least - 1)))
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))
    n = len(lcp)
    while stack:
        d, left = stack.pop()
        out.append((left, n - 1, d, max(stack[-1][0] if stack else 0, least - 1)))
    return np.array(out, np.int64).reshape(-1, 4)


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Each repeat of least bytes or more that no byte extends on either side at all its occurrences, with all of them.

    For texts that fit in memory: a suffix array by sorting, its LCP array, the interval tree, and in
    each interval the test that its members differ in what stands to their left.
    """
    suffixes = sorted((t[i:], d, i) for d, t in enumerate(texts) for i in range(len(t)))
    lcp = [0]
    for (a, *_), (b, *_) in zip(suffixes, suffixes[1:], strict=False):
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        lcp.append(n)
    out = []
    for left, right, depth, _ in lcp_intervals(np.array(lcp), least).tolist():
        members = [(d, i) for _, d, i in suffixes[left : right + 1]]
        before = {texts[d][i - 1] if i else None for d, i in members}
        if len(before) > 1 or None in before:
            out.append((suffixes[left][0][:depth], sorted(members)))
    return sorted(out)


# ---------------------------------------------------------------- anchors


class Anchors:
    """Anchor occurrences of a buffer of segments: place of the anchor, first and last string start, hash, segment."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int, q: int):
        n, w = len(data), least - q + 1
        if n < least:
            self.place = self.first = self.last = self.segment = np.zeros(0, np.int64)
            self.hash = np.zeros(0, U64)
            return
        sums = prefix_sums(data)
        _, inverse = powers(len(sums))
        grams = mix((sums[q:] - sums[:-q]) * inverse[: n - q + 1])
        key = (grams & ~_LOW) | np.arange(len(grams), dtype=U64)
        span = 1
        least_key = key
        while 2 * span <= w:
            least_key = np.minimum(least_key[: len(least_key) - span], least_key[span:])
            span *= 2
        if span < w:
            rest = w - span
            least_key = np.minimum(least_key[: len(least_key) - rest], least_key[rest:])
        place = (least_key & _LOW).astype(np.int64)  # of each string start
        good = np.ones(len(place) + 1, bool)
        inner = offsets[1:-1]
        cut = flat_ranges(np.maximum(inner - least + 1, 0), inner - np.maximum(inner - least + 1, 0))
        good[cut[cut < len(place)]] = False
        good = good[: len(place)]
        begin = good.copy()
        begin[1:] &= (place[1:] != place[:-1]) | ~good[:-1]
        end = good.copy()
        end[:-1] &= (place[1:] != place[:-1]) | ~good[1:]
        self.first, self.last = np.flatnonzero(begin), np.flatnonzero(end)
        self.place = place[self.first]
        self.hash = grams[self.place]
        self.segment = np.searchsorted(offsets, self.first, "right") - 1


def _pieces(table, least: int):
    """The distinct texts of a block: (smallest ids, texts), then pieces (text numbers, bases, data, offsets) of segments."""
    smallest: dict[bytes, int] = {}
    held: dict[bytes, np.ndarray] = {}
    for blob in table["blob"]:
        some, offsets, data = _unsqueeze(blob.as_py())
        for k, i in enumerate(some.tolist()):
            text = data[offsets[k] : offsets[k + 1]]
            key = hashlib.sha256(text).digest()
            smallest[key] = min(i, smallest.get(key, i))
            held[key] = text
    # the order must not depend on the order of the rows
    keys = sorted(held, key=lambda k: (smallest[k], k))
    ids, texts = [smallest[k] for k in keys], [held[k] for k in keys]
    pieces, now, size = [], [], 0
    for k, text in enumerate(texts):
        for base in range(0, len(text) - least + 1, SEGMENT_BYTES):
            part = text[base : base + SEGMENT_BYTES + least - 1]
            now.append((k, base, part))
            size += len(part)
            if size >= SEGMENT_BYTES:
                pieces.append(now)
                now, size = [], 0
    if now:
        pieces.append(now)
    done = []
    for p in pieces:
        lengths = np.array([len(x[2]) for x in p])
        done.append((np.array([x[0] for x in p]), np.array([x[1] for x in p]), np.concatenate([x[2] for x in p]), np.append(0, np.cumsum(lengths))))
    return ids, texts, done


def _blocks(blocks: int):
    """(block, blob): the distinct texts of a task's rows, each with its smallest id, by a hash of the text."""

    def flush(held):
        by_block: dict[int, list[bytes]] = {}
        for text in held:
            by_block.setdefault(int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little") % blocks, []).append(text)
        for b, texts in by_block.items():
            ids = np.array([held[t] for t in texts], np.int64)
            offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
            blob = _squeeze(ids, offsets, np.frombuffer(b"".join(texts), np.uint8))
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int64()), "blob": pa.array([blob], pa.binary())})

    def run(rows):
        held: dict[bytes, int] = {}
        size = 0
        for batch in rows:
            data, offsets = bytes_of(batch.column(1))
            ids = np.asarray(batch.column(0).fill_null(NO_ID)).tolist()
            for lo, hi in cut_rows(offsets, 1 << 20):
                for k in range(lo, hi):
                    text = data[offsets[k] : offsets[k + 1]].tobytes()
                    if text not in held:
                        size += len(text) + 100
                    held[text] = min(ids[k], held.get(text, ids[k]))
                if size >= TASK_BYTES:
                    yield from flush(held)
                    held, size = {}, 0
        if held:
            yield from flush(held)

    return run


def _spread_sorted(values: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers, byte by byte of equal weight: what is left to compress."""
    steps = np.diff(values, prepend=U64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).ravel()


def _gather_sorted(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel(), dtype=U64)


def _asked(pieces, buckets, least, q):
    """All anchors of a block: pieces' Anchors, the distinct sent hashes by bucket, and which stand in two texts here."""
    found = [Anchors(data, offsets, least, q) for _, _, data, offsets in pieces]
    hashes = np.concatenate([a.hash for a in found]) if found else np.zeros(0, U64)
    sent = hashes >> U64(64 - SENT_BITS)
    text = np.concatenate([p[0][a.segment] for p, a in zip(pieces, found, strict=True)]) if found else np.zeros(0, np.int64)
    known, back = np.unique(sent, return_inverse=True)
    lo, hi = np.full(len(known), NO_ID), np.full(len(known), -1)
    np.minimum.at(lo, back, text)
    np.maximum.at(hi, back, text)
    return found, known, back, lo < hi


def _ask(buckets, least, q):
    def run(key, table):
        _, _, pieces = _pieces(table, least)
        _, known, _, twice = _asked(pieces, buckets, least, q)
        bucket = (known % U64(buckets)).astype(np.int64)
        rows = []
        for b in range(buckets):
            some = np.flatnonzero(bucket == b)
            if len(some):
                rows.append((b, _squeeze(_spread_sorted(known[some]), np.packbits(twice[some]))))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([key[0].as_py()] * len(rows), pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _answer(table):
    """For each block's hashes in a bucket, which stand in two texts of the corpus."""
    blobs = [_unsqueeze(x.as_py()) for x in table["blob"]]
    asked = [_gather_sorted(b[0]) for b in blobs]
    twice = np.concatenate([np.unpackbits(b[1], count=len(a)).astype(bool) for a, b in zip(asked, blobs, strict=True)])
    every = np.concatenate(asked)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    same = ranked[1:] == ranked[:-1]
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.append(0, np.cumsum([len(a) for a in asked]))
    answers = [np.packbits(twice[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "answer": pa.array(answers, pa.binary())})


def _candidates(pieces, answers, buckets, least, q):
    """Anchors of a block that may stand in another text, equal surroundings once.

    (Anchors of each piece, piece, number in the piece, class of each; representative of each class;
    class order by bucket and hash.)
    """
    found, known, back, _ = _asked(pieces, buckets, least, q)
    bucket = (known % U64(buckets)).astype(np.int64)
    keep = np.zeros(len(known), bool)
    for b, blob in answers:
        some = np.flatnonzero(bucket == b)
        keep[some] = np.unpackbits(np.frombuffer(blob, np.uint8), count=len(some)).astype(bool)
    sizes = [len(a.hash) for a in found]
    piece = np.repeat(np.arange(len(found)), sizes)
    number = np.concatenate([np.arange(s) for s in sizes]) if sizes else np.zeros(0, np.int64)
    held = keep[back]
    piece, number = piece[held], number[held]
    name = np.zeros(len(piece), U64)
    text = np.zeros(len(piece), np.int64)
    for k, (p, a) in enumerate(zip(pieces, found, strict=True)):
        mine = np.flatnonzero(piece == k)
        if not len(mine):
            continue
        at = number[mine]
        sums = prefix_sums(p[2])
        _, inverse = powers(len(sums))
        lo, hi = a.first[at], a.last[at] + least
        whole = mix((sums[hi] - sums[lo]) * inverse[lo])
        name[mine] = mix(whole ^ mix((hi - lo).astype(U64) << U64(32) | (a.place[at] - lo).astype(U64)) ^ a.hash[at])
        text[mine] = p[0][a.segment[at]]
    order = np.lexsort((text, name))  # texts are numbered by their smallest id
    new = np.ones(len(order), bool)
    new[1:] = name[order][1:] != name[order][:-1]
    cls = np.empty(len(order), np.int64)
    cls[order] = np.cumsum(new) - 1
    rep = order[new]
    return found, piece, number, cls, rep, text


def _send(buckets, least, q):
    """(bucket, block, blob): the surroundings of a block's candidates."""

    def run(key, texts, answers):
        ids, _, pieces = _pieces(texts, least)
        got = list(zip(answers["bucket"].to_pylist(), answers["answer"].to_pylist(), strict=True))
        found, piece, number, _, rep, text = _candidates(pieces, got, buckets, least, q)
        hashes = np.array([found[p].hash[n] for p, n in zip(piece[rep].tolist(), number[rep].tolist(), strict=True)], U64)
        bucket = ((hashes >> U64(64 - SENT_BITS)) % U64(buckets)).astype(np.int64)
        rows = []
        for b in range(buckets):
            some = rep[bucket == b]
            if not len(some):
                continue
            owner = np.array([ids[t] for t in text[some].tolist()], np.int64)
            left, length, parts = [], [], []
            for p, n in zip(piece[some].tolist(), number[some].tolist(), strict=True):
                a = found[p]
                lo, hi = int(a.first[n]), int(a.last[n]) + least
                left.append(int(a.place[n]) - lo)
                length.append(hi - lo)
                parts.append(pieces[p][2][lo:hi])
            rows.append((b, _squeeze(owner, np.array(left, np.uint16), np.array(length, np.uint16), np.concatenate(parts))))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([key[0].as_py()] * len(rows), pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return run


class Groups:
    """Maximal repeat groups among anchor occurrences: each has `left` bytes before the anchor and `right` from it on,
    and the occurrences members[edges[g]:edges[g + 1]]."""

    def __init__(self, left: np.ndarray, right: np.ndarray, edges: np.ndarray, members: np.ndarray):
        self.left, self.right, self.edges, self.members = left, right, edges, members


def _common(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of bytes and the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for lo in range(1, len(rows), 1 << 14):
        differ = rows[lo : lo + (1 << 14)] != rows[lo - 1 : min(len(rows), lo + (1 << 14)) - 1]
        out[lo : lo + (1 << 14)] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def _window(flat: np.ndarray, start: np.ndarray, size: np.ndarray, wide: int, step: int) -> np.ndarray:
    """Rows of `wide` bytes, of which the first `size` are those at start, start + step, ...; the others are 0."""
    out = np.zeros((len(start), -(-wide // 8) * 8), np.uint8)
    columns = np.arange(wide)
    for lo in range(0, len(start), 1 << 14):
        at = start[lo : lo + (1 << 14), None] + step * columns
        inside = columns < size[lo : lo + (1 << 14), None]
        out[lo : lo + (1 << 14), :wide] = np.where(inside, flat[np.clip(at, 0, max(len(flat) - 1, 0))], 0)
    return out


def repeat_intervals(left: np.ndarray, length: np.ndarray, flat: np.ndarray, least: int, q: int) -> Groups:
    """The maximal repeat groups of `least` bytes or more among anchor occurrences.

    left, length: of the surroundings, up to the anchor and in all; flat: their bytes.
    """
    n = len(left)
    anchor = np.cumsum(length) - length + left
    right = length - left
    wide = least - q
    after = _window(flat, anchor, right, least, 1)
    words = after.view(">u8").astype(U64)
    suffixes = np.lexsort(tuple(words[:, k] for k in reversed(range(words.shape[1]))))  # the suffix array of the anchors
    reach, left_at = right[suffixes], left[suffixes]
    lcp = _common(after[suffixes][:, :least])
    lcp[1:] = np.minimum(lcp[1:], np.minimum(reach[1:], reach[:-1]))
    before = _window(flat, anchor[suffixes] - 1, left_at, wide, -1)
    words = before.view(">u8").astype(U64)
    tree = lcp_intervals(lcp, q)
    lefts, rights, sizes, members = [], [], [], []
    for depth in np.unique(tree[:, 2]).tolist() if len(tree) else []:
        nodes = tree[tree[:, 2] == depth]
        held = nodes[:, 1] - nodes[:, 0] + 1
        at = flat_ranges(nodes[:, 0], held)
        node = np.repeat(np.arange(len(nodes)), held)
        some = left_at[at] >= least - depth  # others are too short to be in a group of this depth
        at, node = at[some], node[some]
        if len(at) < 2:
            continue
        order = np.lexsort((*(words[at, k] for k in reversed(range(words.shape[1]))), node))
        at, node = at[order], node[order]
        shared = _common(before[at][:, :wide])
        shared[1:] = np.minimum(shared[1:], np.minimum(left_at[at[1:]], left_at[at[:-1]]))
        shared[np.append(True, node[1:] != node[:-1])] = -1
        # the left intervals; those of two strings that end alike need no byte to the left at all
        found = lcp_intervals(shared, max(0, least - depth)) if (shared >= max(0, least - depth)).any() else np.zeros((0, 4), np.int64)
        if not len(found):
            continue
        # within the interval, whose child a member lies in: a group must span two of them
        child = np.cumsum(lcp <= depth)[at]
        a, size = found[:, 0], found[:, 1] - found[:, 0] + 1
        rows = flat_ranges(a, size)
        starts = np.cumsum(size) - size
        wider = np.minimum.reduceat(child[rows], starts) < np.maximum.reduceat(child[rows], starts)
        kept = np.repeat(wider, size)
        lefts.append(found[wider, 2])
        rights.append(np.full(int(wider.sum()), depth))
        sizes.append(size[wider])
        members.append(suffixes[at[rows[kept]]])
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return Groups(join(lefts), join(rights), np.append(0, np.cumsum(join(sizes))), join(members))


def judge(owner: np.ndarray, left: np.ndarray, length: np.ndarray, flat: np.ndarray, least: int, q: int) -> tuple[np.ndarray, Groups]:
    """For each anchor occurrence, a bit for each distance of a string's start before the anchor: it stands in a smaller id.

    It is in a maximal repeat group that holds a smaller id, whose strings begin at most `left` bytes before the anchor
    and end at most `right` bytes behind it. owner: ids; for the others see repeat_intervals().
    """
    groups = repeat_intervals(left, length, flat, least, q)
    verdict = np.zeros(len(owner), U64)
    if len(groups.left):
        size = np.diff(groups.edges)
        first = np.minimum.reduceat(owner[groups.members], groups.edges[:-1])
        low, high = np.maximum(0, least - groups.right), np.minimum(groups.left, least - q)
        bits = (U64(2) << high.astype(U64)) - (U64(1) << low.astype(U64))
        goes = owner[groups.members] > np.repeat(first, size)
        np.bitwise_or.at(verdict, groups.members[goes], np.repeat(bits, size)[goes])
    return verdict, groups


def _judge(least, q, groups_too=False):
    def run(table):
        blobs = [_unsqueeze(x.as_py()) for x in table["blob"]]
        owner, left, length, flat = (np.concatenate([b[k] for b in blobs]).astype(np.int64 if k < 3 else np.uint8) for k in range(4))
        verdict, groups = judge(owner, left, length, flat, least, q)
        edges = np.append(0, np.cumsum([len(b[0]) for b in blobs]))
        told = [[verdict[a:b]] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        if groups_too:  # each member's group, by name, and the group's bytes before and behind the anchor
            size, members = np.diff(groups.edges), groups.members
            first = members[groups.edges[:-1]]
            begin = (np.cumsum(length) - length + left)[first] - groups.left
            whole = groups.left + groups.right
            names = np.array([int.from_bytes(hashlib.blake2b(flat[a : a + k], digest_size=8).digest(), "little") for a, k in zip(begin.tolist(), whole.tolist(), strict=True)], U64)
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                some = (a <= members) & (members < b)
                told[k] += [members[some] - a, *(np.repeat(x, size)[some] for x in (names, groups.left, groups.right))]
        told = [_squeeze(*x) for x in told]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "verdict": pa.array(told, pa.binary())})

    return run


def _cut(buckets, least, q, finish):
    def run(key, texts, answers):
        ids, whole, pieces = _pieces(texts, least)
        got = list(zip(answers["bucket"].to_pylist(), answers["answer"].to_pylist(), strict=True))
        found, piece, number, cls, rep, text = _candidates(pieces, [g for g in got if g[1] is not None], buckets, least, q)
        hashes = np.array([found[p].hash[n] for p, n in zip(piece[rep].tolist(), number[rep].tolist(), strict=True)], U64)
        bucket = ((hashes >> U64(64 - SENT_BITS)) % U64(buckets)).astype(np.int64)
        verdict = np.zeros(len(rep), U64)
        told = []
        for b, blob in zip(answers["bucket"].to_pylist(), answers["verdict"].to_pylist(), strict=True):
            if blob is not None:
                mine = np.flatnonzero(bucket == b)
                bits, *groups = _unsqueeze(blob)
                verdict[mine] = bits
                if groups:
                    told.append((mine[groups[0]], *groups[1:]))
        if finish.groups:
            return finish(ids, pieces, found, piece, number, cls, text, told, key[0].as_py())
        mine = verdict[cls]
        smallest = np.array(ids, np.int64)
        later = smallest[text] > smallest[text[rep[cls]]]  # the same surroundings stand in a smaller id of this block
        mine[later] = ~U64(0)
        starts = [np.zeros(len(t) + 1, bool) for t in whole]
        for k, (p, a) in enumerate(zip(pieces, found, strict=True)):
            at = np.flatnonzero(piece == k)
            if not len(at):
                continue
            spots = a.place[number[at]]
            low, high = spots - a.last[number[at]], spots - a.first[number[at]]
            goes = np.zeros(len(p[2]) + 1, bool)
            for distance in range(least - q + 1):
                hit = (mine[at] >> U64(distance) & U64(1)).astype(bool) & (low <= distance) & (distance <= high)
                goes[spots[hit] - distance] = True
            for t, b, lo, hi in zip(p[0].tolist(), p[1].tolist(), p[3][:-1].tolist(), p[3][1:].tolist(), strict=True):
                starts[t][b : b + hi - lo] |= goes[lo:hi]
        return finish(ids, whole, [np.flatnonzero(s) for s in starts], least)

    return run


def _covered(size: int, starts: np.ndarray, least: int) -> np.ndarray:
    """(begin, end) of the maximal runs that the strings cover."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    gap = np.flatnonzero(np.diff(starts) > least)
    return np.stack([starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + least], 1)


def _keep(text, runs):
    keep = np.ones(len(text), bool)
    keep[flat_ranges(runs[:, 0], runs[:, 1] - runs[:, 0])] = False
    return text[keep].tobytes()


def _keys(texts):
    return pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())


class real_output:
    """Of each text: the removed spans and the bytes that are kept."""

    groups = False
    schema = "digest binary, least_id long, spans array<struct<start:long,end:long>>, kept binary"

    def __call__(self, ids, texts, starts, least):
        runs = [_covered(len(t), b, least) for t, b in zip(texts, starts, strict=True)]
        spans = [[{"start": int(a), "end": int(b)} for a, b in r] for r in runs]
        kept = [_keep(t, r) for t, r in zip(texts, runs, strict=True)]
        return pa.table({"digest": _keys(texts), "least_id": pa.array(ids, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})

    def columns(self, again, size):
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end")))
        return [F.when(again, whole).otherwise(F.col("spans")).alias("spans"), F.when(again, F.lit(b"")).otherwise(F.col("kept")).alias("kept")]


class digest_output:
    """Of each text: sizes, and a digest of the bytes that are kept."""

    groups = False
    schema = "digest binary, least_id long, n_removed long, n_spans long, kept_sha256 string"

    def __call__(self, ids, texts, starts, least):
        runs = [_covered(len(t), b, least) for t, b in zip(texts, starts, strict=True)]
        return pa.table(
            {
                "digest": _keys(texts),
                "least_id": pa.array(ids, pa.int64()),
                "n_removed": pa.array([int((r[:, 1] - r[:, 0]).sum()) for r in runs], pa.int64()),
                "n_spans": pa.array([len(r) for r in runs], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(_keep(t, r)).hexdigest() for t, r in zip(texts, runs, strict=True)], pa.string()),
            }
        )

    def columns(self, again, size):
        none = hashlib.sha256(b"").hexdigest()
        return [
            size.alias("n_bytes"),
            F.when(again, size).otherwise(F.col("n_removed")).alias("n_removed"),
            F.when(again, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
            F.when(again, F.lit(none)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        ]


class _group_output:
    """An occurrence of a maximal repeat group a row; equal texts once, under their smallest id."""

    groups = True
    schema = "repeat long, length long, doc_id long, start long"

    def __call__(self, ids, pieces, found, piece, number, cls, text, told, block):
        if not told:
            return pa.table({c: pa.array([], pa.int64()) for c in ("repeat", "length", "doc_id", "start")})
        at, names, left, right = (np.concatenate([t[k] for t in told]) for k in range(4))
        order = np.argsort(cls, kind="stable")  # the occurrences of each class
        lo, hi = np.searchsorted(cls[order], at, "left"), np.searchsorted(cls[order], at, "right")
        every = order[flat_ranges(lo, hi - lo)]
        names, left, right = (np.repeat(x, hi - lo) for x in (names, left, right))
        spot = np.empty(len(every), np.int64)
        for k, (p, a) in enumerate(zip(pieces, found, strict=True)):
            mine = np.flatnonzero(piece[every] == k)
            n = number[every[mine]]
            spot[mine] = a.place[n] - p[3][a.segment[n]] + p[1][a.segment[n]] - left[mine]
        return pa.table({"repeat": pa.array(names.view(np.int64)), "length": pa.array(left + right), "doc_id": pa.array(np.array(ids, np.int64)[text[every]]), "start": pa.array(spot)})


def _judged(rows: DataFrame, least: int, q: int, finish) -> DataFrame:
    if not 0 < least - q + 1 <= 63:
        raise ValueError("a string's start must lie within 62 bytes before its anchor")
    spark = rows.sparkSession
    shared_dir(spark)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_width(spark), size // BUCKET_BYTES)
    blocks = max(shuffle_width(spark), size // BLOCK_BYTES)
    # read and compressed again for the second job: that costs less than to keep the blocks between the two
    held = rows.mapInArrow(_blocks(blocks), "block long, blob binary")
    asked = held.groupBy("block").applyInArrow(_ask(buckets, least, q), "bucket long, block long, blob binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "block long, bucket long, answer binary").repartition(shuffle_width(spark), "block").checkpoint()
    sent = held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_send(buckets, least, q), "bucket long, block long, blob binary")
    told = sent.groupBy("bucket").applyInArrow(_judge(least, q, finish.groups), "block long, bucket long, verdict binary")
    replies = answers.withColumn("verdict", F.lit(None).cast("binary")).unionByName(told.withColumn("answer", F.lit(None).cast("binary"))).select("block", "bucket", "answer", "verdict")
    return held.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_cut(buckets, least, q, finish), finish.schema)


def repeat_groups(docs: DataFrame, least: int = LEAST, q: int = QGRAM, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(repeat, length, doc_id, start): all occurrences of each maximal repeat group, a row each.

    repeat names the group's string by a hash; of equal texts the one of smallest id stands for all, a null id is null.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = _judged(rows, least, q, _group_output()).distinct()  # where segments overlap an occurrence is seen twice
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def remove_repeats(docs: DataFrame, least: int = LEAST, q: int = QGRAM, finish=real_output, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Cuts each byte that lies in a string of `least` bytes which also starts in a row of smaller id."""
    finish = finish()
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = Stage(_judged(rows, least, q, finish), "texts").df  # a row a distinct text
    body = F.coalesce("text", F.lit("")).cast("binary")
    light = Stage(rows.select("doc_id", F.unhex(F.sha2(body, 256)).alias("digest"), F.octet_length(body).cast("long").alias("size")), "rows").df
    copies = light.groupBy("digest").agg(F.count("*").alias("copies"))
    told = join_heavy(light, texts.join(copies, "digest"), "digest", "copies", light.count(), "inner")
    again = (F.coalesce("doc_id", F.lit(NO_ID)) > F.col("least_id")) & (F.col("size") >= least)  # an equal text has a smaller id
    return told.select("doc_id", *finish.columns(again, F.col("size")))
