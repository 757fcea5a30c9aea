"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near_duplicates(docs):
    """{id: (n_shingles, component)} of {id: text}."""
    sets = {i: shingles(t) for i, t in docs.items()}
    links = []
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    comp = components(sets, links)
    return {i: (len(sets[i]), comp[i]) for i in sets}


def repeats(docs, least=50):
    """{id: (n_bytes, n_removed, n_spans, kept_sha256)} of {id: text}."""
    first = {}
    for i in sorted(docs):
        raw = (docs[i] or "").encode()
        for k in range(len(raw) - least + 1):
            first.setdefault(raw[k : k + least], i)
    out = {}
    for i, text in docs.items():
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - least + 1):
            if first[raw[k : k + least]] < i:
                gone[k : k + least] = b"\1" * least
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeat_groups(docs, least, q):
    """The maximal repeat groups over each anchor, as sets of (id, start, length), by trying every string around it."""
    from lattica.llm import suffix

    spots = defaultdict(set)  # of each anchor's bytes: (id, place, first byte around it, end)
    for i, text in docs.items():
        raw = (text or "").encode()
        data = _array(raw)
        a = suffix.Anchors(data, _offsets(raw), least, q)
        for place, first, last in zip(a.place.tolist(), a.first.tolist(), a.last.tolist(), strict=True):
            spots[raw[place : place + q]].add((i, place, first, last + least))
    raws = {i: (t or "").encode() for i, t in docs.items()}
    out = set()
    for here in spots.values():
        places = defaultdict(list)
        for i, place, first, end in here:
            for a in range(first, place + 1):
                for b in range(max(place + q, a + least), end + 1):
                    places[raws[i][a:b], place - a].append((i, place, first, end))
        for (s, left), at in places.items():
            if len(at) < 2:
                continue
            before = {raws[i][p - left - 1] if p - left > first else (i, p) for i, p, first, _ in at}
            after = {raws[i][p - left + len(s)] if p - left + len(s) < end else (i, p) for i, p, _, end in at}
            if len(before) > 1 and len(after) > 1:
                out.add(frozenset((i, p - left, len(s)) for i, p, _, _ in at))
    return out


def _array(raw):
    import numpy as np

    return np.frombuffer(raw, np.uint8)


def _offsets(raw):
    import numpy as np

    return np.array([0, len(raw)])


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal_data(text):
    """((n_email, n_ip, n_card, n_phone), told) of the base spans."""
    counts, told = [], []
    for kind, pattern in PLAIN.items():
        n = 0
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and _luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                n += 1
                told.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return tuple(counts), ",".join(told)


def embedding_links(rows, threshold=0.98):
    """{id: (n_links, component)} of [(id, vector, label)]."""
    import numpy as np

    sound = {i: np.array(v, float) for i, v, label in rows if label is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v, float))}
    label = {i: x for i, _, x in rows}
    n, links = defaultdict(int), []
    for a, b in combinations(sorted(sound), 2):
        x, y = sound[a], sound[b]
        if label[a] == label[b] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
            links.append((a, b))
            n[a] += 1
            n[b] += 1
    comp = components([i for i, _, _ in rows], links)
    return {i: (n[i], comp[i]) for i, _, _ in rows}


def piece_rows(ids, end_id=2):
    """crc of an id list as the contract has it."""
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())


def severity(text, model):
    """(expected severity, P(grade >= 1)) of a text, word by word."""
    import math

    import numpy as np

    from lattica.llm.common import U64, mix, span_hashes

    counts = defaultdict(int)
    for word in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        word = re.sub(rb"(?<=[\x00-\xff])[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$", b"", word.lower()) or word[:1].lower()
        counts[word, 0] += 1
        for n in (4, 5, 6, 7):
            if len(word) >= n:
                counts[word[:n], n] += 1
    known = dict(zip(model.names.tolist(), model.weights.tolist(), strict=True))
    x = 0.0
    for (word, n), c in counts.items():
        name = span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
        x += math.log1p(c) * known.get(int((mix(name + U64(n)) if n else name)[0]), 0.0)
    above = [1 / (1 + math.exp(max(-50, min(50, t - x)))) for t in model.thresholds]
    return sum(above), above[0] if above else 0.0
