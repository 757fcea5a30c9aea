"""Vectorised pre-tokenisers: a batch of texts becomes arrays of word boundaries.

Characters are classed by the tokenizer library's own engine, one new code point at a time, so that
the classes are that engine's and not those of another Unicode version.
"""

from __future__ import annotations

import numpy as np

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
_UNKNOWN = 9

#: The endings that the patterns split off behind an apostrophe.
SHORT = "stmd"
LONG = ("re", "ve", "ll")


class CharClasses:
    """A table from code point to class that is filled as code points turn up."""

    def __init__(self, is_letter, is_number, is_space):
        self.table = np.full(0x110000, _UNKNOWN, np.uint8)
        self.tests = (is_letter, is_number, is_space)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        found = self.table[points]
        if (found == _UNKNOWN).any():
            new = np.unique(points[found == _UNKNOWN])
            for c in new.tolist():
                s = chr(c)
                letter, number, space = (t(s) for t in self.tests)
                self.table[c] = LETTER if letter else NUMBER if number else SPACE if space else OTHER
            found = self.table[points]
        return found


def tiktoken_classes() -> CharClasses:
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    tests = []
    for k, pattern in enumerate((r"\p{L}", r"\p{N}", r"\s")):
        enc = tiktoken.Encoding(f"class{k}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        tests.append(lambda s, enc=enc: bool(enc.encode_ordinary(s)))
    return CharClasses(*tests)


def tokenizers_classes() -> CharClasses:
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    tests = []
    for pattern in (r"\p{L}", r"\p{N}", r"\s"):
        split = Split(Regex(pattern), "removed", invert=True)
        tests.append(lambda s, split=split: bool(split.pre_tokenize_str(s)))
    return CharClasses(*tests)


def code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


def utf8_widths(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)


def _contractions(points, cls, starts, first):
    """(apostrophe, length of the whole) where a lone apostrophe that begins a word is followed by a known ending."""
    n = len(points)
    lone = np.flatnonzero((points == ord("'")) & starts)
    lone = lone[(lone + 1 < n)]
    if not len(lone):
        return lone, lone
    nxt = lone + 1
    ok = ~first[nxt] & (cls[nxt] == LETTER)
    lone, nxt = lone[ok], nxt[ok]
    length = np.where(np.isin(points[nxt], [ord(c) for c in SHORT]), 2, 0)
    after = np.minimum(nxt + 1, n - 1)
    inside = (nxt + 1 < n) & ~first[after]
    for a, b in LONG:
        length = np.where((length == 0) & inside & (points[nxt] == ord(a)) & (points[after] == ord(b)), 3, length)
    return lone[length > 0], length[length > 0]


def split_all(points: np.ndarray, cls: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Starts of the words of the byte-level pattern: every character belongs to a word, a space to the word it precedes."""
    n = len(points)
    first = np.zeros(n, bool)
    first[doc_starts[doc_starts < n]] = True
    run = first.copy()
    run[1:] |= cls[1:] != cls[:-1]
    starts = run.copy()
    begins = np.flatnonzero(run & (cls != SPACE) & ~first)
    begins = begins[cls[begins - 1] == SPACE]
    starts[begins - 1] = True
    starts[begins] = points[begins - 1] != 0x20
    alone = starts & (cls == OTHER)
    alone[:-1] &= run[1:]  # a run of one
    at, length = _contractions(points, cls, alone, first)
    starts[at + 1] = False
    ends = at + length
    starts[ends[ends < n]] = True
    return np.flatnonzero(starts)


def split_words(points: np.ndarray, cls: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of the lower-case pattern: runs of letters, single numbers, runs of others; white space falls away."""
    n = len(points)
    first = np.zeros(n, bool)
    first[doc_starts[doc_starts < n]] = True
    run = first.copy()
    run[1:] |= cls[1:] != cls[:-1]
    starts = run | (cls == NUMBER)
    alone = run & (cls == OTHER)
    alone[:-1] &= run[1:]
    at, length = _contractions(points, cls, alone, first)
    starts[at + 1] = False
    ends = at + length
    starts[ends[ends < n]] = True
    at = np.flatnonzero(starts)
    ends = np.append(at[1:], n)
    words = cls[at] != SPACE
    return at[words], ends[words]
