"""Local recompression of word sequences: runs, then pairs, named by hashes.

A name is a function of what it stands for alone, so equal runs and pairs have one name on all executors, in all
rounds, without a dictionary to exchange. A round pairs a symbol of the left half of the alphabet with one of the right
half that follows it; the halves change from round to round with the names' bits. Symbols longer than LONGEST words
rest, so symbols keep within a window.

Along with each symbol goes the range of words that decides that the symbol stands there: what it covers and those
neighbours whose names kept it from being paired. Wherever these words stand again, the same symbol stands there.
"""

from __future__ import annotations

import numpy as np

from . import words as X

ROUNDS = 7
LONGEST = 8
#: Rounds in which runs are named.
RUN_ROUNDS = (0,)
FAR = 1 << 40


def symbols(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS, longest: int = LONGEST, run_rounds=RUN_ROUNDS):
    """(name, lo, hi) of the last round's symbols; lo and hi bound the deciding words (FAR outside: never decided)."""
    n = len(h)
    name = h.copy()
    begin = np.arange(n)
    end = begin + 1
    lo, hi = begin.copy(), end.copy()
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for turn in range(rounds):
        if turn in run_rounds:
            name, begin, end, lo, hi, text = _runs(name, begin, end, lo, hi, text, turn)
        name, begin, end, lo, hi, text = _pairs(name, begin, end, lo, hi, text, turn, longest)
    return name, lo, hi


def _next_to(lo, hi, text):
    """Deciding ranges of the neighbours; past a text's edge nothing decides."""
    n = len(lo)
    left_lo, left_hi = np.full(n, -FAR), np.full(n, FAR)
    right_lo, right_hi = np.full(n, -FAR), np.full(n, FAR)
    if n > 1:
        same = text[1:] == text[:-1]
        left_lo[1:] = np.where(same, lo[:-1], -FAR)
        left_hi[1:] = np.where(same, hi[:-1], FAR)
        right_lo[:-1] = np.where(same, lo[1:], -FAR)
        right_hi[:-1] = np.where(same, hi[1:], FAR)
    return left_lo, left_hi, right_lo, right_hi


def _runs(name, begin, end, lo, hi, text, turn):
    n = len(name)
    if not n:
        return name, begin, end, lo, hi, text
    new = np.ones(n, bool)
    new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], n) - 1
    count = (last - at + 1).astype(np.uint64)
    # that a run ends here is decided by the symbols beside it
    left_lo, left_hi, right_lo, right_hi = _next_to(lo, hi, text)
    run_lo = np.minimum(np.minimum(lo[at], left_lo[at]), right_lo[last])
    run_hi = np.maximum(np.maximum(hi[last], right_hi[last]), left_hi[at])
    named = np.where(count > 1, X.mix(name[at] * np.uint64(0x8CB92BA72F3D8DD7) + count * np.uint64(0x9FB21C651E98DF25) + np.uint64(turn)), name[at])
    return named, begin[at], end[last], run_lo, run_hi, text[at]


def _pairs(name, begin, end, lo, hi, text, turn, longest):
    n = len(name)
    if n < 2:
        return name, begin, end, lo, hi, text
    active = end - begin <= longest
    left = (X.mix(name ^ np.uint64(0x51A2B3C4D5E6F708 + turn)) & np.uint64(1)).astype(bool)
    first = np.zeros(n, bool)
    first[:-1] = left[:-1] & ~left[1:] & active[:-1] & active[1:] & (text[1:] == text[:-1])
    second = np.zeros(n, bool)
    second[1:] = first[:-1]
    left_lo, left_hi, right_lo, right_hi = _next_to(lo, hi, text)
    alone = active & ~first & ~second
    on_left, on_right = alone & left, alone & ~left
    lo = np.where(on_left, np.minimum(lo, right_lo), np.where(on_right, np.minimum(lo, left_lo), lo))
    hi = np.where(on_left, np.maximum(hi, right_hi), np.where(on_right, np.maximum(hi, left_hi), hi))
    at = np.flatnonzero(first)
    new_name = name.copy()
    new_name[at] = X.mix(name[at] * np.uint64(0xC2B2AE3D27D4EB4F) + name[at + 1] * np.uint64(0x165667B19E3779F9) + np.uint64(turn + 1))
    new_end = end.copy()
    new_end[at] = end[at + 1]
    lo[at], hi[at] = np.minimum(lo[at], lo[at + 1]), np.maximum(hi[at], hi[at + 1])
    stay = ~second
    return new_name[stay], begin[stay], new_end[stay], lo[stay], hi[stay], text[stay]
