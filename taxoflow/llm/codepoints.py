"""Arrow text as arrays of code points and of words, for a whole batch at once."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa


def code_points(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of ``text``, which has no nulls, and the row of each."""
    text = text.cast(pa.large_string())
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before each byte
    return cp, np.repeat(np.arange(len(text)), np.diff(before[off - off[0]]))


#: No letter or digit is beyond the third ideographic plane.
LAST_LETTER = 0x34000


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter or digit, and its lower case."""
    n = sys.maxunicode + 1
    word, lower = np.zeros(n, bool), np.arange(n, dtype=np.uint32)
    for i in range(LAST_LETTER):
        c = chr(i)
        if c.isalnum() or unicodedata.category(c)[0] == "N":
            word[i] = True
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
    return word, lower


class Words:
    """Runs of letters or digits in a batch: their hashes, rows and letters."""

    def __init__(self, text: pa.Array) -> None:
        word, lower = _letters()
        cp, row = code_points(text)
        inside = word[cp]
        at = np.flatnonzero(inside)
        self.letters = lower[cp[at]]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(row[at]) > 0)
        self.start = np.flatnonzero(new)  # in letters
        self.end = np.append(self.start[1:], len(at))
        self.row = row[at[self.start]] if len(at) else np.zeros(0, np.int64)
        if not len(at):
            self.hash = np.zeros(0, np.uint64)
            return
        place = np.arange(len(at)) - np.repeat(self.start, self.end - self.start)
        power = np.ones(int(place.max()) + 1, np.uint64)
        power[1:] = np.uint64(0x9E3779B97F4A7C15)
        power = np.cumprod(power)
        with np.errstate(over="ignore"):
            h = np.add.reduceat((self.letters.astype(np.uint64) + np.uint64(1)) * power[place], self.start)
            self.hash = mixed(h)

    def bounds(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of each row, and the end of its words."""
        return np.searchsorted(self.row, np.arange(rows)), np.searchsorted(self.row, np.arange(rows), "right")


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))
