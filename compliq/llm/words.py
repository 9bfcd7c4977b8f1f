"""Words of many texts at once, as arrays: where they are, and hashes of what they say, without a Python object for each.

A hash is a polynomial over the code points' own random values, taken from running sums, so that the hash of any stretch of
characters is one subtraction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

SPACE, LEFT, RIGHT, UPPER, LOWER, DIGIT, END, CLOSER = (1 << k for k in range(8))
#: Code points told apart; those beyond are letters without case.
POINTS = 1 << 17
#: Characters handled at once, at least.
PIECE = 1 << 20
_BASE, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BLANK = re.compile(r"\s")


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash, over an array."""
    h = (h ^ (h >> np.uint64(33))) * _A
    h = (h ^ (h >> np.uint64(33))) * _B
    return h ^ (h >> np.uint64(33))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: its classes, the random value of its lower case, and how it counts (lower, upper, digits: 21 bits each)."""
    flags, lower = np.zeros(POINTS, np.uint8), np.arange(POINTS, dtype=np.uint64)
    for i in range(POINTS):
        c = chr(i)
        word = c.isalnum() or c == "_"
        flags[i] = SPACE * c.isspace() | RIGHT * (word or c == "%") | LEFT * (word or c in "%$€£+-") | UPPER * c.isupper() | LOWER * c.islower() | DIGIT * c.isdecimal() | END * (c in ".!?:") | CLOSER * (c in "\"')]")
        if word and (x := c.lower()) != c:
            lower[i] = ord(x[0])
    counts = ((flags & LOWER) > 0) * np.int64(1) | ((flags & UPPER) > 0) * np.int64(1 << 21) | ((flags & DIGIT) > 0) * np.int64(1 << 42)
    return flags, mix(lower + np.uint64(1)), counts


_MADE: list = []
_POWERS: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def tables() -> list:
    """Made when first asked for, once a process."""
    if not _MADE:
        _MADE.extend(_tables())
    return _MADE


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        inverse = pow(int(_BASE), -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (_BASE, np.uint64(inverse))]
    return _POWERS[0][:n], _POWERS[1][:n]


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """(position, piece): cut after a blank, so that no word is cut."""
    at = 0
    while len(text) - at > PIECE and (m := _BLANK.search(text, at + PIECE)):
        yield at, text[at : m.end()]
        at = m.end()
    yield at, text[at:]


def last_at_most(places: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The last of the ascending places that is at most x, else -1."""
    i = np.searchsorted(places, x, side="right") - 1
    return np.where(i >= 0, places[np.maximum(i, 0)] if len(places) else -1, -1)


def first_at_least(places: np.ndarray, x: np.ndarray, none: int) -> np.ndarray:
    i = np.searchsorted(places, x)
    return np.where(i < len(places), places[np.minimum(i, len(places) - 1)] if len(places) else none, none)


class Words:
    """The words (runs of anything but white space) of texts, in order.

    ``begin`` and ``end``: the words of each text. Of each word: ``at``, ``to``: its core in ``text``, that is without the punctuation around it;
    ``hash`` of the core in lower case; ``named``: whether the core begins with its one capital; ``digits``; ``ends``: whether a sentence ends with it.
    """

    def __init__(self, texts: list[str]):
        self.text = "\n".join(texts)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        made = [self._piece(at, piece) for at, piece in pieces(self.text)]
        start, self.at, self.to, self.hash, self.named, self.digits, self.ends = (np.concatenate([m[k] for m in made]) for k in range(7))
        edges = np.searchsorted(start, begins)
        self.begin, self.end = edges[:-1], edges[1:]

    @staticmethod
    def _piece(offset: int, text: str) -> tuple[np.ndarray, ...]:
        flags_of, value_of, count_of = tables()
        points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), POINTS - 1)
        flags = flags_of[points]
        blank = (flags & SPACE) > 0
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(start):
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(np.uint64), none > 0, none > 0, none > 0
        at, to, last = start.copy(), stop.copy(), stop - 1
        if len(odd := np.flatnonzero((flags[start] & LEFT) == 0)):
            at[odd] = np.minimum(first_at_least(np.flatnonzero(flags & LEFT), start[odd], len(text)), stop[odd])
        if len(odd := np.flatnonzero((flags[last] & RIGHT) == 0)):
            to[odd] = last_at_most(np.flatnonzero(flags & RIGHT), last[odd]) + 1
        to = np.maximum(to, at)
        if len(odd := np.flatnonzero(flags[last] & CLOSER)):
            last[odd] = np.maximum(last_at_most(np.flatnonzero((flags & CLOSER) == 0), last[odd]), start[odd])
        power, inverse = powers(len(text) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(value_of[points] * power[:-1])])
        counts = np.concatenate([[0], np.cumsum(count_of[points])])
        rest = counts[to] - counts[np.minimum(at + 1, to)]
        capital = (flags[np.minimum(at, len(text) - 1)] & UPPER) > 0
        named = capital & (rest & (1 << 21) - 1 > 0) & (rest >> 21 & (1 << 21) - 1 == 0)
        digits = counts[to] - counts[at] >> 42 > 0
        return start + offset, at + offset, to + offset, mix((sums[to] - sums[at]) * inverse[at]), named, digits, (flags[last] & END) > 0

    def core(self, i: int) -> str:
        return self.text[self.at[i] : self.to[i]]


_ASCII_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_BYTE_LOWER = np.arange(256, dtype=np.uint64)
_BYTE_LOWER[65:91] += np.uint64(32)
_BYTE_VALUE = mix(_BYTE_LOWER + np.uint64(1))
_BYTE_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _byte_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate([[True], _BYTE_BLANK[points], [True]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = powers(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_VALUE[points] * power[:-1])])
    return start, mix((sums[stop] - sums[start]) * inverse[start])


def byte_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of texts in bytes, whose words are runs of anything but ASCII white space, ASCII letters lower-cased: where the words of each begin (and, at the end, how many there are), and a hash of each word."""
    whole = b"\n".join(texts)
    begins, at, made = np.cumsum([0, *(len(t) + 1 for t in texts)]), 0, []
    while len(whole) - at > PIECE and (m := _ASCII_BLANK.search(whole, at + PIECE)):
        start, hashes = _byte_words(whole[at : m.end()])
        made.append((start + at, hashes))
        at = m.end()
    start, hashes = _byte_words(whole[at:])
    made.append((start + at, hashes))
    start, hashes = (np.concatenate([x[k] for x in made]) for k in (0, 1))
    return np.searchsorted(start, begins), hashes
