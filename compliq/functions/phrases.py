"""Patterns over the words of a sentence.

A text is cut into tokens: quoted strings, numbers, words, marks. A pattern is a line of elements, read from left to right:

    word        that word, whatever its case; ``word(s)`` with or without the s; a hyphen may stand between the words of a phrase
    (a b|c)     one of several phrases, the longest first; {NAME}: one of the phrases of that list
    #n  #!n     a number in digits or words; in digits only. ``!#`` in a phrase: no number follows
    "=v         quoted strings in a row
    _2-5        so many words, as few as will do, commas and hyphens among them; % instead of _: any tokens but . ; :
    @1-5        words of which the first has a capital
    ..          any tokens but . and ;
    ^  $        the beginning and the end
    ...=v       all that follows

``x?`` is optional, ``x*`` may repeat, ``x=v`` names what was found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any, NamedTuple

#: Numbers in words. Fixed values.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14,
    "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60,
}
_QUOTED = r"""(?P<quote>"[^"\n]+"|“[^”\n]+”|‘[^’\n]+’|(?<!\w)'[^'\n]+'(?!\w))|"""
_PLAIN = r"""(?P<number>\d+(?:,\d+)*)|(?P<word>(?:[^\W\d_]\.){2,}|[^\W\d]\w*(?:['’]\w+)*)|(?P<mark>\S)"""
TOKEN, UNQUOTED = re.compile(_QUOTED + _PLAIN), re.compile(_PLAIN)
ELEMENT = re.compile(r"(?P<body>\((?:\(s\)|[^()])*\)|\{\w+\}|#!?\w+|\"|\.\.\.|\.\.|[_%@]\d+-\d+|[^\s?*=]+)(?P<many>[?*])?(?:=(?P<name>\w+))?")


class Token(NamedTuple):
    kind: str
    text: str
    low: str
    at: int
    to: int


def tokens(text: str, quotes: bool = True) -> list[Token]:
    found = (TOKEN if quotes else UNQUOTED).finditer(text)
    return [Token(m.lastgroup, m[0], m[0][1:-1].strip() if m.lastgroup == "quote" else m[0].lower().replace("’", "'"), *m.span()) for m in found]


def number(t: Token) -> int | None:
    return int(t.low.replace(",", "")) if t.kind == "number" else NUMBER_WORDS.get(t.low)


@dataclass
class Found:
    begin: int
    end: int
    names: dict[str, Any] = field(default_factory=dict)

    def __getitem__(self, name: str) -> Any:
        return self.names.get(name)


class Said:
    """A text with its tokens."""

    def __init__(self, text: str, quotes: bool = True):
        self.text, self.tokens = text, tokens(text, quotes)

    def between(self, i: int, j: int) -> str:
        return self.text[self.tokens[i].at : self.tokens[j - 1].to] if i < j else ""

    def find(self, *patterns: str, lists: dict[str, list[str]]) -> Found | None:
        """The first place where one of the patterns matches; the first of them there."""
        return next(self.every(*patterns, lists=lists), None)

    def every(self, *patterns: str, lists: dict[str, list[str]]) -> Iterator[Found]:
        """Each place where a pattern matches, and how it does first."""
        made = [(compiled(p), starts_of(p, lists)) for p in patterns]
        for i in range(len(self.tokens) + 1):
            low = self.tokens[i].low if i < len(self.tokens) else ""
            here = [p for p, (anchored, words) in made if (i == 0 or not anchored) and (words is None or low in words)]
            if f := next((f for p in here for f in self._match(p, 0, i, {}, lists, i)), None):
                yield f

    def after(self, i: int, pattern: str, lists: dict[str, list[str]]) -> Found | None:
        """As the pattern matches at token i."""
        return next(self._match(compiled(pattern), 0, i, {}, lists, i), None)

    def phrase(self, i: int, words: tuple[str, ...]) -> int | None:
        """Where the phrase that begins at token i ends."""
        for k, w in enumerate(words):
            here = self.tokens[i] if i < len(self.tokens) else None
            if w == "!#":
                return i if here is None or number(here) is None else None
            if k and here and here.low == "-" and w != "-":
                i += 1
                here = self.tokens[i] if i < len(self.tokens) else None
            if here is None or here.kind == "quote" or not (here.low == w or w.endswith("(s)") and here.low in (w[:-3], w[:-3] + "s")):
                return None
            i += 1
        return i

    def _one(self, e: Element, i: int, lists: dict[str, list[str]]) -> Iterator[tuple[int, Any]]:
        """(end, what is found) of one element at token i."""
        ts = self.tokens
        n = len(ts)
        if e.kind == "phrases":
            for words in e.phrases or ordered(tuple(lists[e.text])):
                if (j := self.phrase(i, words)) is not None:
                    yield j, self.between(i, j)
        elif e.kind == "number":
            if i < n and (x := number(ts[i])) is not None and (ts[i].kind == "number" or not e.least):
                yield i + 1, x
        elif e.kind == "quotes":
            found = []
            while i < n and ts[i].kind == "quote":
                found.append(ts[i].low)
                join = self.phrase(i + 1, (",", "and")) or self.phrase(i + 1, (",", "or")) or next((j for w in (",", "and", "or", "&") if (j := self.phrase(i + 1, (w,)))), None)
                if join is None or join >= n or ts[join].kind != "quote":
                    yield i + 1, found
                    return
                i = join
        elif e.kind == "some":
            stops = (".", ";", ":") if e.text == "%" else (".", ";", ":", "(", ")", "?", "!", '"')
            j, count = i, 0
            if not e.least:
                yield i, ""
            while count < e.most and j < n and ts[j].low not in stops and (e.text == "%" or ts[j].kind != "quote"):
                if e.text == "@" and j == i and not ts[i].text[0].isupper():
                    return
                count += ts[j].low not in (",", "-")
                j += 1
                while j < n and ts[j].low == "-" and ts[j].at == ts[j - 1].to:  # a word goes on after a hyphen
                    j = min(j + 2, n)
                if count >= e.least:
                    yield j, self.between(i, j)
        elif e.kind == "gap":
            for j in range(i, n + 1):
                yield j, self.between(i, j)
                if j < n and ts[j].low in (".", ";"):
                    return
        elif e.kind == "rest":
            yield n, self.text[ts[i].at :] if i < n else ""
        elif (e.kind == "begin" and i == 0) or (e.kind == "end" and i == n):
            yield i, ""

    def _match(self, pattern: list[Element], k: int, i: int, names: dict[str, Any], lists: dict[str, list[str]], begin: int) -> Iterator[Found]:
        if k == len(pattern):
            yield Found(begin, i, names)
            return
        e = pattern[k]
        for j, what in self._one(e, i, lists):
            got = {**names, e.name: what, e.name + "_at": i} if e.name else names
            if e.many == "*" and j > i:
                yield from self._match(pattern, k, j, got, lists, begin)
            yield from self._match(pattern, k + 1, j, got, lists, begin)
        if e.many:
            yield from self._match(pattern, k + 1, i, names, lists, begin)


class Element(NamedTuple):
    kind: str
    text: str
    phrases: tuple[tuple[str, ...], ...]
    least: int
    most: int
    many: str
    name: str


@lru_cache(maxsize=None)
def ordered(phrases: tuple[str, ...]) -> tuple[tuple[str, ...], ...]:
    """Phrases as words, those of most words first, and long words before short ones."""
    return tuple(sorted((tuple(p.split()) for p in phrases), key=lambda w: (-len(w), -sum(map(len, w)))))


_STARTS: dict[tuple[str, int], tuple[bool, frozenset[str] | None]] = {}


def starts_of(pattern: str, lists: dict[str, list[str]]) -> tuple[bool, frozenset[str] | None]:
    """Whether a pattern matches at the beginning alone, and the words with which it must begin (None: any)."""
    key = pattern, id(lists)
    if key not in _STARTS:
        anchored, words, any_ = False, set(), True
        for e in compiled(pattern):
            if e.kind == "begin":
                anchored = True
                continue
            if e.kind != "phrases":
                break
            firsts = [p[0] for p in e.phrases or ordered(tuple(lists[e.text]))]
            words |= {x for w in firsts for x in ((w[:-3], w[:-3] + "s") if w.endswith("(s)") else (w,))}
            if not e.many:
                any_ = False
                break
        _STARTS[key] = anchored, None if any_ else frozenset(words)
    return _STARTS[key]


@lru_cache(maxsize=None)
def compiled(pattern: str) -> list[Element]:
    out = []
    for m in ELEMENT.finditer(pattern):
        body, many, name = m["body"], m["many"] or "", m["name"] or ""
        phrases, least, most, kind = (), 0, 0, "phrases"
        if body[0] == "#":
            kind, least, name = "number", int(body.startswith("#!")), name or body.lstrip("#!")
        elif body[0] in "_%@" and len(body) > 1:
            kind, (least, most), body = "some", map(int, body[1:].split("-")), body[0]
        elif body[0] == "(":
            phrases = ordered(tuple(body[1:-1].split("|")))
        elif body[0] == "{":
            body = body[1:-1]
        elif body in ("..", "...", "^", "$", '"'):
            kind = {"..": "gap", "...": "rest", "^": "begin", "$": "end", '"': "quotes"}[body]
        else:
            phrases = ((body,),)
        out.append(Element(kind, body, phrases, least, most, many, name))
    return out
