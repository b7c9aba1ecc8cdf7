"""``text.tokens`` of many texts at a time, in Python tasks: every distinct word is stemmed once for a block of texts."""

from __future__ import annotations

import re

import numpy as np

from .. import params

_WORD = re.compile("[a-z0-9ऀ-ॿ]+").findall
_STOP = frozenset(params.STOP_WORDS)
_LAST = frozenset(x[-1] for x in params.SUFFIXES)


def stem(t: str) -> str:
    """``text.stem`` of one word."""
    if len(t) < 5 or t[-1] not in _LAST or "0" <= t[0] <= "9":
        return t
    if t.endswith("ies"):
        return t[:-3] + "y"
    for suffix in params.SUFFIXES:
        if t.endswith(suffix):
            return t[: -len(suffix)]
    return t


class Vocabulary(dict):
    """Words to numbers of their stems, -1 for words that do not count; ``stems`` has the stems by number."""

    def __init__(self):
        self.stems: list[str] = []
        self._numbers: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        if len(word) < 2 or word in _STOP:
            n = -1
        else:
            s = stem(word)
            n = self._numbers.setdefault(s, len(self.stems))
            if n == len(self.stems):
                self.stems.append(s)
        self[word] = n
        return n

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(place of the text, number of the token) of all tokens of texts in lower case, in order."""
        found, counts, held = [], [], []

        def put():
            found.append(np.fromiter(map(self.__getitem__, held), np.int64, len(held)))
            held.clear()

        for low in texts:
            words = _WORD(low) if low else ()
            counts.append(len(words))
            held.extend(words)
            if len(held) > 100_000:
                put()
        put()
        number = np.concatenate(found)
        kept = number >= 0
        return np.repeat(np.arange(len(counts)), counts)[kept], number[kept]
