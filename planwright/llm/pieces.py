"""Cutting text into the units that a byte-level tokenizer encodes one by one, with what each gave kept."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: A space after another white space: there the text can't be cut before each space.
_BESIDE = re.compile(r"\s ")


class PieceCache:
    """Encodes texts by way of ``encode``, which gets a list of matches of ``pattern`` and gives a value for each.

    No match of the pattern holds white space after a non-white-space character, so text can be cut before any space
    that follows one; the words so cut repeat, and ``join`` of their pieces' values is kept by word. Values that weren't
    asked for while the last ``limit`` came are given up.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], list], join: Callable[[list], object], limit: int = 200_000):
        self.find = regex.compile(pattern).findall
        self.encode, self.join, self.limit = encode, join, limit
        self.words: dict[str, object] = {}
        self.pieces: dict[str, object] = {}
        self.old_words, self.old_pieces = self.words, self.pieces

    @staticmethod
    def _known(wanted: set[str], now: dict[str, object], old: dict[str, object]) -> list[str]:
        """Take values over from the old ones; what is left has none."""
        wanted = wanted.difference(now)
        for w in wanted.intersection(old):
            now[w] = old[w]
        return list(wanted.difference(old))

    def _learn(self, units: set[str]) -> None:
        whole, cut = [], {}
        for u in self._known(units, self.words, self.old_words):
            letters = u[0] == " " or u[0].isalpha()
            # letters after at most one space are one match, which is kept as a word; so is a common mark after them
            if letters and u[1:].isalpha():
                whole.append(u)
            elif letters and u[-1] in ".,!?;:" and u[1:-1].isalpha():
                cut[u] = (u[:-1], u[-1])
            else:
                cut[u] = self.find(u)
        pieces = self._known({p for found in cut.values() for p in found}, self.pieces, self.old_pieces)
        values = self.encode(whole + pieces)
        self.words.update(zip(whole, values, strict=False))
        self.pieces.update(zip(pieces, values[len(whole) :], strict=True))
        get = self.pieces.__getitem__
        for u, found in cut.items():
            self.words[u] = get(found[0]) if len(found) == 1 else self.join(list(map(get, found)))

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        if _BESIDE.search(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def values(self, texts: list[str]) -> list[list]:
        """The values of each text's units, in order."""
        if len(self.words) > self.limit:
            self.words, self.old_words = {}, self.words
        if len(self.pieces) > self.limit:
            self.pieces, self.old_pieces = {}, self.pieces
        units = [self.units(t) for t in texts]
        self._learn(set().union(*units))
        get = self.words.__getitem__
        return [list(map(get, u)) for u in units]
