"""Splitting of texts into pre-tokens, with the pattern of the public byte-level vocabularies."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable

import public_tokenizers
import regex

PATTERN = public_tokenizers.PATTERN
_find = regex.compile(PATTERN).findall
_wide = re.compile(r" (?:\s|\Z)").search
_cut = re.compile(r"(?= \S)").split


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def pieces(text: str) -> list[str]:
    """Parts of a text whose pre-tokens, one part after the other, are those of the text.

    A cut before a space that a visible character follows never goes through a match of the pattern.
    """
    if _wide(text):
        return [part for part in _cut(text) if part]
    first, *rest = text.split(" ")
    parts = [" " + part for part in rest]
    return [first, *parts] if first else parts


def pretokens(piece: str) -> list[str]:
    return [piece] if piece[piece[0] == " " :].isalpha() else _find(piece)


class PieceCache:
    """Values of pieces already met in this worker, in two generations of `limit` entries or one block's pieces each.

    When the younger is full, it becomes the older, whose entries go unless they are met again. An entry that is gone
    only costs its computation again.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable], limit: int = 250_000):
        self.compute, self.limit, self.young, self.old = compute, limit, {}, {}

    def get(self, piece: str):
        value = self.young.get(piece)
        return self.old.get(piece) if value is None else value

    def of(self, met: set[str]) -> dict:
        """A value for each piece met; none may be None."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        known = self.young
        for piece in met.difference(known):
            if (value := self.old.get(piece)) is not None:
                known[piece] = value
        new = list(met.difference(known))
        known.update(zip(new, self.compute(new), strict=True))
        return known
