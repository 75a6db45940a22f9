"""Byte n-grams of many texts at once, and a bounded table of what a model says of each n-gram."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

START = b"\n"


def packed(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of `order` bytes (8 at most), packed into integers, and where each text's begin.

    Each text counts as preceded by order - 1 line ends, so that it has as many n-grams as bytes.
    """
    lead = START * (order - 1)
    data = np.frombuffer(b"".join(x for text in texts for x in (lead, text)), "u1")
    sizes = np.array([len(text) for text in texts])
    starts = np.cumsum(sizes) - sizes
    keys = np.zeros(max(0, len(data) - order + 1), "u4" if order <= 4 else "u8")
    for k in range(order):
        keys = keys << 8 | data[k : k + len(keys)]
    inside = np.repeat(np.arange(len(texts)) * (order - 1), sizes) + np.arange(int(sizes.sum()))
    return keys[inside], starts


class Lookup:
    """Rows of numbers by packed n-gram: a table of fixed size in front of a function that computes them exactly.

    A slot holds the last n-gram that came to it; another one in its place is computed anew.
    """

    def __init__(self, compute: Callable[[np.ndarray], np.ndarray], width: int, kind: str = "f4", cells: int = 1 << 22):
        bits = max(10, min(20, (cells // width).bit_length() - 1))
        self.compute, self.shift = compute, np.uint64(64 - bits)
        self.tags, self.rows = np.full(1 << bits, -1, "i8"), np.zeros((1 << bits, width), kind)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype("u8")
        slots = keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift
        out, missing = self.rows[slots], np.flatnonzero(self.tags[slots] != keys.view("i8"))
        if len(missing):
            new, back = np.unique(keys[missing], return_inverse=True)
            found = self.compute(new).astype(self.rows.dtype)
            out[missing] = found[back]
            _, one = np.unique(new * np.uint64(0x9E3779B97F4A7C15) >> self.shift, return_index=True)
            slots = new[one] * np.uint64(0x9E3779B97F4A7C15) >> self.shift
            self.tags[slots], self.rows[slots] = new[one].view("i8"), found[one]
        return out


def sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of each text, zero for an empty one."""
    out = np.zeros((len(starts), rows.shape[1]))
    ends = np.append(starts[1:], len(rows))
    full = np.flatnonzero(ends > starts)
    if len(full):
        out[full] = np.add.reduceat(rows, starts[full], axis=0, dtype="f8")
    return out


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among the sorted ones, and where."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), "i8")
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at
