"""CRC-32C of many byte strings at once, with the mask that record files put on it."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The reflected Castagnoli polynomial, and what the mask adds.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
#: 4-byte words of a lane.
LANE = 256


@lru_cache(1)
def _tables() -> np.ndarray:
    """For each place of a byte in a word, what the byte does to the state."""
    table = np.arange(256, dtype="u4")
    for _ in range(8):
        table = table >> 1 ^ np.where(table & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    out = [table]
    for _ in range(3):
        out.append(out[-1] >> 8 ^ table[out[-1] & 255])
    return np.stack(out[::-1])


def _advance(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """States after as many words as `words` has rows."""
    a, b, c, d = _tables()
    for row in words:
        state = state ^ row
        state = a[state & 255] ^ b[state >> 8 & 255] ^ c[state >> 16 & 255] ^ d[state >> 24]
    return state


@lru_cache(1)
def _lane_shift() -> np.ndarray:
    """What LANE zero words make of each byte of a state."""
    states = (np.arange(256, dtype="u4")[None, :] << (8 * np.arange(4, dtype="u4"))[:, None]).ravel()
    return _advance(states, np.zeros((LANE, 1), "u4")).reshape(4, 256)


def crc32c(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums of consecutive records in `words` (little-endian, unsigned, 4 bytes each) of `sizes` words, 1 at least.

    Each record is cut into lanes of equal length, the first one filled up with leading zeros, which leave a state of
    zero as it is; all lanes go through the tables together and are then put together record by record.
    """
    sizes = np.asarray(sizes, "i8")
    starts = np.cumsum(sizes) - sizes
    lanes = -(-sizes // LANE)
    first = np.cumsum(lanes) - lanes
    filled = np.zeros((int(lanes.sum()), LANE), "<u4")
    shift = np.repeat(first * LANE + lanes * LANE - sizes - starts, sizes)
    words = words.astype("u4")
    words[starts] ^= np.uint32(0xFFFFFFFF)
    filled.ravel()[np.arange(len(words)) + shift] = words
    lane = _advance(np.zeros(len(filled), "u4"), np.ascontiguousarray(filled.T))
    state, shifts = np.zeros(len(sizes), "u4"), _lane_shift()
    for k in range(int(lanes.max(initial=0))):
        on = np.flatnonzero(lanes > k)
        s = state[on]
        state[on] = shifts[0][s & 255] ^ shifts[1][s >> 8 & 255] ^ shifts[2][s >> 16 & 255] ^ shifts[3][s >> 24] ^ lane[first[on] + k]
    return state ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return (crc >> 15 | crc << 17) + np.uint32(MASK_DELTA)
