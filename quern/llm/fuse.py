"""Static binary-fuse filters (Graf and Lemire, 2022) over 64-bit keys: three slots per key, 16-bit fingerprints."""

from __future__ import annotations

import math

import numpy as np

U = np.uint64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + U(seed)
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _layout(n: int) -> tuple[int, int]:
    """Segment length and number of segments that can start a key's triple."""
    n = max(n, 2)
    length = min(1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25)), 1 << 18)
    slots = round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
    return length, max(1, -(-slots // length) - 2)


def _slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    first = ((h >> U(32)) * U(segments * length)) >> U(32)
    second = (first + U(length)) ^ ((h >> U(18)) & U(length - 1))
    third = (first + U(2 * length)) ^ (h & U(length - 1))
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> U(32))).astype(np.uint16)


def build(keys: np.ndarray) -> dict:
    """A filter over the keys (repeats count once): its parameters and its table of fingerprints. No key of it is ever missed."""
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    length, segments = _layout(len(keys))
    size = (segments + 2) * length
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        at = _slots(h, length, segments)
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, dtype=np.int64)  # xor of the keys that still touch a slot
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(len(keys)))
        left, order = len(keys), []
        while left:
            alone = np.flatnonzero(count == 1)
            if not len(alone):
                break
            who, pick = np.unique(owner[alone], return_index=True)
            order.append((who, alone[pick]))
            for row in at[:, who]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, who)
            left -= len(who)
        if left:
            continue
        table, prints = np.zeros(size, dtype=np.uint16), _prints(h)
        for who, slot in reversed(order):
            a, b, c = at[:, who]
            table[slot] = prints[who] ^ table[a] ^ table[b] ^ table[c] ^ table[slot]
        return {"seed": seed, "length": length, "segments": segments, "table": table.tobytes()}
    raise RuntimeError("binary-fuse construction failed for 199 seeds")


def contains(filter_: dict, keys: np.ndarray) -> np.ndarray:
    """True for every key of the filter, and for about one other key in 65,536."""
    h = _mix(np.asarray(keys, dtype=np.uint64), int(filter_["seed"]) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    a, b, c = _slots(h, int(filter_["length"]), int(filter_["segments"]))
    table = np.frombuffer(filter_["table"], dtype=np.uint16)
    return _prints(h) == table[a] ^ table[b] ^ table[c]
