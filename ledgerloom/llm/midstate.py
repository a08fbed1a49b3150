"""SHA-256 over whole 64-byte blocks with its state laid open, for many messages side by side.

A node's inputs are hex digests, 64 bytes each and so one block each. The state before a child is thus eight words that
can be copied, stored and resumed; a library's hash object keeps its state to itself. Arrays hold one message a column.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

WIDTH = 8  # children of a parent
DIGEST = 32  # bytes


def _primes(n: int) -> list[int]:
    found: list[int] = []
    at = 2
    while len(found) < n:
        if all(at % p for p in found):
            found.append(at)
        at += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= x else (low, mid - 1)
    return low


_ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
_HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), np.uint8).reshape(256, 2)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x >> np.uint32(by) | x << np.uint32(32 - by)


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """state (8, n) after one more block (16, n) of words."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + w[t - 7] + (_turned(x, 7) ^ _turned(x, 18) ^ x >> np.uint32(3))
                 + (_turned(y, 17) ^ _turned(y, 19) ^ y >> np.uint32(10)))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[t] + w[t]
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def absorb(state: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """state (8, n) after the hex text of one digest each, (n, 32) bytes."""
    words = _HEX[digests].reshape(len(digests), 2 * DIGEST).view(">u4").astype(np.uint32)
    return compress(state, np.ascontiguousarray(words.T))


def finish(state: np.ndarray, blocks: int) -> np.ndarray:
    """Digests (n, 32) of messages that ended after so many blocks."""
    tail = np.zeros((16, state.shape[1]), np.uint32)
    tail[0], tail[15] = 1 << 31, 512 * blocks
    return np.ascontiguousarray(compress(state, tail).T.astype(">u4")).view(np.uint8).reshape(-1, DIGEST)


def _finished(state: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.empty((len(sizes), DIGEST), np.uint8)
    for size in np.unique(sizes):
        lanes = np.flatnonzero(sizes == size)
        out[lanes] = finish(state[:, lanes], int(size))
    return out


def parents(children: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, 32) in order to digests (p, 32), states before each slot (p, 8, 8), runs (p, 8, 32) and their sizes (p,)."""
    count = -(-len(children) // WIDTH)
    runs = np.zeros((count * WIDTH, DIGEST), np.uint8)
    runs[:len(children)] = children
    runs = runs.reshape(count, WIDTH, DIGEST)
    sizes = np.full(count, WIDTH)
    sizes[-1] = len(children) - WIDTH * (count - 1)
    state = np.repeat(START[:, None], count, axis=1)
    before = np.empty((count, WIDTH, 8), np.uint32)
    for slot in range(WIDTH):
        before[:, slot] = state.T
        lanes = np.flatnonzero(slot < sizes)
        if len(lanes):
            state[:, lanes] = absorb(state[:, lanes], runs[lanes, slot])
    return _finished(state, sizes), before, runs, sizes


def fold(values: np.ndarray, slots: np.ndarray, before: np.ndarray, runs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Digests of parents whose child in `slots` became `values` (n, 32): each resumes the state before the slot (n, 8)
    with the replacement and the siblings to its right, of runs (n, 8, 32) of so many children."""
    state = np.ascontiguousarray(before.T)
    for at in range(WIDTH):
        lanes = np.flatnonzero((slots <= at) & (at < sizes))
        if len(lanes):
            child = np.where((slots[lanes] == at)[:, None], values[lanes], runs[lanes, at])
            state[:, lanes] = absorb(state[:, lanes], child)
    return _finished(state, sizes)
