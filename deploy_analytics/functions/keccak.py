"""Keccak-256 over columns of bytes: numpy works on a block of every row of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

RATE = 136  #: bytes absorbed at a time
TOGETHER = 1 << 25  #: bytes of input hashed together


def _round_constants() -> list[int]:
    """The 24 constants, from the generator's 8-bit shift register."""
    out, r = [], 1
    for _ in range(24):
        c = 0
        for j in range(7):
            if r & 1:
                c |= 1 << ((1 << j) - 1)
            r = (r << 1) ^ (0x171 if r & 0x80 else 0)
        out.append(c)
    return out


def _rotations() -> list[tuple[int, int, int]]:
    """For the walk (1, 0) -> (y, 2x + 3y): lane x, lane y, triangular number as rotation."""
    out, x, y = [], 1, 0
    for t in range(24):
        out.append((x, y, (t + 1) * (t + 2) // 2 % 64))
        x, y = y, (2 * x + 3 * y) % 5
    return out


_ROUNDS, _WALK = _round_constants(), _rotations()


def _rol(lane: np.ndarray, n: int) -> np.ndarray:
    return (lane << np.uint64(n)) | (lane >> np.uint64(64 - n)) if n else lane


def _permute(a: np.ndarray) -> np.ndarray:
    """a: lanes [x, y, row]."""
    for constant in _ROUNDS:
        c = a[:, 0] ^ a[:, 1] ^ a[:, 2] ^ a[:, 3] ^ a[:, 4]
        d = np.stack([c[(x - 1) % 5] ^ _rol(c[(x + 1) % 5], 1) for x in range(5)])
        a = a ^ d[:, None]
        b = np.empty_like(a)
        b[0, 0] = a[0, 0]
        for x, y, n in _WALK:
            b[y, (2 * x + 3 * y) % 5] = _rol(a[x, y], n)
        a = b ^ (~np.roll(b, -1, axis=0) & np.roll(b, -2, axis=0))
        a[0, 0] ^= np.uint64(constant)
    return a


def _hash_some(rows: list[bytes]) -> list[bytes]:
    """Digests of rows sorted by length, longest first: step by step all rows that still have a block."""
    blocks = np.array([len(r) // RATE + 1 for r in rows])
    starts = np.concatenate([[0], np.cumsum(blocks * RATE)])
    padded = np.zeros(starts[-1], np.uint8)
    for at, end, row in zip(starts, starts[1:], rows, strict=False):
        padded[at : at + len(row)] = np.frombuffer(row, np.uint8)
        padded[at + len(row)] ^= 1
        padded[end - 1] ^= 0x80
    words = padded.view("<u8")
    first, lanes = starts[:-1] // 8, np.arange(RATE // 8)
    state = np.zeros((5, 5, len(rows)), np.uint64)
    for step in range(blocks[0]):
        n = int(np.searchsorted(-blocks, -step, side="left"))  # rows with more than step blocks
        taken = words[first[:n, None] + step * len(lanes) + lanes]
        some = state[:, :, :n].copy()
        for lane in lanes:
            some[lane % 5, lane // 5] ^= taken[:, lane]
        state[:, :, :n] = _permute(some)
    digests = np.stack([state[x, 0] for x in range(4)], axis=1).astype("<u8")
    return [d.tobytes() for d in digests]


def keccak256_many(rows: list[bytes]) -> list[bytes]:
    out: list[bytes] = [b""] * len(rows)
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    while order:
        size = np.cumsum([len(rows[i]) + RATE for i in order])
        cut = max(1, int(np.searchsorted(size, TOGETHER)))
        some, order = order[:cut], order[cut:]
        for i, digest in zip(some, _hash_some([rows[i] for i in some]), strict=True):
            out[i] = digest
    return out


def _run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = batch.to_pylist()
        found = iter(keccak256_many([r for r in rows if r is not None]))
        yield pa.array([None if r is None else next(found) for r in rows], pa.binary())


def keccak256(column):
    """The digest of a binary column; null stays null. Apply it to distinct values where rows repeat."""
    return F.arrow_udf(_run, "binary")(column)
