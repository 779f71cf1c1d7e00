"""Compact payloads for what blocks of texts send through a shuffle."""

from __future__ import annotations

import itertools

import numpy as np
import zstandard


def planes(x) -> bytes:
    """32-bit numbers, their lowest bytes first, then the next: small numbers compress well so."""
    return np.asarray(x).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack(*parts: bytes) -> bytes:
    """Byte strings end to end behind their number and lengths, compressed."""
    return zstandard.compress(np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts), 1)


def unpack(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)
    return [raw[a:b] for a, b in itertools.pairwise([4 * (n + 1), *ends.tolist()])]


def pack_sequence(x: np.ndarray, known: int) -> bytes:
    """Word numbers of a document. Numbers from ``known`` on were given to it, in order: their first places are zeros."""
    before = np.maximum.accumulate(np.r_[known - 1, x])[:-1]
    coded = np.r_[known, np.where(x > before, 0, x + 1)].astype("<u4")
    return zstandard.compress(planes(coded), 1)


def unpack_sequence(data: bytes) -> np.ndarray:
    known, *_ = coded = from_planes(zstandard.decompress(data))
    coded = coded[1:].astype(np.int64)
    return np.where(coded == 0, int(known) - 1 + np.cumsum(coded == 0), coded - 1)


def pack_numbers(x: np.ndarray) -> bytes:
    """64-bit numbers, lowest bytes first: planes of zeros cost nothing."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()
