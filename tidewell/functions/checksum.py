"""The format's checksum: unreflected Castagnoli constant in a right-shifting register."""

from __future__ import annotations

import numpy as np

#: Fixed values of the stored format.
POLYNOMIAL, START = 0x1EDC6F41, 0xFFFFFFFF


def _table() -> np.ndarray:
    c = np.arange(256, dtype="u4")
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1)
    return c


TABLE = _table()


def checksums(rows: np.ndarray) -> np.ndarray:
    """One checksum per row of a byte matrix; all rows advance together, byte by byte."""
    c = np.full(len(rows), START, "u4")
    for byte in rows.T:
        c = TABLE[(c ^ byte) & 0xFF] ^ (c >> 8)
    return ~c


def each_checksum(images: list[bytes]) -> np.ndarray:
    """One checksum per image; images of one length advance together."""
    sizes, out = np.array([len(i) for i in images], "i8"), np.empty(len(images), "u4")
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[at] = checksums(np.frombuffer(b"".join([images[k] for k in at.tolist()]), "u1").reshape(len(at), size))
    return out


def checksum(data: bytes) -> int:
    return int(checksums(np.frombuffer(data, "u1").reshape(1, -1))[0]) if data else 0
