"""Arrays and byte strings packed for the shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def unpack(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def planes(x: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers with equal places together."""
    return np.ascontiguousarray(x.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T).tobytes()


def values(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def pack_numbers(x: np.ndarray) -> bytes:
    return pack(planes(x))


def unpack_numbers(data: bytes) -> np.ndarray:
    return values(unpack(data))
