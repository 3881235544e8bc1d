"""Word and byte helpers that several operators share."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash

#: The words of a text are maximal runs of bytes other than space and 0x09-0x0D, which is what bytes.split() takes.
SPACES = b" \t\n\r\x0b\x0c"

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_APART = bytes(32 if not (48 <= c < 58 or 97 <= c < 123 or c > 127) else c for c in range(256))
_S1, _S2 = np.uint64(31), np.uint64(29)


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text; none for null."""
    return text.split() if text else []


def plain_tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return text.decode("utf-8", "replace").lower().encode().translate(_APART).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _S1)) * _K2
    return x ^ (x >> _S2)


def word_hashes(ws: list[bytes], seed: int = 0) -> np.ndarray:
    """XXH64 of each word, as uint64."""
    return np.fromiter(map(xxhash.xxh64_intdigest, ws, repeat(seed)), np.uint64, len(ws))


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a window from the hashes of the two windows it consists of (or that cover it)."""
    return mix(left * _K1 + right)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words, built by doubling from the word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    size, at = 1, h
    while size < width:
        step = min(size, width - size)
        at = join_hashes(at[: len(at) - step], at[step:])
        size += step
    return at


def row_ranges(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of consecutive runs of the given lengths."""
    ends = np.cumsum(lengths)
    return ends - lengths, ends
