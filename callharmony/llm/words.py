"""Words of a text: runs of bytes that are not ASCII white space."""

from __future__ import annotations

import numpy as np


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes, in order; none for a null text.

    ``bytes.split`` divides at exactly these six characters, and inside a UTF-8 sequence no byte has their values.
    """
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as small numbers: equal numbers for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(word, len(seen)) for word in words), np.int64, len(words))


def window_ids(numbers: np.ndarray, width: int) -> np.ndarray:
    """A number for each window of ``width`` items; equal numbers for equal windows, and no others.

    Windows grow by pairing the numbers of two shorter ones and ranking the pairs, so nothing is hashed.
    """
    if len(numbers) < width:
        return np.empty(0, np.int64)
    out, have = numbers, 1
    while have < width:
        step = min(have, width - have)
        left, right = out[: len(out) - step], out[step:]
        base = int(right.max()) + 1
        out = np.unique(left * base + right, return_inverse=True)[1]
        have += step
    return out
