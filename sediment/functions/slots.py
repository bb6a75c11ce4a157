"""The membership filter's hash: three slots of a million for each key, vectorised over a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

SLOTS = 1_000_000
HASHES = 3
# Fixed values of the hash: multipliers of the mixing steps, added constant, rotations and shift.
FIRST, SECOND = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
ADDED, TIMES = np.uint64(0x52DCE729), np.uint64(5)
ROTATE_BLOCK, ROTATE_STATE, SHIFT = 31, 27, np.uint64(33)


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def slots(keys: list[bytes]) -> np.ndarray:
    """(keys, 3) slots: the hash with seeds 0, 1, 2, modulo SLOTS as signed numbers.

    Keys are padded to whole 8-byte words; full words go through the block step, a rest through the tail step.
    """
    n = len(keys)
    if not n:
        return np.zeros((0, HASHES), np.int64)
    lengths = np.fromiter((len(k) for k in keys), np.int64, n)
    width = int(lengths.max()) // 8 + 1
    words = np.frombuffer(b"".join(k.ljust(8 * width, b"\0") for k in keys), "<u8").reshape(n, width)
    out = np.empty((n, HASHES), np.int64)
    with np.errstate(over="ignore"):
        for seed in range(HASHES):
            h = np.uint64(seed) ^ lengths.astype(np.uint64)
            for j in range(width):
                block = _rotate(words[:, j] * FIRST, ROTATE_BLOCK) * SECOND
                full = _rotate(h ^ block, ROTATE_STATE) * TIMES + ADDED
                rest = h ^ (words[:, j] * FIRST)
                h = np.where(lengths >= 8 * (j + 1), full, np.where(lengths > 8 * j, rest, h))
            for factor in (FIRST, SECOND):
                h = (h ^ (h >> SHIFT)) * factor
            out[:, seed] = (h ^ (h >> SHIFT)).view(np.int64) % SLOTS
    return out


@pandas_udf(ArrayType(LongType()))
def key_slots(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The slots of each key, which must not be null."""
    for part in keys:
        yield pd.Series(list(slots([k.encode() for k in part])), dtype=object)
