"""Bloom filters of a fixed size over long keys: they thin out a scan before an exact join, and never decide by themselves.

The size is a parameter, so what is collected and broadcast is bounded whatever the key column holds; a filter that has
become too full lets rows pass, which the join behind it drops.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm import kernels as K

#: 1 MB.
BITS = 1 << 23
#: Words of a packed row.
CHUNK = 1024
#: Packed rows of a batch.
CHUNKS_AT_ONCE = 256


def _slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    a = K.mix(keys.astype(np.int64).view(np.uint64))
    return (a & K.U(bits - 1)).astype(np.int64), ((a >> K.U(32)) & K.U(bits - 1)).astype(np.int64)


def build(keys: DataFrame, bits: int = BITS, key_of: Callable = lambda column: column) -> np.ndarray:
    """Bitmap (uint8, packed) of the keys that ``key_of`` makes of the long columns of ``keys``."""

    def fill(batches):
        import pyarrow as pa

        # A task's filter is no larger than the whole one; chunks without a key aren't sent.
        own = np.zeros(max(bits // 64, CHUNK), np.uint64)
        for batch in batches:
            for at in _slots(key_of(*(x.to_numpy(zero_copy_only=False) for x in batch.columns)), bits):
                np.bitwise_or.at(own, at >> 6, K.U(1) << (at & 63).astype(np.uint64))
        own = own.reshape(-1, CHUNK)
        full = np.flatnonzero(own.any(axis=1))
        for some in np.array_split(full, len(full) // CHUNKS_AT_ONCE + 1):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array([own[i].tobytes() for i in some], pa.binary())], ["chunk", "words"])

    def pack(batches):
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, words in zip(batch.column("chunk").to_pylist(), batch.column("words").to_pylist()):
                held.setdefault(chunk, np.zeros(CHUNK, np.int64))[:] |= np.frombuffer(words, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array([w.tobytes() for w in held.values()], pa.binary())], ["chunk", "words"]
        )

    # A few rows of 8 KB come back, as many as the filter has room for.
    packed = keys.mapInArrow(fill, "chunk long, words binary").repartition(8, "chunk").mapInArrow(pack, "chunk long, words binary").collect()
    out = np.zeros(max(bits // 64, CHUNK), np.int64)
    for chunk, content in packed:
        out[chunk * CHUNK : (chunk + 1) * CHUNK] |= np.frombuffer(content, np.int64)
    return out[: bits // 64].view(np.uint8)


def sized(keys: DataFrame, most_bits: int = 1 << 28, key_of: Callable = lambda column: column, a_key: int = 12) -> np.ndarray:
    """A filter with some 12 bits a key (or ``a_key``), 1 to 32 MB: right for some twenty million keys.

    Beyond that it passes more and more, and the join behind it deals rows by key.
    """
    bits = BITS
    wanted = a_key * keys.count()
    while bits < min(wanted, most_bits):
        bits *= 2
    return build(keys, bits, key_of)


def hits(bitmap, key: str):
    """Column: may the filter (a broadcast variable) hold the key? Only the key goes to Python."""
    import pandas as pd

    def check(keys: pd.Series) -> pd.Series:
        return pd.Series(may_hold(bitmap.value, keys.to_numpy(np.int64)))

    check.__annotations__ = {"keys": pd.Series, "return": pd.Series}
    return F.pandas_udf(check, "boolean")(key)


def may_hold(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that aren't in the filter."""
    a, b = _slots(keys, len(bitmap) * 8)
    return ((bitmap[a >> 3] >> (a & 7).astype(np.uint8)) & (bitmap[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)
