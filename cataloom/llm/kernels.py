"""Numpy kernels over Arrow text columns: words, lines and hashes of whole batches without a Python loop per word.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes of short spans are 64-bit polynomials over random
byte codes, mixed afterwards. Modulo a power of two, certain pairs of long strings of two letters (those of Thue and Morse, from some
1,000 letters on) have one polynomial whatever the codes are, so spans of LONG bytes and more are hashed by BLAKE2b instead. Equal spans have
equal hashes; shorter ones that differ collide as random ones do, but for such strings, where half of the bits still differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MASK = (1 << 64) - 1

_rng = np.random.Generator(np.random.PCG64(20240607))
CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER_CODES = CODES[LOWER]


def mapped(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table[data]`` of bytes, for a table of 256 bytes or booleans; read-only."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i <= n."""
    have = _powers.get("up")
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        with np.errstate(over="ignore"):
            for key, base in (("up", BASE), ("down", INVERSE)):
                step = np.full(size, base, np.uint64)
                step[0] = U(1)
                _powers[key] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


#: Bytes of rows that go to Python at once.
BATCH_BYTES = 4 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, in a session that sends texts to Python in batches of BATCH_BYTES, so that memory doesn't grow with their lengths."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def together(batches: Iterator[pa.RecordBatch], size: int = 4 * BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches in runs of about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


_resident: dict[str, object] = {}


def resident(key: str, build):
    """A large table that a worker keeps for its next tasks; a worker holds one at a time, the newest."""
    if key not in _resident:
        drop_resident()
        _resident[key] = build()
    return _resident[key]


def drop_resident() -> None:
    """Free what :func:`resident` keeps, and give freed memory back, before work that needs it."""
    _resident.clear()
    trim()


def trim() -> None:
    """Gives freed memory back."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps it for later


def slices(column: pa.Array, max_bytes: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about ``max_bytes``; a longer text is a run of its own. Null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        to = min(to, n)
        base = offsets[at]
        yield at, to, data[base : offsets[to]], offsets[at : to + 1] - base
        at = to


#: Spans of so many bytes are hashed by BLAKE2b.
LONG = 512


@dataclass(frozen=True)
class Sums:
    """Running sums of a text's polynomial, and the text."""

    values: np.ndarray
    data: np.ndarray
    fold_case: bool


def prefix_hash(data: np.ndarray, fold_case: bool) -> Sums:
    """Running sums that :func:`span_hash` takes differences of."""
    up, _ = powers(len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0], codes = 0, out[1:]
    (LOWER_CODES if fold_case else CODES).take(data, out=codes, mode="clip")
    with np.errstate(over="ignore"):
        codes *= up[: len(data)]
        np.cumsum(codes, out=codes)
    return Sums(out, data, fold_case)


def span_hash(sums: Sums, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end)."""
    values, size = sums.values, ends - starts
    _, down = powers(len(values))
    with np.errstate(over="ignore"):
        out = mix((values[ends] - values[starts]) * down[starts] + size.astype(np.uint64) * U(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(size >= LONG):
        own = sums.data[starts[i] : ends[i]]
        out[i] = int.from_bytes(hashlib.blake2b((LOWER[own] if sums.fold_case else own).tobytes(), digest_size=8).digest(), "little")
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each row (rows + 1 values)."""
    inside = mapped(data, ~SPACE)
    edge = np.empty(len(data), bool)
    np.greater(inside[1:], inside[:-1], out=edge[1:])
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    edge[:1], edge[cuts] = inside[:1], inside[cuts]
    starts = np.flatnonzero(edge)
    np.greater(inside[:-1], inside[1:], out=edge[:-1])
    cuts = offsets[1:][offsets[1:] > 0] - 1
    edge[-1:], edge[cuts] = inside[-1:], inside[cuts]
    ends = np.flatnonzero(edge) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; less overhead than numpy's own on short arrays."""
    x = np.sort(x)
    keep = np.empty(len(x), bool)
    keep[:1] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def window_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbours in ``hashes``."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * BASE + hashes[j : j + n]
    return mix(out)


class IdTable:
    """Ids of words that are known by their hashes: sorted hashes, where the ids of each begin, and the ids."""

    def __init__(self, hashes: np.ndarray, begins: np.ndarray, ids: np.ndarray):
        self.hashes, self.begins, self.ids = hashes, begins, ids

    @classmethod
    def of(cls, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> IdTable:
        """From hashes in any order, each once, with the ids one after the other."""
        order = np.argsort(hashes)
        own, size = np.concatenate([[0], np.cumsum(sizes)]), sizes[order]
        begins = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        own = own[order] - begins[:-1]
        # The places of all ids at once would take several times the room of the ids.
        placed, step = np.empty(begins[-1], ids.dtype), 1 << 16
        for at in range(0, len(order), step):
            to = min(at + step, len(order))
            placed[begins[at] : begins[to]] = ids[np.arange(begins[at], begins[to]) + np.repeat(own[at:to], size[at:to])]
        return cls(hashes[order], begins, placed)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, is it there) of each hash."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def spans(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids at some places begin, and how many they are."""
        if not len(self.hashes):
            return place, np.zeros(len(place), np.int64)
        return self.begins[place], self.begins[place + 1] - self.begins[place]

    def joined(self, other: IdTable) -> IdTable:
        """Both tables' words; they have none in common."""
        sizes = np.concatenate([np.diff(self.begins), np.diff(other.begins)])
        return IdTable.of(np.concatenate([self.hashes, other.hashes]), sizes, np.concatenate([self.ids, other.ids]))


def no_ids(kind: type) -> IdTable:
    return IdTable(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, kind))
