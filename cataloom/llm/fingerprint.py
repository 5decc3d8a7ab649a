"""Order MinHash fingerprints of documents.

Each k-mer of a text (k code points) is numbered by its occurrence. Each of ``SLOTS`` slots has an order of its own, by a
hash of the numbered k-mer; its ``TUPLE`` least ones are put back into their order in the text and hashed as a tuple. Two
texts share a slot when the minimal k-mers are the same *and* stand in the same order, so that moved passages count as
edits, which plain MinHash can't see.

The likeness of two fingerprints estimates the share of k-mers in common: the share p of equal slots is about J**TUPLE
for Jaccard similarity J of the numbered k-mers, and 2J / (1 + J) is returned.

Defined results: a text shorter than k code points is one k-mer; an empty or null text has an empty fingerprint, which is
like another empty one (1) and unlike anything else (0). K-mers are told apart by 40 bits of their hash, so that
in a text of n code points two different ones are numbered as one with probability near n**2 / 2**41; equal texts always
have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm import kernels as K

KMER = 12
TUPLE = 2
SLOTS = 64
#: Bits of a word that hold a place in the text; a hash has the others.
PLACE_BITS = K.U(24)
#: Factor of each slot's hash, and k-mers that are ordered at once.
FACTORS = np.random.Generator(np.random.PCG64(612)).integers(1, 1 << 63, SLOTS, dtype=np.uint64)[:, None] * K.U(2) + K.U(1)
AT_ONCE = 1024
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
FIRST = -(1 << 63)
#: Documents of a range at most, about.
RANGE_ROWS = 20_000


def sketch(text: str) -> np.ndarray:
    """SLOTS tuple hashes (none for an empty text)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points)
    if not n:
        return np.zeros(0, np.uint32)
    grams = K.window_hash(K.mix(points), KMER) if n >= KMER else K.window_hash(K.mix(points), n)
    m = len(grams)
    gram, place = _sorted(grams)
    new = np.empty(m, bool)
    new[0] = True
    np.not_equal(gram[1:], gram[:-1], out=new[1:])
    index = np.arange(m)
    occurrence = (index - np.maximum.accumulate(np.where(new, index, 0))).astype(np.uint64)
    numbered = np.empty(m, np.uint64)
    with np.errstate(over="ignore"):
        numbered[place.astype(np.int64)] = K.mix(gram * K.BASE + occurrence)
        chosen = np.sort(least_of(numbered, min(TUPLE, m)), axis=1)
        out = np.full(SLOTS, 0x51ED270B, np.uint64)
        for j in range(chosen.shape[1]):
            out = K.mix(out * K.BASE + numbered[chosen[:, j]])
    return out.astype(np.uint32)


def least_of(numbered: np.ndarray, size: int) -> np.ndarray:
    """[slot, i] places of the least k-mers in each slot's order."""
    slots = np.arange(SLOTS)
    best, at = np.empty((SLOTS, 0), np.uint64), np.empty((SLOTS, 0), np.int64)
    for begin in range(0, len(numbered), AT_ONCE):
        order = FACTORS * numbered[begin : begin + AT_ONCE]
        own, places = [best], [at]
        for _ in range(min(size, order.shape[1])):
            least = order.argmin(1)
            own.append(order[slots, least][:, None])
            places.append(least[:, None] + begin)
            order[slots, least] = K.U(K.MASK)
        best, at = np.concatenate(own, axis=1), np.concatenate(places, axis=1)
        if best.shape[1] > size:
            keep = np.argsort(best, axis=1)[:, :size]
            best, at = np.take_along_axis(best, keep, 1), np.take_along_axis(at, keep, 1)
    return at


def _sorted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper ``64 - PLACE_BITS`` bits of hashes in order, and the places they stand at; hash and place share a word while they fit."""
    n = len(hashes)
    if n <= 1 << int(PLACE_BITS):
        low = (K.U(1) << PLACE_BITS) - K.U(1)
        key = np.sort((hashes & ~low) | np.arange(n, dtype=np.uint64))
        return key >> PLACE_BITS, key & low
    upper = hashes >> PLACE_BITS
    order = np.argsort(upper, kind="stable")
    return upper[order], order


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    j = float((a == b).mean()) ** (1 / TUPLE)
    return 2 * j / (1 + j)


def as_text(signature: np.ndarray) -> str:
    """Hexadecimal, eight digits a slot."""
    return signature.astype(">u4").tobytes().hex()


def _edges(docs: DataFrame, parts: int) -> list[int]:
    """Bounds of ranges of doc_id with about equally many documents."""
    found = docs.select(F.col("_key").cast("double").alias("_key")).approxQuantile(
        "_key", [i / parts for i in range(1, parts)], 0.2 / parts
    ) if parts > 1 else []
    return sorted({int(x) for x in found})


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (part, kind, key, doc_id, text) ordered within partitions so that each document is followed by the next one.

    Ids are cut into ranges; the first document of each range also goes, with kind 1, to the end of the range before it
    (that of the first range to the end of the last). So no window spans the table, and a text moves once.
    """
    spark = docs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // RANGE_ROWS)
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("_key"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text")
    )
    edges = _edges(keyed, parts)
    part = F.size(F.filter(F.lit(edges).cast("array<long>") if edges else F.array().cast("array<long>"), lambda x: x <= F.col("_key")))
    rows = keyed.withColumn("_part", part)
    heads = sorted((r["_part"], r["_key"]) for r in rows.groupBy("_part").agg(F.min("_key").alias("_key")).collect())  # one row per range
    moved = [(heads[i - 1][0], heads[i][1]) for i in range(len(heads))]
    to_part = spark.createDataFrame(moved, "_to int, _head long")
    copies = rows.join(F.broadcast(to_part), F.col("_key") == F.col("_head")).select(
        F.col("_to").alias("_part"), F.lit(1).alias("_kind"), "_key", "doc_id", "text"
    )
    both = rows.select("_part", F.lit(0).alias("_kind"), "_key", "doc_id", "text").unionByName(copies)
    # Each range is a partition of its own: by its number, not by a hash of it.
    return both.repartitionById(max(1, len(edges) + 1), F.col("_part")).sortWithinPartitions("_part", "_kind", "_key", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness to each other and to the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, doc_id, text, sketch)
        names = [x.split()[0] for x in RESULT.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3)]
            for part, kind, doc_id, text in zip(*columns, batch.column(4)):
                if held is not None and held[0] != part:
                    held = None
                if held is None and kind:
                    continue  # a further copy of the next range's first document
                text = text.as_py()
                own = sketch(text)
                if held is not None:
                    _, last_id, last, last_own = held
                    n = len(last)
                    edited = last[: n - n // 2] + text[: n // 2]
                    changed = sketch(edited)
                    out.append(
                        (
                            last_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(last_own),
                            as_text(changed), likeness(last_own, changed), likeness(last_own, own)
                        )
                    )
                held = None if kind else (part, doc_id, text, own)
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return with_next(K.small_batches(docs)).mapInArrow(run, RESULT)
