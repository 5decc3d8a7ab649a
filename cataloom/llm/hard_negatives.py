"""Hard negatives by product quantisation with stored residual norms.

Vectors of integers are stored as codes, one byte for each subspace of two dimensions, with the norm of what the codes leave over and the vector
itself. A table of an anchor's products with all codewords gives an approximate score by lookups; it differs from the exact one by at most the
anchor's norm times the residual's, so a row whose upper bound misses what is already held, or whose lower bound is above a window, can't enter it and is
left out. All others get their exact integer score. First the positives of each anchor are found, which set its windows of scores; then a second scan
completes the windows. Anchors go to the rows in blocks; each task keeps the few best rows of each window, and one small shuffle decides.

The codebooks are fitted on a bounded sample (SAMPLE vectors by the least hash of their ids); every row is stored, and as bounds are rigorous the result
doesn't depend on the codebooks.

Defined results: rows with a null label or vector, a null or non-finite component, or one whose integer doesn't fit a long take no part; rows with the same
vec_id count as one, the least (label, vector); vectors of fewer components than others are filled up with zeros; scores must fit a long; ties go to the
smaller vec_id; an anchor without positives, or a positive without rows in its window, has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.sources.shared import materialize

#: Vectors that codebooks are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 4096, 6
#: Dimensions of a subspace and codewords of each.
WIDE, CODEWORDS = 2, 256
#: Anchors of a block that is broadcast (16 MB at 64 dimensions), those worked on at once, and rows at once.
ANCHORS_AT_ONCE, GROUP, ROWS = 1 << 15, 512, 2048
#: The first rows of a task are few, so that bounds tighten early.
FIRST_ROWS = 128
#: Pairs that are scored exactly at once.
PAIRS = 1 << 15
#: Relative room for rounding in single precision, twice what a lookup can lose.
ROUNDING = 1.2e-7


@dataclass
class Codebooks:
    """words: (subspaces, CODEWORDS, WIDE). exact: the type in which products of stored vectors are whole numbers."""

    words: np.ndarray
    dimensions: int
    stored: str
    exact: str

    @property
    def norm(self) -> float:
        """No sum of codewords is longer."""
        return float(np.sqrt((self.words**2).sum(axis=2).max(axis=1).sum()))

    def split(self, vectors: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(vectors), len(self.words) * WIDE))
        padded[:, : vectors.shape[1]] = vectors
        return padded.reshape(len(vectors), len(self.words), WIDE)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of vectors, and the norms of the residuals, rounded up."""
        parts = self.split(vectors)
        codes = np.empty(parts.shape[:2], np.uint8)
        left = np.zeros(len(vectors))
        for m, words in enumerate(self.words):
            near = parts[:, m] @ words.T * -2 + (words**2).sum(axis=1)
            codes[:, m] = near.argmin(axis=1)
            left += ((parts[:, m] - words[codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(left) * (1 + 1e-9)

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """(subspaces, anchors, CODEWORDS): the anchors' products with all codewords."""
        return np.einsum("amw,mcw->mac", self.split(anchors), self.words).astype(np.float32)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector (array of long: floor(256 * x)) of the rows that take part, one an id."""
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * 256) < F.lit(float(1 << 62))))
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fits)
    made = whole.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector")
    )
    return made.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dimensions).all():
        return flat.reshape(-1, dimensions)
    out = np.zeros((len(sizes), dimensions), flat.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def fit(rows: DataFrame, sample: int = SAMPLE) -> Codebooks:
    """Codebooks for rows of :func:`usable`: a few rounds of k-means in each subspace, from points spread along its first axis."""
    stats = rows.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    dimensions, most = max(stats[0] or 0, 1), stats[1] or 0
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow().column("vector").combine_chunks()
    points = _matrix(drawn, dimensions).astype(np.float64) if len(drawn) else np.zeros((1, dimensions))
    stored = next((t for t in ("int16", "int32") if most <= np.iinfo(t).max), "int64")
    exact = "float64" if dimensions * most**2 < 1 << 53 else "int64"
    books = Codebooks(np.zeros((-(-dimensions // WIDE), CODEWORDS, WIDE)), dimensions, stored, exact)
    parts = books.split(points)
    for m in range(parts.shape[1]):
        own = parts[:, m]
        words = own[np.lexsort(own.T)][np.linspace(0, len(own) - 1, CODEWORDS).astype(int)].copy()
        for _ in range(ROUNDS):
            code = (own @ words.T * -2 + (words**2).sum(axis=1)).argmin(axis=1)
            n = np.bincount(code, minlength=CODEWORDS)
            for w in range(WIDE):
                words[:, w] = np.where(n > 0, np.bincount(code, own[:, w], CODEWORDS) / np.maximum(n, 1), words[:, w])
        books.words[m] = words
    return books


def index(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, codes, residual, vector (both binary) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"), books.dimensions)
            codes, residual = books.encode(vectors.astype(np.float64))
            kept = vectors.astype(books.stored)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(residual), pa.array([v.tobytes() for v in kept], pa.binary())],
                ["vec_id", "label", "codes", "residual", "vector"]
            )

    return rows.mapInArrow(run, "vec_id long, label long, codes binary, residual double, vector binary")


def _fixed(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows of a binary column that all have ``width`` numbers."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2] or b"", kind, int(offsets[-1] - offsets[0]) // np.dtype(kind).itemsize, int(offsets[0])).reshape(-1, width)


@dataclass
class Windows:
    """Of each anchor (vec_id, label, vector): windows of scores, each from ``low`` to ``high``, of which the first ``k`` rows are wanted."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int
    same_label: bool


class Held:
    """The best rows of each window so far, by groups of anchors, and the score below which no row can enter a window any more."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.groups: dict[object, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.least = windows.low.copy()

    def add(self, group: object, *new: np.ndarray) -> None:
        """New (window, score, row) of a group's anchors."""
        before = self.groups.get(group)
        at, score, row = (np.concatenate(x) for x in zip(before, new)) if before else new
        order = np.lexsort((row, -score, at))
        at, score, row = at[order], score[order], row[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        full = place == self.windows.k - 1
        self.least[at[full]] = score[full]
        keep = place < self.windows.k
        self.groups[group] = at[keep], score[keep], row[keep]

    def all(self) -> list[np.ndarray]:
        none = (np.zeros(0, np.int64),) * 3
        return [np.concatenate(x) for x in zip(none, *self.groups.values())]


def _search(shared, books: Codebooks) -> Callable:
    """Fills the windows of a block of anchors from a task's rows of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shared.value
        held, seen = Held(windows), 0
        anchors = Anchors.of(windows, books)
        for batch in batches:
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            codes, residual = _fixed(batch.column("codes"), "uint8", len(books.words)), batch.column("residual").to_numpy()
            vectors = _fixed(batch.column("vector"), books.stored, books.dimensions)
            begin = 0
            while begin < len(ids):
                end = min(len(ids), begin + (ROWS if seen else FIRST_ROWS))
                part, seen = slice(begin, end), seen + end - begin
                begin = end
                own = (ids[part], labels[part], codes[part], residual[part], vectors[part].astype(books.exact))
                for kind in np.unique(own[1]) if windows.same_label else (None,):
                    pick = slice(None) if kind is None else np.flatnonzero(own[1] == kind)
                    who = anchors.windowed if kind is None else anchors.windowed[windows.labels[anchors.windowed] == kind]
                    for first in range(0, len(who), GROUP):
                        _fill(held, (kind, first), books, anchors, who[first : first + GROUP], *(x[pick] for x in own))
        at, score, row = held.all()
        columns = (windows.ids[windows.anchor[at]], windows.low[at], windows.high[at], row, score)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "low", "high", "vec_id", "score"])

    return run


@dataclass
class Anchors:
    """What the search needs of its anchors: those that have windows, where an anchor's windows begin, vectors, norms, and room for rounding."""

    windowed: np.ndarray
    begins: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    slack: np.ndarray

    @classmethod
    def of(cls, windows: Windows, books: Codebooks) -> Anchors:
        begins = np.searchsorted(windows.anchor, np.arange(len(windows.ids) + 1))
        norms = np.sqrt((windows.vectors.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-6)
        return cls(
            np.flatnonzero(np.diff(begins)), begins, windows.vectors.astype(books.exact), norms.astype(np.float32),
            (ROUNDING * (len(books.words) + 8) * norms * books.norm + 1).astype(np.float32)
        )

    def windows(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the windows of some anchors, one anchor's after the other's, and how many each has."""
        n = self.begins[who + 1] - self.begins[who]
        return np.arange(n.sum()) + np.repeat(self.begins[who] - (np.cumsum(n) - n), n), n


def _fill(held: Held, group: object, books: Codebooks, anchors: Anchors, who, ids, labels, codes, residual, vectors) -> None:
    """A group of anchors against some rows: bounds by lookups, then exact scores of the rows that may enter a window."""
    windows = held.windows
    about = np.zeros((len(who), len(ids)), np.float32)
    for table, code in zip(books.tables(windows.vectors[who].astype(np.float64)), codes.T):
        about += table[:, code]
    up = np.nextafter(residual.astype(np.float32), np.float32(np.inf)) * np.float32(1 + 1e-6)
    room = anchors.norms[who][:, None] * up + anchors.slack[who][:, None]
    mine, n = anchors.windows(who)
    starts = np.cumsum(n) - n
    least = np.nextafter(np.minimum.reduceat(held.least[mine], starts).astype(np.float32), np.float32(-np.inf))
    high = np.nextafter(np.maximum.reduceat(windows.high[mine], starts).astype(np.float32), np.float32(np.inf))
    may = (about + room >= least[:, None]) & (about - room <= high[:, None])
    may &= (windows.ids[who][:, None] != ids) if windows.same_label else (windows.labels[who][:, None] != labels)
    a, r = np.nonzero(may)
    for first in range(0, len(a), PAIRS):
        one, row = who[a[first : first + PAIRS]], r[first : first + PAIRS]
        score = np.einsum("ij,ij->i", anchors.vectors[one], vectors[row]).astype(np.int64)
        at, n = anchors.windows(one)
        pair = np.repeat(np.arange(len(one)), n)
        fits = (score[pair] >= held.least[at]) & (score[pair] <= windows.high[at])
        held.add(group, at[fits], score[pair[fits]], ids[row[pair[fits]]])


def _found(stored: DataFrame, books: Codebooks, windows: Windows) -> DataFrame:
    """anchor_id, low, high, vec_id, score, rank: the first k rows of each window, over all tasks."""
    shared = stored.sparkSession.sparkContext.broadcast(windows)
    near = stored.mapInArrow(_search(shared, books), "anchor_id long, low long, high long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "low", "high").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= windows.k)


def mined(
    rows: DataFrame, anchors: str = "vec_id % 50 = 0", positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95), at_once: int = ANCHORS_AT_ONCE
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: vec_id, label, embedding; ``anchors``: a condition on vec_id.

    An anchor's positives are its nearest rows of the same label; a positive's negatives the nearest rows of other labels with ``percent`` of its score.
    """
    spark = rows.sparkSession
    whole = materialize(usable(rows), "vectors")
    books = fit(whole)
    stored = materialize(index(whole, books), "pq-index")
    asked = stored.where(anchors)
    n_blocks = max(1, -(-asked.count() // at_once))
    block_of, done = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)), []
    bottom, top = np.iinfo(np.int64).min // 2, np.iinfo(np.int64).max // 2
    for number in range(n_blocks):
        # A block of anchors is bounded by at_once; its positives by as many times their number.
        block = asked.where(block_of == number).select("vec_id", "label", "vector").orderBy("vec_id").toArrow().combine_chunks()
        if not block.num_rows:
            continue
        ids, labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
        vectors = _fixed(block.column("vector").combine_chunks(), books.stored, books.dimensions)
        every = np.arange(len(ids))
        one = Windows(ids, labels, vectors, every, np.full(len(ids), bottom), np.full(len(ids), top), positives, True)
        near = materialize(_found(stored, books, one).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        # 100 * score >= low * positive and <= high * positive, in whole numbers; positives of one score share a window.
        low, high = (F.col("positive_score").cast("decimal(38,0)") * p for p in percent)
        bounds = near.withColumn("low", F.ceil(low / 100).cast("long")).withColumn("high", F.floor(high / 100).cast("long")).where("low <= high")
        spans = bounds.select("anchor_id", "low", "high").distinct().orderBy("anchor_id", "low", "high").toArrow()
        at = np.searchsorted(ids, spans.column("anchor_id").to_numpy())
        many = Windows(ids, labels, vectors, at, spans.column("low").to_numpy(), spans.column("high").to_numpy(), negatives, False)
        hits = _found(stored, books, many).select("anchor_id", "low", "high", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        done.append(materialize(bounds.join(hits, ["anchor_id", "low", "high"]).select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
        ), "hard-negatives"))
    if not done:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
