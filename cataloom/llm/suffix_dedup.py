"""Exact removal of repeated passages by a column-wise multi-document construction.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier (smaller doc_id, or earlier in the same
document), judged on the input.

Inserting one symbol of *every* document per round would take as many passes over the whole collection as its longest
document has bytes. So documents are first cut into short ones that can be worked on apart: in each string of LENGTH bytes
the smallest hash of its ``GRAM``-byte grams is its anchor, which only the string's own bytes decide. A *piece* is an anchor
with all strings that it stands for (neighbouring starts), 100 to 168 bytes. Equal strings have equal anchors, so anchors
deal the pieces to collections, within which the construction runs:

    round by round from the last column to the first, one symbol of each piece of a collection is put before its suffix;
    a stable sort by that symbol gives the new suffix order (the column's part of the Burrows-Wheeler transform), and the
    common prefixes of neighbours are updated from those of the round before. Where they reach LENGTH, the suffixes start
    with equal strings, and all but the earliest are repeated.

The columns are read one after the other from the Arrow batches of a sorted partition, which stand for the external files.

Most pieces never get there: copies of a whole piece are resolved by its hash, first within each task (which also keeps
thousands of copies of a text from meeting in one place), then by anchor; only anchors with different pieces send bytes.
Memory of a task is about 300 bytes per distinct piece of one anchor.

Defined results: null and empty texts lose nothing; texts shorter than LENGTH neither; rows with the same doc_id count as
one document, and equal ones of them have no earlier one among themselves; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm import bloom
from cataloom.llm import kernels as K
from cataloom.sources.shared import materialize

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1
COLUMNS = LENGTH + SPAN - 1
#: Low bits of a word that hold a position while minima are taken; longer texts are cut into overlapping parts.
POSITION_BITS = 24
PART = 1 << 22
#: Pieces of a construction; an anchor's pieces always stay together.
BATCH = 40_000
PAD = 256
FIRST = -(1 << 63)
ROWS = "key long, ph long, doc long, pos long, lo short, hi short"


def _part_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),) * 2
    sums = K.prefix_hash(data, fold_case=False)
    _, down = K.powers(n)
    with np.errstate(over="ignore"):
        grams = K.mix((sums.values[GRAM:] - sums.values[:-GRAM]) * down[: n - GRAM + 1])
    low = K.U((1 << POSITION_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    # Strings that cross the end of their text don't count.
    valid = np.ones(len(least), bool)
    for k in np.flatnonzero(offsets[1:-1]) + 1 if len(offsets) > 2 else ():
        valid[max(0, offsets[k] - LENGTH + 1) : offsets[k]] = False
    starts = np.flatnonzero(valid)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),) * 2
    anchor = (least[starts] & low).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    a, s_lo, s_hi = anchor[first], starts[first], starts[last]
    piece = K.span_hash(sums, s_lo, s_hi + LENGTH)
    with np.errstate(over="ignore"):
        piece = K.mix(piece + (a - s_lo).astype(np.uint64) * K.BASE)
    return a, s_lo, s_hi, grams[a], piece


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
    """(first row, base, bytes, offsets, (anchor, first start, last start, anchor's hash, piece's hash)) of runs of texts; positions count from the run's start, base is that of a part of a long text."""
    for at, _, data, offsets in K.slices(column):
        if len(data) <= 1 << (POSITION_BITS - 1):
            yield at, 0, data, offsets, _part_pieces(data, offsets)
        else:
            for base in range(0, len(data), PART):
                part = data[base : base + PART + LENGTH - 1]
                yield at, base, part, np.array([0, len(part)]), _part_pieces(part, np.array([0, len(part)]))


def _batch_pieces(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """doc, anchor, first start, last start (from the text's start), anchor's hash, piece's hash."""
    ids = batch.column("doc").to_numpy(zero_copy_only=False)
    found = []
    for at, base, _, offsets, (a, s_lo, s_hi, ah, ph) in pieces(batch.column("text")):
        row = np.searchsorted(offsets, a, "right") - 1
        shift = base - offsets[row]
        found.append((ids[at + row], a + shift, s_lo + shift, s_hi + shift, ah.view(np.int64), ph.view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*found))


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts [start, end] joined where they touch."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1] + 1)
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at)


def _rows(key, ph, doc, pos, lo, hi) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(x)).cast(t) for x, t in zip((key, ph, doc, pos, lo, hi), kinds)],
        [x.split()[0] for x in ROWS.split(", ")]
    )


def _ranges(doc, start, end) -> pa.RecordBatch:
    """Resolved ranges of repeated starts: lo is -1, pos and ph are the first and last start."""
    doc, start, end = _merged(doc, start, end)
    return _rows(K.mix(doc.view(np.uint64)).view(np.int64), end, doc, start, np.full(len(doc), -1), np.full(len(doc), -1))


def _first_of_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    K.drop_resident()
    for batch in batches:
        doc, a, s_lo, s_hi, ah, ph = _batch_pieces(batch)
        order = np.lexsort((a, doc, ph))
        doc, a, s_lo, s_hi, ah, ph = (x[order] for x in (doc, a, s_lo, s_hi, ah, ph))
        lead = np.ones(len(ph), bool)
        lead[1:] = ph[1:] != ph[:-1]
        group = np.cumsum(lead) - 1
        first = np.flatnonzero(lead)[group] if len(ph) else group
        same = (doc == doc[first]) & (a == a[first])  # a row given twice isn't earlier than itself
        copy = ~lead & ~same
        yield _ranges(doc[copy], s_lo[copy], s_hi[copy])
        yield _rows(ah[lead], ph[lead], doc[lead], a[lead], (a - s_lo)[lead], (a - s_hi)[lead])


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of at least ``least`` rows (but the last) that don't divide a run of equal keys."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            whole = pa.Table.from_batches(held)
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            change = np.flatnonzero(keys[1:] != keys[:-1])
            cut = n - batch.num_rows + int(change[-1]) + 1 if len(change) else (
                n - batch.num_rows if len(held) > 1 and held[-2].column("key")[-1].as_py() != keys[0] else 0
            )
            if cut:
                yield whole.slice(0, cut)
                held = whole.slice(cut).combine_chunks().to_batches()
                n -= cut
    if n:
        yield pa.Table.from_batches(held)


def _by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key, piece, document and position: resolve copies of whole pieces, hand on those of anchors with several."""
    for whole in _whole_groups(batches, 50_000):
        key, ph, doc, pos, lo, hi = (whole.column(i).to_numpy() for i in range(6))
        done = lo < 0
        yield _ranges(doc[done], pos[done], ph[done])
        key, ph, doc, pos, lo, hi = (x[~done] for x in (key, ph, doc, pos, lo, hi))
        if not len(key):
            continue
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        lead = new_key.copy()
        lead[1:] |= ph[1:] != ph[:-1]
        first = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        copy = ~lead & ~((doc == doc[first]) & (pos == pos[first]))
        yield _ranges(doc[copy], (pos - lo)[copy], (pos - hi)[copy])
        group = np.cumsum(new_key) - 1
        several = np.bincount(group, weights=lead)[group] > 1
        ask = lead & several
        yield _rows(key[ask], ph[ask], doc[ask], pos[ask], lo[ask], hi[ask])


def repeated_starts(group: np.ndarray, same: np.ndarray, lo: np.ndarray, hi: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """[piece, d]: the string that starts d bytes before the piece's anchor starts in an earlier piece of its group too.

    Pieces are ordered by group, document and position; ``same`` numbers places, so that a place given twice isn't earlier
    than itself. ``columns`` [column, piece] holds the bytes, with the anchors in column SPAN - 1, and PAD beside a piece, which
    no byte equals: so whatever equals a string of a piece is one too.
    """
    m = len(group)
    out = np.zeros((m, SPAN), bool)
    order = np.arange(m)
    common = np.zeros(m + 1, np.int32)
    base = group.astype(np.int64) << 9
    for column in range(COLUMNS - 1, -1, -1):
        key = base + columns[column][order]
        step = np.argsort(key, kind="stable")
        key, order = key[step], order[step]
        grown = np.zeros(m + 1, np.int32)
        equal = np.flatnonzero(key[1:] == key[:-1]) + 1
        a, b = step[equal - 1] + 1, step[equal]
        near = a == b
        grown[equal[near]] = common[b[near]] + 1
        far = ~near
        if far.any():
            bounds = np.column_stack([a[far], b[far] + 1]).ravel()
            grown[equal[far]] = np.minimum.reduceat(common, bounds)[::2] + 1
        common = grown
        d = SPAN - 1 - column
        if d < 0:
            continue
        long = common[:m] >= LENGTH
        if not long.any():
            continue
        runs = np.flatnonzero(~long)
        run = np.cumsum(~long) - 1
        first = np.minimum.reduceat(order, runs)[run]
        hit = (same[order] != same[first]) & (lo[order] >= d) & (hi[order] <= d)
        out[order[hit], d] = True
    return out


def _construct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over pieces sorted by anchor, document and position: ranges of repeated starts."""
    for whole in _whole_groups(batches, BATCH):
        key, doc, pos, lo, hi = (whole.column(i).to_numpy().astype(np.int64) for i in range(5))
        size = lo - hi + LENGTH
        text = b"".join(whole.column("bytes").to_pylist())
        columns = np.full((COLUMNS, len(key)), PAD, np.uint16)
        row = np.repeat(np.arange(len(key)), size)
        begin = np.cumsum(size) - size
        place = np.arange(len(row)) - begin[row] + (SPAN - 1 - lo)[row]
        columns[place, row] = np.frombuffer(text, np.uint8)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        other = new.copy()
        other[1:] |= (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
        hit_row, d = np.nonzero(repeated_starts(np.cumsum(new) - 1, np.cumsum(other), lo, hi, columns))
        start = pos[hit_row] - d
        yield _ranges(doc[hit_row], start, start)


def _send_pieces(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc", "pos", "lo", "hi", "bytes"]
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            for at, base, data, offsets, (a, s_lo, s_hi, ah, _) in pieces(batch.column("text")):
                row = np.searchsorted(offsets, a, "right") - 1
                pos = a + base - offsets[row]
                doc = ids[at + row]
                pick = np.flatnonzero(bloom.may_hold(shared.value, place_key(doc, pos)))
                raw = data.tobytes() if len(pick) else b""
                parts = [raw[x:y] for x, y in zip(s_lo[pick].tolist(), (s_hi[pick] + LENGTH).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ah[pick].view(np.int64)), pa.array(doc[pick]), pa.array(pos[pick]),
                        pa.array((a - s_lo)[pick], pa.int16()), pa.array((a - s_hi)[pick], pa.int16()),
                        pa.array(parts, pa.binary())
                    ], names
                )

    return run


def place_key(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A long for a place in a document."""
    with np.errstate(over="ignore"):
        return K.mix(doc.view(np.uint64) * K.BASE + pos.astype(np.uint64)).view(np.int64)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc, start, end: ranges of starts of repeated strings; they may overlap."""
    spark = docs.sparkSession
    texts = K.small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = texts.mapInArrow(_first_of_copies, ROWS).repartition(parts, "key").sortWithinPartitions("key", "ph", "doc", "pos")
    met = materialize(firsts.mapInArrow(_by_anchor, ROWS), "passages")
    asked = met.where("lo >= 0").select("doc", "pos")

    shared = spark.sparkContext.broadcast(bloom.sized(asked, key_of=place_key))
    sent = texts.mapInArrow(_send_pieces(shared), "key long, doc long, pos long, lo short, hi short, bytes binary")
    built = sent.repartition(parts, "key").sortWithinPartitions("key", "doc", "pos").mapInArrow(_construct, ROWS)
    return met.where("lo < 0").unionByName(built).select("doc", F.col("pos").alias("start"), F.col("ph").alias("end"))


def gone_bytes(n: int, found: pa.Scalar) -> np.ndarray:
    """Which of a text's n bytes the ranges of repeated starts cover."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, found.values.field("start").to_numpy(), 1)
    np.add.at(change, found.values.field("end").to_numpy() + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def shortened(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes taken out of their texts; a character that loses a byte goes as a whole. Documents that lose nothing stay as they are."""
    ranges = materialize(repeated_ranges(docs), "repeated")
    shared = docs.sparkSession.sparkContext.broadcast(bloom.sized(ranges.select("doc").distinct()))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc"), "text")
    flagged = rows.withColumn("hit", bloom.hits(shared, "doc"))
    by_doc = ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    kind = rows.schema["row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column("text"), batch.column("ranges")):
                if found.is_valid and text.is_valid:
                    raw = np.frombuffer(text.as_buffer(), np.uint8)
                    texts.append(raw[~gone_bytes(len(raw), found)].tobytes().decode("utf-8", "ignore"))
                else:
                    texts.append(text.as_py())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    hit = flagged.where("hit").join(by_doc.hint("merge"), "doc", "left").select("row", "text", "ranges").mapInArrow(cut, f"row {kind}, text string")
    both = flagged.where(~F.col("hit")).select("row", "text").unionByName(hit)
    return both.select(*(F.col("text" if c == "text" else f"row.{c}").alias(c) for c in docs.columns))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    ranges = materialize(repeated_ranges(docs), "repeated")
    by_doc = ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    shared = docs.sparkSession.sparkContext.broadcast(bloom.sized(ranges.select("doc").distinct()))
    own = "doc long, null_id boolean, n_bytes long, sha string, raw binary"

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text")]
            doc = batch.column("doc").to_numpy(zero_copy_only=False)
            hit = bloom.may_hold(shared.value, doc)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"), batch.column("null_id"), pa.array([len(x) for x in raw], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                    pa.array([x if h else None for x, h in zip(raw, hit)], pa.binary())
                ],
                [x.split()[0] for x in own.split(", ")],
            )

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, null_id, n, sha, raw, found in zip(*(batch.column(i) for i in range(6))):
                doc, n, sha = None if null_id.as_py() else doc.as_py(), n.as_py(), sha.as_py()
                raw = raw.as_py() if raw.is_valid else b""
                if not found.is_valid:
                    out.append((doc, n, 0, 0, sha))
                    continue
                gone = gone_bytes(n, found)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((doc, n, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in result.split(", ")])

    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc"), F.col("doc_id").isNull().alias("null_id"), "text"
    )
    return texts.mapInArrow(sized, own).join(by_doc, "doc", "left").select(
        "doc", "null_id", "n_bytes", "sha", "raw", "ranges"
    ).mapInArrow(cut, result)
