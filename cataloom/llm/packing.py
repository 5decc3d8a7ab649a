"""Best-fit packing of token sequences, planned on the histogram of lengths.

The plan is made over *counts* of pieces per length (at most ``capacity`` counts whatever the corpus holds), so it
costs the same for a thousand documents as for a trillion. Documents then take planned places by joining on their
rank within their length. Ranks come from per-(length, salt) counts, so that no task ever holds all pieces of one
length.

Defined results: a null or empty text is one piece holding the end mark alone; a text longer than the capacity is
cut into full pieces, of which only the last may be shorter; repeated rows and ids are packed one by one; an empty
table gives an empty plan; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.llm import kernels as K
from cataloom.sources.shared import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a worker keeps (some 25 bytes each) before it starts anew, and those that it collects before it sorts them in.
CACHED_WORDS, RECENT = 2_000_000, 50_000
#: Letters that have been in Unicode for long.
OLD_LETTERS = re.compile("[a-z\u00aa-\u024f\u0370-\u0527\u0531-\u0587\u05d0-\u05ea\u0620-\u064a\u0904-\u0939\u0e01-\u0e30\u1e00-\u1fff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
MARKS = rb"!\"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"
#: Chunks on which the shortcuts of :class:`WordIds` are tried when a tokenizer is loaded.
PROBES = ("Ab", "abc", "straßenbahn", "éàüñ", "日本語", "thhasted", "straße.", "ÉCOLE!?", "don't", "X1b\")", "İi,", "日本語。.", "it's...", "ΣΑΣ;", "ﬁN-")
#: Rows of a plan that may be broadcast; it has no more than lengths x (salts + ranges).
BROADCAST_ROWS = 2_000_000


#: The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next free one from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(_PRINTABLE))}


def hashes_of(words: list[bytes]) -> np.ndarray:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in words], dtype=np.int64)])
    return K.span_hash(K.prefix_hash(np.frombuffer(b"".join(words), np.uint8), fold_case=False), bounds[:-1], bounds[1:])


class WordIds:
    """Ids of whitespace-free chunks by their hashes; asks the tokenizer once per distinct word.

    Where the tokenizer lower-cases and splits letters from marks (tried on PROBES), a chunk has the ids of its lower-case
    form, and one that ends in marks behind a letter has those of its two parts; but for the tokenizer's own special tokens,
    which it finds as they are written. Letters that its normaliser would change are left to it, with the marks behind them: what they
    become may end in a mark of its own. Hashes have 64 bits: of a million words, two share one with a probability of 3e-8.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        specials = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(x.split() != [x] for x in specials):
            raise ValueError("a special token with white space needs whole texts")
        self.special = re.compile(b"|".join(map(re.escape, specials)) or b"(?!)")
        self.known, self.recent = K.no_ids(np.uint32), K.no_ids(np.uint32)
        self.cuts = False
        probes = [x.encode() for x in PROBES]
        whole = self.asked(probes)
        self.cuts = True
        self.cuts = [[i for y in self.parts(x) for i in self.asked([y])[0]] for x in probes] == whole

    def asked(self, chunks: list[bytes]) -> list[list[int]]:
        """The tokenizer's ids of each chunk. Lower-case letters alone are one word as they are, so its model is asked at once."""
        out = []
        for chunk in chunks:
            text = chunk.decode("utf-8")
            if self.cuts and text.isalpha() and text.islower() and self.normal(text):
                out.append([t.id for t in self.model.tokenize(chunk.decode("latin-1").translate(BYTE_LETTERS))])
            else:
                out.append(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return out

    def normal(self, text: str) -> bool:
        """Does the tokenizer's normaliser leave a text, lower case but for letters outside ASCII, as it is? Letters added to Unicode of late, which it may not know, don't count."""
        return text.isascii() or text == self.normalizer.normalize_str(text) and bool(OLD_LETTERS.fullmatch(text[-1]))

    def parts(self, chunk: bytes) -> list[bytes]:
        """What to ask for instead of a chunk."""
        low = chunk.lower()
        if not self.cuts or self.special.search(low):
            return [chunk]
        body = low.rstrip(MARKS)
        if body and len(body) < len(low):
            text = body.decode("utf-8")
            if text[-1].isalpha() and self.normal(text):
                return [body, low[len(body) :]]
        return [low]

    def learn(self, chunks: list[bytes]) -> None:
        """Takes in chunks that aren't known, and their parts."""
        cut = [self.parts(x) for x in chunks]
        parts = list({y for own in cut for y in own})
        names = hashes_of(parts)
        ids: dict[bytes, list[int]] = {}
        for table in (self.known, self.recent):
            place, there = table.find(names)
            begin, size = table.spans(place)
            for i in np.flatnonzero(there):
                ids[parts[i]] = table.ids[begin[i] : begin[i] + size[i]].tolist()
        asked = [x for x in parts if x not in ids]
        ids.update(zip(asked, self.asked(asked)))
        found = {x: ids[x] for x in asked} | {x: [i for y in own for i in ids[y]] for x, own in zip(chunks, cut)}
        new = K.IdTable.of(
            hashes_of(list(found)), np.array([len(x) for x in found.values()], np.int64),
            np.array([i for x in found.values() for i in x], np.uint32)
        )
        self.recent = self.recent.joined(new)
        if len(self.recent.hashes) > RECENT:
            self.known = self.recent if len(self.known.hashes) > CACHED_WORDS else self.known.joined(self.recent)
            self.recent = K.no_ids(np.uint32)
            K.trim()

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of texts, one text after the other, and where each begins."""
        starts, ends, first = K.word_spans(data, offsets)
        hashes = K.span_hash(K.prefix_hash(data, fold_case=False), starts, ends)
        place, there = self.known.find(hashes)
        left = np.flatnonzero(~there)
        at, also = self.recent.find(hashes[left])
        if not also.all():
            lost = left[~also]
            pick = np.unique(hashes[lost], return_index=True)[1]
            raw, before = data.tobytes(), self.known
            self.learn([raw[starts[i] : ends[i]] for i in lost[pick]])
            if self.known is not before:
                place, there = self.known.find(hashes)
                left = np.flatnonzero(~there)
            at, _ = self.recent.find(hashes[left])
        begin, size = self.known.spans(place)
        more, extra = self.recent.spans(at)
        begin[left], size[left] = more + len(self.known.ids), extra
        upto = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)
        if not len(self.recent.ids):
            return self.known.ids[at], upto[first]
        # Both tables one after the other would be a copy of the known one for each run of texts.
        out, late = np.empty(len(at), np.uint32), at >= len(self.known.ids)
        out[~late], out[late] = self.known.ids[at[~late]], self.recent.ids[at[late] - len(self.known.ids)]
        return out, upto[first]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    The tokenizer drops white space and never joins across it, so a text's ids are the ids of its
    whitespace-separated chunks one after the other; each worker tokenizes a distinct chunk once.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = K.resident(f"words of {tokenizer_path}", lambda: WordIds(tokenizer_path))
        end = np.array([end_id], "<u4")
        for batch in batches:
            out: list[tuple] = []
            doc_ids = batch.column("doc_id").to_pylist()
            for first, last, data, offsets in K.slices(batch.column("text"), 1 << 18):
                flat, bounds = words.ids(data, offsets)
                for doc_id, a, b in zip(doc_ids[first:last], bounds[:-1].tolist(), bounds[1:].tolist()):
                    ids = np.concatenate([flat[a:b], end]).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        out.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return K.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over counts: rows (length, first rank, number, first sequence, offset).

    Rank ``first + i`` of that length goes to sequence ``first sequence + i``, at that offset. Sequences with the
    same space left are kept as ranges, so a step moves a whole range at once.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    heights = np.zeros(capacity + 1, bool)
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted((k for k, v in histogram.items() if v), reverse=True):
        left, rank = histogram[length], 0
        while left:
            fits = np.flatnonzero(heights[length:])
            if len(fits):
                room = int(fits[0]) + length
                first, number = free[room].pop()
                if not free[room]:
                    heights[room] = False
            else:
                # As many new sequences as hold all that is left, each then filled by the best-fit rule itself.
                room, first = capacity, opened
                number = -(-left // (capacity // length))
                opened += number
            take = min(left, number)
            if take < number:
                free.setdefault(room, []).append((first + take, number - take))
                heights[room] = True
            out.append((length, rank, take, first, capacity - room))
            if room > length:
                free.setdefault(room - length, []).append((first, take))
                heights[room - length] = True
            rank, left = rank + take, left - take
    return out


def placed(counts: pd.DataFrame, rows: list[tuple[int, int, int, int, int]]) -> pd.DataFrame:
    """The plan for each (length, salt): rows (length, salt, first place in it, number, first sequence, offset).

    counts: length, salt, n. Both the plan's ranges and the salts' ones divide the same line of ranks, so their common
    parts are no more than both together, and a piece is compared with the few of its own length and salt.
    """
    counts = counts.sort_values(["length", "salt"]).reset_index(drop=True)
    moves = pd.DataFrame(rows, columns=["length", "first", "number", "sequence", "offset"], dtype="int64").sort_values(["length", "first"])
    own, base = (np.concatenate([[0], np.cumsum(x.to_numpy(np.int64))]) for x in (counts["n"], moves["number"]))
    cuts = np.union1d(own, base)
    start, number = cuts[:-1], np.diff(cuts)
    of, move = np.searchsorted(own, start, "right") - 1, np.searchsorted(base, start, "right") - 1
    salt, plan_ = counts.iloc[of], moves.iloc[move]
    return pd.DataFrame({
        "length": salt["length"].to_numpy(np.int64), "salt": salt["salt"].to_numpy(np.int64), "first": start - own[of], "number": number,
        "sequence": plan_["sequence"].to_numpy(np.int64) + start - base[move], "offset": plan_["offset"].to_numpy(np.int64),
    })


def packed(pieces: DataFrame, capacity: int = 4096, salts: int = 256) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` is read twice: pass a written table."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    # At most capacity x salts rows, however large the corpus is.
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).toPandas()
    rows = plan({int(k): int(v) for k, v in counts.groupby("length")["n"].sum().items()}, capacity)
    places = placed(counts, rows)
    own = spark.createDataFrame(places, "length long, salt long, first long, number long, sequence long, offset long")
    # A (length, salt) pair is a hash bucket: even when one length holds a third of all rows.
    ranked = salted.withColumn(
        "rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    )
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("number"))
    joined = ranked.join(F.broadcast(own) if len(places) <= BROADCAST_ROWS else own, ["length", "salt"]).where(inside)
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenize, cut and pack whole documents; see the module's text."""
    pieces = materialize(tokenized_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    return packed(pieces, capacity)
