"""Byte-level BPE: Spark's higher-order functions fold ranked merges over the bytes of distinct words.

A text is split by the tokenizer's pattern. A word's bytes become their ids, and a fold joins, again and again, the
neighbouring pair of lowest rank (the leftmost of equal ones). The rank map is a pair of literal arrays: each token of
the vocabulary is joined last from exactly one pair of tokens, so that (left id, right id) -> id has one entry per token,
at the place that the left id's shift and the right id add up to. Looking up a pair costs two array reads, without any hash map.

Distinct words are counted over all documents. Those above a count, which a histogram of the counts sets so that there are
``FREQUENT`` of them at most, are folded once, and every worker gets their ids as sorted arrays. A document takes the ids of
its words from there; its other distinct words go to the fold with it, and come back into its gaps. So nothing but counts is
shuffled. A word over ``LONG`` bytes is folded with all occurrences of the best pair joined in one round, which gives the
same ids where every token ranks behind its parts (checked when the ranks are loaded; else it is folded like the others).
Decoding puts the tokens' binary pieces one after the other.

Frequent words are known by 64-bit hashes; two different words of a corpus with a billion of them share one with a
probability of about 1 in 40,000.

Defined results: a null or empty text has no tokens; repeated rows get one row each; extra columns are kept (``ids`` is
replaced); an id outside the vocabulary decodes to nothing; a pattern that splits off less than the whole text is refused.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.llm import kernels as K
from cataloom.sources.shared import materialize

#: White space as the tokenizer's library has it; Java's and Python's \s are others.
WHITE = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: What stands for letters, numbers and white space inside a class.
JAVA = {"L": r"\p{L}", "N": r"\p{N}", "s": WHITE}
ASCII = {"L": "A-Za-z", "N": "0-9", "s": r"\t-\r "}


def translated(pattern: str, classes: dict[str, str]) -> str:
    """The tokenizer's pattern with letters, numbers and white space spelled out for another library."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        step = 2 if pattern[at] == "\\" else 1
        part = pattern[at : at + step]
        if part == r"\p":
            step = pattern.index("}", at) + 1 - at
            part = pattern[at : at + step]
        name = {r"\p{L}": "L", r"\p{N}": "N", r"\s": "s", r"\S": "S"}.get(part)
        if part.startswith(r"\p") and name is None or part[0] == "\\" and part[1].isalnum() and name is None or name == "S" and inside:
            raise ValueError(f"{part} of the pattern isn't known here")
        if name:
            part = classes[name] if inside else f"[^{classes['s']}]" if name == "S" else f"[{classes[name]}]"
        elif part == "[":
            inside = True
        elif part == "]":
            inside = False
        out.append(part)
        at += step
    return "".join(out)


def java_pattern(pattern: str) -> str:
    return translated(pattern, JAVA)


@cache
def splitters(pattern: str) -> tuple[Callable, Callable, Callable]:
    """findall of the pattern for texts of ASCII, of the basic plane, and of any characters."""
    import regex

    spans: dict[str, list[str]] = {"L": [], "N": []}
    for kind, found in spans.items():
        start = None
        for point in range(0x10000 + 1):
            if point < 0x10000 and unicodedata.category(chr(point))[0] == kind:
                start = point if start is None else start
            elif start is not None:
                found.append(f"\\u{start:04x}-\\u{point - 1:04x}")
                start = None
    plane = {"L": "".join(spans["L"]), "N": "".join(spans["N"]), "s": WHITE}
    return re.compile(translated(pattern, ASCII)).findall, re.compile(translated(pattern, plane)).findall, regex.compile(translated(pattern, JAVA)).findall


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> id, for the last join that makes each token from its bytes.

    Joins inside a token's span don't depend on what stands around it, so no other pair ever makes it.
    """
    out = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(
                ((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks),
                default=None
            )
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out[ranks[parts[0]], ranks[parts[1]]] = rank
    return out


#: Bits of an id, and an entry that no pair has.
ID_BITS, EMPTY = 16, 1 << 40


def rank_table(pairs: dict[tuple[int, int], int]) -> tuple[list[int], list[int]]:
    """(shift of each left id, entries): the pair (left, right) stands at shift + right, as left * 65536 + id.

    Each left id's row of rights is laid over the others at the first place where it meets none of their entries.
    """
    rows: dict[int, dict[int, int]] = {}
    for (left, right), rank in pairs.items():
        rows.setdefault(left, {})[right] = rank
    taken = np.zeros(1 << 24, bool)
    shifts, last = np.zeros(1 << 16, np.int64), 0
    # Where rows of a size began to fit is full for later ones of that size.
    full = [0] * 9
    for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        rights = np.fromiter(row, np.int64)
        begin = full[min(len(row), 8)]
        while True:
            tried = np.arange(begin, begin + 4096)
            free = np.flatnonzero(~taken[tried[:, None] + rights].any(axis=1))
            if len(free):
                break
            begin += 4096
        full[min(len(row), 8)] = begin
        shifts[left] = tried[free[0]]
        taken[shifts[left] + rights] = True
        last = max(last, int((shifts[left] + rights).max()))
    entries = np.full(last + 1, EMPTY, np.int64)
    for (left, right), rank in pairs.items():
        entries[shifts[left] + right] = left << ID_BITS | rank
    return shifts.tolist(), entries.tolist()


def _literal(values: list, kind: str = "int") -> Column:
    """An array that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _pair_rank(left: Column, right: Column, tables: Column) -> Column:
    """The id of a pair; null or beyond all ids if it has none, as the entry of another left id keeps some bits above them."""
    entry = F.get(tables["entries"], F.get(tables["shifts"], left) + right)
    return entry.bitwiseXOR(F.shiftleft(left.cast("bigint"), ID_BITS))


def _joins(least: Column) -> Column:
    return F.coalesce(least < F.lit(1 << ID_BITS), F.lit(False))


#: Most words in the list of frequent ones, most bytes of such a word, and the count from which on counts are alike.
FREQUENT = 1_000_000
LONG = 64
COUNTED = 100_000
#: Separates the pieces of the vocabulary's literal: no character of a byte.
PIECE_END = "\u2028"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


@dataclass(frozen=True)
class Ranks:
    """A loaded vocabulary; its columns are literals."""

    tokens: list[bytes]
    byte_ids: list[int]
    tables: tuple[list[int], list[int]]
    monotone: bool

    def constants(self) -> Column:
        """The rank map and the ids of single bytes, to be bound once per expression."""
        shifts, entries = _literal(self.tables[0]), _literal(self.tables[1], "bigint")
        return F.struct(F.struct(shifts.alias("shifts"), entries.alias("entries")).alias("tables"), _literal(self.byte_ids).alias("bytes"))


def load(path: str) -> Ranks:
    """Read a rank file on the driver."""
    ranks = load_ranks(path)
    pairs = merge_pairs(ranks)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return Ranks(tokens, [ranks[bytes([i])] for i in range(256)], rank_table(pairs), all(rank > max(pair) for pair, rank in pairs.items()))


def _byte_ids(word: Column, constants: Column) -> Column:
    return F.transform(F.split(F.decode(F.encode(word, "utf-8"), "ISO-8859-1"), ""), lambda c: F.get(constants["bytes"], F.ascii(c)))


def fold(ids: Column, tables: Column) -> Column:
    """Joins pairs by rank until none is left: one round less than there are ids. An entry of the state is an id, and above it the rank of its pair with the next
    one. A rank has one pair, so entries of equal ranks are equal, and the first place of the least entry is that of the leftmost pair to join."""
    start, none = F.lit(1 << 40), F.lit(1 << ID_BITS)
    id_of = lambda entry: entry.bitwiseAND((1 << ID_BITS) - 1).cast("int")

    def entry(left: Column, right: Column) -> Column:
        rank = _let(_pair_rank(left, right, tables), lambda r: F.when(_joins(r), r).otherwise(none))
        return F.shiftleft(rank, ID_BITS).bitwiseOR(left.cast("bigint"))

    def join(state: Column, at: Column, least: Column) -> Column:
        before, own = F.get(state, at - 2), F.shiftright(least, ID_BITS).cast("int")
        return F.concat(
            F.slice(state, F.lit(1), at - 2),
            F.array(F.when(before == start, before).otherwise(entry(id_of(before), own)), entry(own, id_of(F.get(state, at + 1)))),
            F.slice(state, at + 2, F.size(state))
        )

    def turn(state: Column, least: Column) -> Column:
        joined = _let(F.array_position(state, least).cast("int"), lambda at: join(state, at, least))
        return F.when(least < F.shiftleft(none.cast("bigint"), ID_BITS), joined).otherwise(state)

    entries = _let(ids, lambda own: F.concat(F.array(start), F.transform(own, lambda x, i: entry(x, F.get(own, i + 1)))))
    folded = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(ids) - 1, F.lit(1))), entries, lambda state, _: _let(F.array_min(state), lambda least: turn(state, least))
    )
    return _let(folded, lambda state: F.transform(F.slice(state, F.lit(2), F.size(state)), id_of))


def fold_long(ids: Column, tables: Column) -> Column:
    """The same for long words: each round joins all occurrences of the best pair, as a replacement in a string of one character per id."""
    letters = F.split(F.lit(",".join(chr(0x10000 + i) for i in range(65536))), ",")

    def run(chars: Column) -> Column:
        spell = lambda x: F.array_join(F.transform(x, lambda i: F.get(chars, i)), "")
        read = lambda s: F.transform(F.split(s, ""), lambda c: F.ascii(c) - 0x10000)

        def best(own: Column) -> Column:
            pairs = F.transform(
                F.sequence(F.lit(0), F.size(own) - 2),
                lambda i: F.struct(
                    _pair_rank(F.get(own, i), F.get(own, i + 1), tables).alias("rank"), F.get(own, i).alias("l"),
                    F.get(own, i + 1).alias("r")
                )
            )
            return F.when(F.size(own) > 1, F.array_min(F.filter(pairs, lambda p: _joins(p["rank"]))))

        def step(state: Column, pair: Column) -> Column:
            text = F.replace(
                state["s"], F.concat(F.get(chars, pair["l"]), F.get(chars, pair["r"])),
                F.get(chars, pair["rank"].cast("int"))
            )
            return F.struct(F.when(pair.isNull(), state["s"]).otherwise(text).alias("s"), pair.isNull().alias("done"))

        state = F.struct(spell(ids).alias("s"), F.lit(False).alias("done"))
        turn = lambda s, _: F.when(s["done"], s).otherwise(_let(best(read(s["s"])), lambda p: step(s, p)))
        return read(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1))), state, turn)["s"])

    return _let(letters, run)


def word_ids(word: Column, constants: Column, monotone: bool) -> Column:
    """Ids of a word."""
    ids = _byte_ids(word, constants)
    short = fold(ids, constants["tables"])
    return F.when(F.octet_length(word) > LONG, fold_long(ids, constants["tables"])).otherwise(short) if monotone else short


def words(text: Column, pattern: str) -> Column:
    """The pattern's matches in a text."""
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash, ids (packed) of rows (word, ids)."""
    for batch in batches:
        names = [
            K.span_hash(K.prefix_hash(data, fold_case=False), offsets[:-1], offsets[1:]) for _, _, data,
            offsets in K.slices(batch.column("word"))
        ]
        ids = batch.column("ids")
        packed = _lists(ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([*names, np.zeros(0, np.uint64)]).view(np.int64)), packed.cast(pa.binary())], ["hash", "ids"]
        )


def frequent_words(texts: DataFrame, ranks: Ranks, pattern: str, size: int = FREQUENT) -> K.IdTable:
    """The ids of at most ``size`` words, those found most often; each is folded once."""
    counts = texts.select(F.explode(words(F.col("text"), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = materialize(counts.where((F.col("n") > 1) & (F.octet_length("word") <= LONG)), "words")
    histogram = counts.groupBy(F.least("n", F.lit(COUNTED)).alias("n")).agg(F.count("*").alias("words")).collect()
    least, taken = COUNTED + 1, 0
    for row in sorted(histogram, key=lambda r: -r["n"]):
        taken += row["words"]
        if taken > size:
            break
        least = row["n"]
    spread = counts.where(F.col("n") >= least).select("word").repartition(
        int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    )
    folded = _let(ranks.constants(), lambda c: word_ids(F.col("word"), c, False))
    found = materialize(spread.select("word", folded.alias("ids")).mapInArrow(hashed, "hash long, ids binary"), "folded-words").toArrow()
    if not found.num_rows:
        return K.no_ids(np.int32)
    hashes = found.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    packed = found.column("ids").take(pa.array(order)).combine_chunks()
    bounds = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, packed.offset * 4).astype(np.int64)
    flat = np.frombuffer(packed.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(np.int32)
    return K.IdTable(hashes[order], (bounds - bounds[0]) // 4, flat)


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Packed ids of rows that end where told."""
    offsets = np.concatenate([[0], ends]) * 4
    return pa.Array.from_buffers(
        pa.large_binary(), len(ends),
        [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat, np.int32))]
    )


def looked_up(texts: pa.Array, known: K.IdTable, pattern: str) -> tuple[pa.Array, pa.Array]:
    """Packed ids of each text with -1, -2, ... for its words that aren't known, and those words; each distinct one once."""
    plain, plane, any_ = splitters(pattern)
    packed, rare = [], []
    for _, _, data, offsets in K.slices(texts, 1 << 18):
        raw, rows = data.tobytes(), len(offsets) - 1
        high = np.zeros(rows, np.uint8)
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        if len(full):
            high[full] = np.maximum.reduceat(data, offsets[:-1][full])
        sizes, many = [], np.zeros(rows, np.int64)
        for row in full:
            text = raw[offsets[row] : offsets[row + 1]].decode("utf-8")
            found = (plain if high[row] < 128 else plane if high[row] < 240 else any_)(text)
            many[row] = len(found)
            sizes += map(len, found)
        # Matches are counted in characters and follow each other without a gap.
        letters = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        char_ends = np.cumsum(np.array(sizes, np.int64))
        if (char_ends[-1] if len(sizes) else 0) != len(letters) - 1:
            raise ValueError("the pattern doesn't split off the whole text")
        ends = letters[char_ends]
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        place, there = known.find(K.span_hash(K.prefix_hash(data, fold_case=False), starts, ends))
        first, count = known.spans(place)
        count = np.where(there, count, 1)
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        at = np.arange(total) + np.repeat(first - (upto - count), count)
        flat = known.ids[np.minimum(at, len(known.ids) - 1)] if len(known.ids) else np.zeros(total, np.int32)
        last_word = np.cumsum(many)
        lost = np.flatnonzero(~there)
        own: list[dict[bytes, int]] = [{} for _ in range(rows)]
        owner = np.searchsorted(last_word, lost, "right")
        holes = np.empty(len(lost), np.int32)
        for k, (i, j, row) in enumerate(zip(starts[lost].tolist(), ends[lost].tolist(), owner.tolist())):
            holes[k] = -1 - own[row].setdefault(raw[i:j], len(own[row]))
        flat = flat.copy()
        flat[(upto - count)[lost]] = holes
        packed.append(_lists(flat, np.concatenate([[0], upto])[last_word]))
        rare += [[x.decode("utf-8") for x in d] for d in own]
    return pa.concat_arrays(packed) if packed else pa.array([], pa.large_binary()), pa.array(rare, pa.list_(pa.string()))


def filled(packed: pa.Array, rare: pa.ListArray) -> pa.ListArray:
    """The ids of texts, with those of the words that weren't known put in."""
    packed = packed.cast(pa.large_binary())
    bounds = np.frombuffer(packed.buffers()[1], np.int64, len(packed) + 1, packed.offset * 8) // 4
    flat = np.frombuffer(packed.buffers()[2] or b"", np.int32)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    holes = np.flatnonzero(flat < 0)
    count = np.ones(len(flat), np.int64)
    inner = rare.flatten()
    words_before = np.concatenate([[0], np.cumsum(rare.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    size = inner.value_lengths().to_numpy(zero_copy_only=False)
    begins = np.concatenate([[0], np.cumsum(size)])
    word = words_before[np.searchsorted(bounds, holes, "right") - 1] - 1 - flat[holes]
    count[holes] = size[word]
    upto = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(len(flat))
    both = np.concatenate([flat, inner.flatten().to_numpy(zero_copy_only=False).astype(np.int32)])
    first[holes] = len(flat) + begins[word]
    out = both[np.arange(upto[-1]) + np.repeat(first - upto[:-1], count)]
    return pa.ListArray.from_arrays(pa.array(upto[bounds].astype(np.int32)), pa.array(out, pa.int32()))


class Decoder:
    """Puts the binary pieces of ids together; an id outside the vocabulary has none."""

    def __init__(self, ranks: Ranks):
        self.pieces = [*ranks.tokens, b""]

    def __call__(self, ids: np.ndarray) -> bytes:
        outside = len(self.pieces) - 1
        return b"".join(map(self.pieces.__getitem__, np.where((ids < 0) | (ids > outside), outside, ids).tolist()))


def mapped(
    docs: DataFrame, ranks: Ranks, pattern: str, function: Callable[[pa.ListArray], list[pa.Array]], schema: str,
    size: int = FREQUENT, keep: tuple[str, ...] | None = None
) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all, unless told) with what ``function`` makes of the texts' ids, where they are: columns of ``schema``."""
    known = docs.sparkSession.sparkContext.broadcast(frequent_words(docs.select("text"), ranks, pattern, size))
    names = [x.split()[0] for x in schema.split(", ")]
    columns = [c for c in (docs.columns if keep is None else keep) if c not in names]
    rows = K.small_batches(docs).select(F.struct(*columns).alias("row"), F.col("text").alias("text"))
    row = rows.schema["row"].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.drop_resident()
        for batch in batches:
            packed, rare = looked_up(batch.column("text"), known.value, pattern)
            yield pa.RecordBatch.from_arrays([batch.column("row"), packed.cast(pa.binary()), rare], ["row", "packed", "rare"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *function(filled(batch.column("packed"), batch.column("rare")))], ["row", *names]
            )

    open_ = rows.mapInArrow(look_up, f"row {row}, packed binary, rare array<string>")
    folded = _let(
        ranks.constants(),
        lambda c: F.transform("rare", lambda w: word_ids(w, c, ranks.monotone))
    )
    none = F.array().cast("array<array<int>>")
    whole = open_.select(
        "row", "packed", F.when(F.size("rare") > 0, folded).otherwise(none).alias("rare")
    ).mapInArrow(fill, f"row {row}, {schema}")
    return whole.select(*(F.col("row")[c].alias(c) for c in columns), *names)


def encoded(docs: DataFrame, ranks: Ranks, pattern: str, size: int = FREQUENT, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all, unless told) with ids, the ids of the whole text."""
    return mapped(docs, ranks, pattern, lambda ids: [ids], "ids array<int>", size, keep)


def decoded(ids: Column, ranks: Ranks) -> Column:
    """Bytes of ids: the tokens' binary pieces one after the other. A byte stands for the character of its number while pieces are joined."""
    pieces = F.split(F.lit(PIECE_END.join(t.decode("iso-8859-1") for t in ranks.tokens)), PIECE_END)
    joined = _let(pieces, lambda p: F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(p, i), F.lit(""))), ""))
    return F.encode(joined, "iso-8859-1")
