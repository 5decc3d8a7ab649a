"""Language identification by prediction by partial matching over bytes.

Per language a context tree of bounded order counts which byte follows which context. A byte is coded at the longest
context that has seen it; each escape on the way down costs its escape probability (method C) and the bytes seen at
the longer context are excluded. A text's exact code length under each language's frozen tree decides.

A byte is coded in two steps: its class, of ``SYMBOLS``, in its context, and then the byte within its class by its share
there. The most frequent bytes of the training sample have a class each (A-Z with a-z), all others share one. So the trees,
blended down to their roots, are rows of code lengths, one for each context of ``ORDER`` classes that the sample has, or else for
the context that is one shorter, and scoring is a few lookups per byte. Lengths are kept in steps of 1 / ``UNIT`` bit.

Training reads a bounded sample: at most about ``SAMPLE_DOCS`` documents of a language, chosen by a hash of doc_id.
Everything that is predicted is read whole.

Defined results: ``und`` with score 0 for a null or empty text and for one without any letter; ties go to the
alphabetically first language; without any training document all are ``und``; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cataloom.llm import kernels as K

ORDER = 3
BITS = 6
SYMBOLS = 1 << BITS
#: Bound of the training sample, per language, in documents.
SAMPLE_DOCS = 600
#: Steps of a bit in which code lengths are kept.
UNIT = 1024
#: Languages whose tables a worker keeps at once (some 5 MB each), and bytes of text that it scores together if there are more.
KEPT_TABLES = 24
RUN_BYTES = 32 << 20
#: Documents with a lower score are rejected.
LEAST_SCORE = 0.5


def is_held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """lang, text of a bounded sample, in each language, of labelled documents that aren't held out; empty texts don't count."""
    labelled = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & ~F.coalesce(is_held_out(), F.lit(True))
    ).select("doc_id", "lang", "text")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("size"))
    share = F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("size"))
    chosen = F.pmod(F.xxhash64(F.lit(41), "doc_id"), F.lit(1 << 20)) < F.floor(share * F.lit(1 << 20))
    return labelled.join(F.broadcast(sizes), "lang").where(chosen).select("lang", "text")


def byte_counts(sample: DataFrame) -> pd.DataFrame:
    """lang, byte, n: how often each byte occurs in the sample; 256 rows a language at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in _by_language(batch):
                for _, _, data, _ in K.slices(part):
                    total[lang] = total.get(lang, 0) + np.bincount(data, minlength=256)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], ["lang", "byte", "n"]
            )

    return sample.mapInArrow(count, "lang string, byte int, n long").groupBy("lang", "byte").agg(F.sum("n").alias("n")).toPandas()


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    langs = batch.column("lang").to_pandas().to_numpy()
    for lang in np.unique(langs.astype(str)):
        yield lang, batch.column("text").filter(pa.array(langs == lang))


def symbol_classes(counts: pd.DataFrame) -> np.ndarray:
    """Class of each byte; class 0 holds the rare ones."""
    total = np.zeros(256, np.int64)
    np.add.at(total, K.LOWER[counts["byte"].to_numpy(np.int64)], counts["n"].to_numpy(np.int64))
    top = np.lexsort((np.arange(256), -total))[: min(SYMBOLS - 1, int((total > 0).sum()))]
    classes = np.zeros(256, np.uint8)
    classes[top] = np.arange(1, len(top) + 1)
    return classes[K.LOWER]


def byte_lengths(counts: pd.DataFrame, classes: np.ndarray, languages: list[str]) -> np.ndarray:
    """[byte, language] length of a byte within its class, in steps: its share of the class's bytes, half a count more each."""
    out = np.zeros((256, len(languages)), np.int32)
    for j, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        n = np.full(256, 0.5)
        n[own["byte"].to_numpy(np.int64)] += own["n"].to_numpy()
        out[:, j] = np.round(-UNIT * np.log2(n / np.bincount(classes, weights=n, minlength=SYMBOLS)[classes]))
    return out


def codes(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, the classes of it and of the ``order`` bytes before it in its text (class 0 before the start)."""
    symbol = classes[data].astype(np.int32)
    out = symbol.copy()
    for k in range(1, order + 1):
        out[k:] |= symbol[:-k] << (BITS * k)
    for k in range(order):  # the first bytes of each text don't see the text before
        at = offsets[:-1] + k
        at = at[at < offsets[1:]]
        out[at] &= (1 << (BITS * (k + 1))) - 1
    return out


def context_counts(sample: DataFrame, classes: np.ndarray) -> pd.DataFrame:
    """lang, code, n: counts of the longest contexts with their next symbol, summed by Spark; the sample bounds them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, part in _by_language(batch):
                found = [codes(d, o, classes) for _, _, d, o in K.slices(part)]
                code, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(code), pa.string()), pa.array(code, pa.int32()), pa.array(n, pa.int64())],
                    ["lang", "code", "n"]
                )

    return sample.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()


def _blended(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """[context, symbol] probabilities from counts and those of the contexts that are one symbol shorter: escape C and exclusion."""
    seen = counts > 0
    total, kinds = counts.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    unseen = np.where(seen, 0, shorter)
    escape = np.where(total == 0, 1, np.where(kinds == SYMBOLS, 0, kinds / np.maximum(total + kinds, 1)))
    return np.where(seen, counts / np.maximum(total, 1) * (1 - escape), escape * unseen / np.maximum(unseen.sum(1, keepdims=True), 1e-30))


def code_lengths(code: np.ndarray, n: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(row of each longest context, [row, symbol] steps of 1 / UNIT bit) from the counts of one language.

    A context that the sample doesn't have is coded as the one that is a symbol shorter, so it shares that one's row.
    """
    below = np.full((1, SYMBOLS), 1.0 / SYMBOLS)
    for k in range(order):
        counts = np.bincount(code & ((1 << (BITS * (k + 1))) - 1), weights=n, minlength=1 << (BITS * (k + 1))).reshape(-1, SYMBOLS)
        below = _blended(counts, np.tile(below, (len(counts) // len(below), 1)))
    context, where = np.unique(code >> BITS, return_inverse=True)
    counts = np.bincount(where * SYMBOLS + (code & (SYMBOLS - 1)), weights=n, minlength=len(context) * SYMBOLS).reshape(-1, SYMBOLS)
    whole = np.concatenate([below, _blended(counts, below[context & (len(below) - 1)])])
    row = np.arange(1 << (BITS * order), dtype=np.int32) & np.int32(len(below) - 1)
    row[context] = len(below) + np.arange(len(context))
    return row, np.minimum(np.round(-UNIT * np.log2(np.maximum(whole, 1e-30))), 65535).astype(np.uint16)


class Model:
    """Frozen statistics: a few MB of counts, which each worker turns into its table once."""

    def __init__(self, classes: np.ndarray, counts: pd.DataFrame, bytes_: pd.DataFrame):
        self.classes = classes
        self.languages = sorted(counts["lang"].unique())
        self.counts = [
            (g["code"].to_numpy(np.int32), g["n"].to_numpy(np.float64)) for _,
            g in counts.sort_values(["lang", "code"]).groupby("lang")
        ]
        self.within = byte_lengths(bytes_, classes, self.languages)
        self.key = uuid.uuid4().hex

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The tables of all languages; kept for the tasks that the same worker runs next."""
        return K.resident(self.key, lambda: [code_lengths(*x) for x in self.counts])

    def sums(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """[text, language] bits of the texts of each part that aren't empty; more than KEPT_TABLES languages come one after the other."""

        def bits(
            table: tuple[np.ndarray, np.ndarray], within: np.ndarray, context: np.ndarray, symbol: np.ndarray, data: np.ndarray,
            starts: np.ndarray
        ) -> np.ndarray:
            row, steps = table
            return np.add.reduceat(steps.ravel()[(row[context] << BITS) | symbol] + within[data], starts, dtype=np.int64) / UNIT

        coded = ((codes(data, offsets, self.classes), data, offsets[:-1][offsets[1:] > offsets[:-1]]) for data, offsets in parts)
        ready = [(code >> BITS, code & (SYMBOLS - 1), data, starts) for code, data, starts in coded]
        out = [[] for _ in parts]
        kept = len(self.counts) <= KEPT_TABLES
        if not kept:
            K.drop_resident()
        for j in range(len(self.counts)):
            table = self.tables()[j] if kept else code_lengths(*self.counts[j])
            for columns, part in zip(out, ready):
                columns.append(bits(table, self.within[:, j], *part))
        return [np.column_stack(columns) for columns in out]


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of at least so many bytes."""
    run, size = [], 0
    for batch in batches:
        run.append(batch)
        size += batch.nbytes
        if size >= least:
            yield run
            run, size = [], 0
    if run:
        yield run


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from the labelled documents that aren't held out."""
    sample = training_sample(docs, sample_docs)
    found = byte_counts(sample)
    classes = symbol_classes(found)
    return Model(classes, context_counts(sample, classes), found)


def _has_letter(data: np.ndarray, raw: bytes) -> bool:
    low = data | 32
    if ((low >= 97) & (low <= 122)).any():
        return True
    return any(c.isalpha() for c in raw.decode("utf-8", "ignore"))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every document with lang_pred, score and bits_per_byte; only the text is looked at.

    The score is the posterior of the best language with code lengths per byte scaled to 64 bytes, so that it
    doesn't saturate with the length of a text; a shorter text counts as long as it is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        languages = np.array([*model.languages, "und"], object)
        for run in _runs(batches, RUN_BYTES if len(model.languages) > KEPT_TABLES else 0):
            parts = [
                (b, at, data, offsets) for b, batch in enumerate(run) for at, _, data,
                offsets in K.slices(batch.column("text")) if len(data)
            ] if model.languages else []
            found = [(np.full(x.num_rows, len(languages) - 1), np.zeros(x.num_rows), np.zeros(x.num_rows)) for x in run]
            for (b, at, data, offsets), sums in zip(parts, model.sums([x[2:] for x in parts])):
                best, sure, bits = found[b]
                full = np.flatnonzero(offsets[1:] > offsets[:-1])
                size = (offsets[1:] - offsets[:-1])[full]
                winner = sums.argmin(1)
                low = sums[np.arange(len(full)), winner]
                scale = np.minimum(size, 64) / size
                share = 1 / np.exp2(np.maximum((low[:, None] - sums) * scale[:, None], -1000)).sum(1)
                for i, row in enumerate(full):
                    span = data[offsets[row] : offsets[row + 1]]
                    if _has_letter(span, span.tobytes() if len(span) < 4096 else b"") or (
                        len(span) >= 4096 and _has_letter(span, span.tobytes())
                    ):
                        best[at + row], sure[at + row], bits[at + row] = winner[i], share[i], low[i] / size[i]
            for batch, (best, sure, bits) in zip(run, found):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.array(languages[best], pa.string()), pa.array(sure), pa.array(bits)],
                    [*keep, "lang_pred", "score", "bits_per_byte"],
                )

    whole = K.small_batches(docs).select(*keep, *(() if "text" in keep else ("text",)))
    schema = T.StructType(
        [
            *(whole.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
            T.StructField("bits_per_byte", T.DoubleType())
        ]
    )
    return whole.mapInArrow(score, schema)


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte: fit on the labelled part, then predict every document."""
    out = predict(docs, fit(docs, sample_docs))
    return out.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def accepted(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The documents whose language is known with a score of LEAST_SCORE or more, with lang set to it. Columns named like the prediction's are kept as they are."""
    out = predict(docs.select(F.struct("*").alias("row"), "text"), fit(docs, sample_docs), ("row",))
    known = out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return known.select(*(F.col("lang_pred" if c == "lang" else f"row.{c}").alias(c) for c in docs.columns))
