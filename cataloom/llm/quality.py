"""Quality rules whose cutoffs are certified on labelled documents.

Counts of each text give a few ratios (rules). For every stratum and rule the labelled good documents form a holdout:
going from the loosest cutoff of a fixed grid to stricter ones, a cutoff is certified while the exact binomial
(Clopper-Pearson) upper bound of its false-rejection rate stays at most ``ALPHA`` divided by the number of rules; the
walk stops at the first failure, so the grid itself needs no correction, and the error level ``DELTA`` is divided by the
number of strata x rules (Bonferroni). All in all: with probability 1 - DELTA, no stratum loses more than ALPHA of its
good documents. Among the certified cutoffs of a rule the one is taken that rejects most labelled bad documents beyond
``GOOD_WEIGHT`` times the good ones; on a tie the loosest. A stratum with too few labels to certify anything rejects nothing.

Strata are bands of length in words. Every labelled document counts; the labels enter as sums per stratum, rule and grid
step, so what reaches the driver has a fixed size.

Defined results: a null or empty text has zero counts and fails the base rule; repeated rows get one row each; a document
labelled more than once counts with its lowest quality; labels of unknown documents are ignored; empty tables work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.llm import kernels as K
from cataloom.sources.shared import materialize

ALPHA = 0.05
DELTA = 0.05
GOOD_WEIGHT = 2.0
WINDOW = 8
BANDS = (200, 1000)
GRID = 200
SYMBOL_SET = np.zeros(256, np.uint8)
SYMBOL_SET[[ord(c) for c in "#*$%&|<>"]] = 1
COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
#: Rules by name: a ratio from 0 to 1 of which large values are bad.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of a run of texts."""
    rows = len(offsets) - 1
    starts, ends, first = K.word_spans(data, offsets)
    owner = np.repeat(np.arange(rows), np.diff(first))

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    inside = ~K.SPACE[data]
    raw = K.prefix_hash(data, fold_case=False)
    # Lines with a word: their ends are newlines and the ends of texts.
    breaks = np.flatnonzero(data == 10)
    line_ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    line_owner = np.concatenate([np.searchsorted(offsets, breaks, "right") - 1, np.arange(rows)])
    line_owner = line_owner[np.argsort(np.concatenate([breaks, offsets[1:]]), kind="stable")]
    line_starts = np.maximum(
        np.concatenate(
            [
                [0],
                line_ends[:-1] + (line_ends[:-1] < len(data)) * (
                    data[np.minimum(line_ends[:-1], max(len(data) - 1, 0))] == 10 if len(data) else 0
                )
            ]
        ),
        offsets[line_owner]
    ) if len(line_ends) else line_ends
    words_before = np.searchsorted(starts, np.concatenate([line_starts, line_ends]), "left")
    has_word = words_before[len(line_starts) :] > words_before[: len(line_starts)]
    line_starts, line_ends, line_owner = line_starts[has_word], line_ends[has_word], line_owner[has_word]
    keys = K.span_hash(raw, line_starts, line_ends) ^ K.mix(line_owner.astype(np.uint64) + K.U(1))
    _, at = np.unique(keys, return_index=True)
    n_lines = np.bincount(line_owner, minlength=rows)
    # Words in windows that the same text has twice.
    covered = np.zeros(len(starts), bool)
    if len(starts) >= WINDOW:
        windows = K.window_hash(K.span_hash(raw, starts, ends), WINDOW)
        valid = np.flatnonzero(owner[: len(windows)] == owner[WINDOW - 1 :])
        _, back, n = np.unique(windows[valid] ^ K.mix(owner[valid].astype(np.uint64) + K.U(1)), return_inverse=True, return_counts=True)
        twice = valid[n[back] > 1]
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, twice, 1)
        np.add.at(change, twice + WINDOW, -1)
        covered = np.cumsum(change[:-1]) > 0
    return {
        "n_words": np.diff(first), "word_chars": per_row(inside & ((data & 0xC0) != 0x80)), "n_symbols": per_row(SYMBOL_SET[data]), "n_lines": n_lines,
        "n_dup_lines": n_lines - np.bincount(line_owner[at], minlength=rows), "n_repeat_words": np.bincount(owner[covered], minlength=rows),
    }


def counted(docs: DataFrame) -> DataFrame:
    """The counts of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in COUNTS.split(", ")]
        for batch in batches:
            for at, to, data, offsets in K.slices(batch.column("text")):
                found = text_counts(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, to - at), *(pa.array(found[k].astype(np.int64)) for k in names[1:])], names
                )

    return K.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, COUNTS)


def base_failed() -> Column:
    """Too short, or mostly repeats."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def stratum() -> Column:
    """The band of length."""
    out = F.lit(len(BANDS))
    for k, top in reversed(list(enumerate(BANDS))):
        out = F.when(F.col("n_words") < top, k).otherwise(out)
    return out


def step(rule: str) -> Column:
    """Grid step of a rule's ratio: ceil(GRID x ratio), 0 to GRID; a cutoff c rejects steps above c."""
    top, bottom = RULES[rule]
    return F.least(F.ceil(F.lit(float(GRID)) * F.col(top) / F.greatest(F.col(bottom), F.lit(1))), F.lit(GRID)).cast("int")


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    tiny, above, below = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    value = below
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            below, above = 1 / (1 + term * below or tiny), 1 + term / above or tiny
            value *= below * above
        if abs(below * above - 1) < 1e-15:
            break
    logs = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(logs) * value / a


def upper_bound(k: int, n: int, error: float) -> float:
    """Clopper-Pearson: the largest rate under which at most k of n has probability ``error`` or more."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_share(n - k, k + 1, 1 - mid) > error else (low, mid)
    return high


def certified_cutoffs(good: np.ndarray, bad: np.ndarray, alpha: float, error: float, good_weight: float = GOOD_WEIGHT) -> int:
    """Cutoff step from the good and bad documents per grid step; GRID rejects nothing."""
    n, best, best_gain = int(good.sum()), len(good) - 1, 0.0
    for cut in range(len(good) - 2, -1, -1):
        lost = int(good[cut + 1 :].sum())
        if lost / max(n, 1) > alpha or upper_bound(lost, n, error) > alpha:
            break
        gain = float(bad[cut + 1 :].sum()) - good_weight * lost
        if gain > best_gain:
            best, best_gain = cut, gain
    return best


def cutoffs(counts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[int, str], int]:
    """Certified cutoff of each stratum and rule."""
    quality = labels.where(
        F.col("doc_id").isNotNull() & F.col("quality").isNotNull()
    ).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = counts.where(~base_failed()).join(quality, "doc_id")
    long = held.select(
        stratum().alias("stratum"), (F.col("quality") > 0).alias("good"),
        F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), step(r).alias("step")) for r in RULES))).alias("x")
    )
    sums = long.groupBy("stratum", "x.rule", "x.step", "good").count().collect()  # strata x rules x grid x 2 rows at most
    strata = len(BANDS) + 1
    table = {(s, r): np.zeros((2, GRID + 1), np.int64) for s in range(strata) for r in RULES}
    for row in sums:
        table[row["stratum"], row["rule"]][int(row["good"]), row["step"]] += row["count"]
    tests = strata * len(RULES)
    return {key: certified_cutoffs(x[1], x[0], alpha / len(RULES), delta / tests) for key, x in table.items()}


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Every document with its counts, base_failed, rejected_by (the rules that reject it) and kept."""
    counts = materialize(counted(docs), "text-counts")
    chosen = cutoffs(counts, labels, alpha, delta)

    def cutoff(rule: str) -> Column:
        out = F.lit(GRID)
        for s in range(len(BANDS) + 1):
            out = F.when(stratum() == s, chosen[s, rule]).otherwise(out)
        return out

    rejected = F.filter(F.array(*(F.when(step(r) > cutoff(r), F.lit(r)) for r in RULES)), lambda x: x.isNotNull())
    return counts.withColumn("base_failed", base_failed()).withColumn("rejected_by", rejected).withColumn(
        "kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)
    )
