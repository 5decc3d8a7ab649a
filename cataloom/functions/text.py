"""Column functions on names and sentences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = r"(?U)[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[^\w\s]"


def estimated_tokens(text: Column) -> Column:
    """Pieces of a text: camelCase words, capital runs, digit runs and single marks."""
    return F.regexp_count(text, F.lit(PIECES)).cast("long")


def short(text: Column, limit: int) -> Column:
    """First sentence, cut at a word's end if it is longer than ``limit`` characters; trailing ``,;:`` go and an ellipsis comes."""
    first = F.get(F.split(F.trim(text), r"(?<=[.!?])\s", 2), F.lit(0))
    cut = F.substring(first, 1, limit)
    whole_words = F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(first) <= limit, first).otherwise(F.concat(F.regexp_replace(whole_words, r"[,;:]+$", ""), F.lit("…")))


def humanized(word: Column) -> Column:
    """camelCase as lower-case words."""
    return F.lower(F.trim(F.regexp_replace(word, r"(?<!^)(?=[A-Z])", " ")))


def self_qualifier(attribute: Column, target: Column) -> Column:
    """What is left of an attribute name in front of its target's name."""
    stripped = F.when(
        (target != "") & F.endswith(attribute, target), F.substring(attribute, F.lit(1), F.length(attribute) - F.length(target))
    ).otherwise(attribute)
    return F.when(humanized(stripped) != "", humanized(stripped)).otherwise(humanized(attribute))


def article(word: Column) -> Column:
    return F.when(F.lower(F.substring(word, 1, 1)).isin(*"aeiou"), "an").otherwise("a")


def listed(items: Column, last: str) -> Column:
    """``x, y or z``."""
    return F.when(F.size(items) == 1, F.element_at(items, 1)).otherwise(
        F.concat(F.array_join(F.slice(items, F.lit(1), F.size(items) - 1), ", "), F.lit(f" {last} "), F.element_at(items, -1))
    )


def representative(names: Column, limit: int) -> Column:
    """The first names that aren't ``*Base`` or ``*_display``; all kinds if there are no others."""
    useful = F.filter(names, lambda n: ~(F.endswith(n, F.lit("Base")) | F.endswith(n, F.lit("_display"))))
    return F.slice(F.when(F.size(useful) > 0, useful).otherwise(names), 1, limit)


def model_tokens(text: Column, tokenizer: str, batch: int = 256) -> Column:
    """Tokens of a text by a tokenizer's file, without special tokens; null for a null text. The tokenizer works on whole texts, ``batch`` at a time."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.no_truncation()
        for texts in series:
            known = texts[texts.notna()]
            counts = []
            for i in range(0, len(known), batch):
                counts += map(len, model.encode_batch(known.iloc[i : i + batch].tolist(), add_special_tokens=False))
            yield pd.Series(counts, known.index, "Int64").reindex(texts.index)

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "long")(text)


def over_length(rows: DataFrame, limit: int, count: Callable[[Column], Column] = estimated_tokens, text: str = "text") -> DataFrame:
    """Rows whose text is longer than a model takes, with n_tokens: reported instead of cut in silence. ``count`` is the estimate, or a tokenizer's own count."""
    return rows.withColumn("n_tokens", count(F.col(text))).where(F.col("n_tokens") > limit)
