"""Checks and summaries over tables of answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cataloom.sources import versions

# Words that an unfinished sentence ends on.
DANGLING = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "with", "by", "for", "is", "are", "from", "as", "that", "this",
    "these", "those", "its", "their"
)
CLOSING = ".!?)]}\"'|"


def first_phrase(text: Column, phrases: Sequence[str]) -> Column:
    """The first listed phrase that a text holds, in any case."""
    hits = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(text), F.lower(p)))
    return F.try_element_at(hits, F.lit(1))


def mentioned(text: Column, names: Sequence[str]) -> Column:
    """The listed names that a text holds, in any case."""
    return F.filter(F.array(*map(F.lit, names)), lambda p: F.contains(F.lower(text), F.lower(p)))


def truncation(text: Column) -> Column:
    """``empty``, ``dangling`` (ends on a connecting word), ``open`` (no closing mark), or null for a normal end. Marks of emphasis at the end don't count."""
    stripped = F.regexp_replace(text, r"(?U)\s+$", "")
    bare = F.regexp_replace(stripped, r"[*_`]+$", "")
    core = F.when(bare == "", stripped).otherwise(bare)
    last = F.lower(F.try_element_at(F.regexp_extract_all(core, F.lit(r"[A-Za-z']+"), F.lit(0)), F.lit(-1)))
    return F.when(F.coalesce(stripped, F.lit("")) == "", "empty").when(last.isin(*DANGLING), "dangling").when(
        F.instr(F.lit(CLOSING), F.substring(core, -1, 1)) == 0, "open"
    )


def latest(results: DataFrame, key: str = "number", at: str = "run_ts") -> DataFrame:
    """The newest run of each key."""
    return results.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("_r = 1").drop("_r")


def upserted(run: DataFrame, place: str, key: str = "number", at: str = "run_ts") -> DataFrame:
    """The stored results with those of a run, the newest of each key: written as the store's next version, so a run that fails leaves the results before it."""
    spark = run.sparkSession
    before = versions.current(spark, place)
    every = run if before is None else before.rows(spark).select(run.columns).unionByName(run)
    return versions.publish(latest(every, key, at), place).rows(spark)


def stored(spark: SparkSession, place: str) -> DataFrame | None:
    """The results stored at a place, if there are any."""
    found = versions.current(spark, place)
    return found.rows(spark) if found else None


def missing_numbers(results: DataFrame, key: str = "number", pieces: int = 64) -> DataFrame:
    """Keys between the smallest and the largest one that have no result.

    Gaps are found between neighbours, which are looked up within pieces of the range of keys, so sparse keys cost no more than what is missing.
    """
    spark = results.sparkSession
    low, high = results.agg(F.min(key), F.max(key)).first()
    if low is None:
        return results.select(key).where("false")
    width = (high - low) // pieces + 1
    ends = spark.range(pieces).select((F.lit(low) + F.col("id") * width).alias("a")).where(F.col("a") <= high)
    # The first key of each piece is there, missing or not, so that no gap reaches over a piece's end.
    marked = results.select(F.col(key).cast("long").alias("a"), F.lit(True).alias("there")).distinct()
    marked = marked.unionByName(ends.withColumn("there", F.lit(False))).groupBy("a").agg(F.bool_or("there").alias("there"))
    piece = F.floor((F.col("a") - low) / width)
    after = F.lead("a").over(Window.partitionBy(piece).orderBy("a"))
    end = F.coalesce(after, F.least(F.lit(low) + (piece + 1) * width, F.lit(high + 1)))
    begin = F.when(F.col("there"), F.col("a") + 1).otherwise(F.col("a"))
    spans = marked.select(begin.alias("a"), (end - 1).alias("b")).where("a <= b")
    # Long gaps are cut, so that no row makes more than a million.
    cut = spans.select("a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("b") - F.col("a")) / (1 << 20)))).alias("n"))
    start = F.col("a") + F.col("n") * (1 << 20)
    found = cut.select(F.explode(F.sequence(start, F.least("b", start + ((1 << 20) - 1)))).alias(key))
    return found.select(F.col(key).cast(results.schema[key].dataType).alias(key))


def verdicts(results: DataFrame, checks: Sequence[Column]) -> DataFrame:
    """passed: all checks hold, or null for manual questions."""
    return results.withColumn("passed", F.when(~F.col("manual"), F.forall(F.array(*checks), lambda x: F.coalesce(x, F.lit(False)))))


def category_summary(judged: DataFrame) -> DataFrame:
    """Per category and overall (category null): passed, failed, manual, total."""
    return judged.rollup("category").agg(
        F.count_if(F.col("passed")).alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.count_if("manual").alias("manual"), F.count("*").alias("total")
    )


def timing_table(timings: DataFrame, stages: Sequence[str], derived: tuple[str, str, str] | None = None) -> DataFrame:
    """number, one column per stage, total. ``derived`` = (name, a, b): a + b where both exist."""
    wide = timings.groupBy("number").pivot("stage", list(stages)).agg(F.round(F.sum("seconds"), 6))
    if derived:
        name, a, b = derived
        wide = wide.withColumn(name, F.round(F.col(a) + F.col(b), 6))
    total = sum((F.coalesce(s, F.lit(0.0)) for s in stages[1:]), F.coalesce(stages[0], F.lit(0.0)))
    return wide.withColumn("total", F.round(total, 6))


def has_item(context: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """question_id, found: does any context item's metadata have all wanted values?"""
    hit = F.lit(True)
    for k, v in wanted.items():
        hit = hit & F.coalesce(F.col("metadata")[k] == v, F.lit(False))
    return context.groupBy("question_id").agg(F.bool_or(hit).alias("found"))
