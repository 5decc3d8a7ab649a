"""Sharding over fixed virtual slots.

A record's virtual slot is a hash of its id, so it never changes. Bytes are summed per virtual slot, and a versioned
map assigns virtual slots to shards; rebalancing edits the map (a new version), never the slots. The map has as many
rows as there are virtual slots, whatever the corpus holds, so planning it on the driver and broadcasting it is bounded.

Defined results: a null text has no bytes and the checksum of none; null or repeated ids share a virtual slot but get
places of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Virtual slots. Fixed for the life of a dataset.
SLOTS = 8192
#: Hash parts of a virtual slot, within which places are numbered: no task sorts a whole slot.
PARTS = 4
#: Bytes that a record costs besides its text.
OVERHEAD = 16
MAP_SCHEMA = "version int, v_slot int, shard int, bytes long"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, v_slot, part."""
    raw = F.coalesce(F.encode("text", "utf-8"), F.lit(b""))
    return docs.select(
        "doc_id", (F.octet_length(raw).cast("long") + OVERHEAD).alias("size"), F.crc32(raw).alias("text_crc32"),
        F.pmod(
            F.xxhash64(F.lit(17), "doc_id"), F.lit(slots)
        ).cast("int").alias("v_slot"), F.pmod(F.xxhash64(F.lit(29), "text"), F.lit(PARTS)).cast("int").alias("part"),
    )


def slot_stats(rows: DataFrame) -> DataFrame:
    """v_slot, part, rows and bytes: combined map-side, at most slots x parts rows."""
    return rows.groupBy("v_slot", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def first_map(bytes_by_slot: dict[int, int], shards: int) -> pd.DataFrame:
    """Version 1: the heaviest slots first, each to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    rows = []
    for slot, n in sorted(bytes_by_slot.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        rows.append((1, slot, shard, n))
        heapq.heappush(heap, (load + n, shard))
    return pd.DataFrame(rows, columns=["version", "v_slot", "shard", "bytes"])


def rebalanced(current: pd.DataFrame, shards: int) -> pd.DataFrame:
    """The next version of a map: new shards take slots from those above the new mean, and no other slot moves.

    Pass the map with refreshed ``bytes`` to rebalance after growth, or more shards than it has to grow.
    """
    edited = current.copy()
    edited["version"] = int(current["version"].max()) + 1 if len(current) else 1
    mean = edited["bytes"].sum() / shards
    load = {s: 0 for s in range(shards)} | edited.groupby("shard")["bytes"].sum().to_dict()
    movable = edited.sort_values(["bytes", "v_slot"], ascending=[False, True])
    for at, slot in movable.iterrows():
        target = min(load, key=lambda s: (load[s], s))
        here, n = int(slot["shard"]), int(slot["bytes"])
        if target != here and load[here] - n >= mean * 0.999 and load[target] + n <= mean * 1.001:
            edited.at[at, "shard"] = target
            load[here] -= n
            load[target] += n
    return edited


def store_map(spark: SparkSession, slot_map: pd.DataFrame, path: str) -> None:
    """Append a version to the stored maps."""
    spark.createDataFrame(
        slot_map[[x.split()[0] for x in MAP_SCHEMA.split(", ")]], MAP_SCHEMA
    ).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One stored version, the newest unless named."""
    maps = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version).select(*(x.split()[0] for x in MAP_SCHEMA.split(", ")))


def sharded(docs: DataFrame, shards: int = 40, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every record with its shard and its gapless place there, by a map that makes shards near equal in bytes.

    Columns: doc_id, size, text_crc32, v_slot, map_version, shard, slot. With ``map_path`` the map is stored there too.
    """
    spark = docs.sparkSession
    rows = records(docs, slots)
    stats = slot_stats(rows).toPandas().sort_values(["v_slot", "part"])
    slot_map = first_map(stats.groupby("v_slot")["bytes"].sum().to_dict(), shards)
    if map_path:
        store_map(spark, slot_map, map_path)
    placed = stats.merge(slot_map[["version", "v_slot", "shard"]], on="v_slot").sort_values(["shard", "v_slot", "part"])
    placed["base"] = placed.groupby("shard")["n"].cumsum() - placed["n"]
    places = spark.createDataFrame(
        placed[["v_slot", "part", "version", "shard", "base"]], "v_slot int, part int, map_version int, shard int, base long"
    )
    order = Window.partitionBy("v_slot", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("_in", F.row_number().over(order) - 1)
        .join(F.broadcast(places), ["v_slot", "part"])
        .select("doc_id", "size", "text_crc32", "v_slot", "map_version", "shard", (F.col("base") + F.col("_in")).alias("slot"))
    )
