"""Admission of requests under a rolling limit, over a stored log or a stream.

A request is admitted if fewer than ``limit`` admitted ones of its key lie in the window before it (one exactly a window old
still counts); rejected ones, and those without a time, use nothing up. What is known of a key at any time is the times of its last admitted requests, ``limit`` at most.

A log is dealt in ranges of (key, time), so a key with many requests has many ranges. Each range is run at once from a guess, that nothing is held where it
begins; where a key goes on from the range before and that one ends with something held that still counts, the range is run again from there. Runs from different
beginnings soon admit the same requests, so the guesses seldom fail for long; if they do, ranges are chained one by one, so that no work is done twice.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cataloom.sources.shared import materialize

OUTPUT = "event_id long, key string, ts timestamp, admitted boolean"
#: Rounds in which all ranges with a wrong guess are run again; from then on only those whose beginning is sure.
GUESSES = 4


def _decide(times: list, held: deque, limit: int, window: int) -> list[bool]:
    out = []
    for t in times:
        if t is None:
            out.append(False)
            continue
        while held and t - held[0] > window:
            held.popleft()
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int]]:
    """(key, first row, row after the last) of the runs of equal keys."""
    keys = batch.column("key").to_pylist()
    begin = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[begin]:
            yield keys[begin], begin, i
            begin = i


def _replayed(starts: dict[int, list[int]], limit: int, window: int, ends_only: bool):
    """Runs of the requests of some ranges (part, key, t, event_id, in order). ``starts``: what a range's first key holds as it begins.

    Gives decisions, or what each range holds of its first and its last key at their ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, held, at = None, None, deque(), None
        ends: list[tuple] = []

        def close() -> None:
            if part is not None:
                ends.append((part, key, first, at, list(held)))

        first = True
        for batch in batches:
            flags: list[bool] = []
            times, parts = batch.column("t").to_pylist(), batch.column("part").to_pylist()
            for name, begin, end in _runs(batch):
                while begin < end:
                    stop = end if parts[begin] == parts[end - 1] else next(i for i in range(begin, end) if parts[i] != parts[begin])
                    if (parts[begin], name) != (part, key):
                        close()
                        first = parts[begin] != part
                        part, key, held = parts[begin], name, deque(starts.get(parts[begin], []) if first else [])
                        at = None
                    flags += _decide(times[begin:stop], held, limit, window)
                    at = next((t for t in times[begin:stop] if t is not None), None) if at is None else at
                    begin = stop
            if not ends_only:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("event_id", "key", "ts")), pa.array(flags, pa.bool_())], ["event_id", "key", "ts", "admitted"])
        close()
        if ends_only:
            # Of a range only its first and its last key can go on elsewhere.
            last = {row[0]: i for i, row in enumerate(ends)}
            rows = [row for i, row in enumerate(ends) if row[2] or last[row[0]] == i]
            kinds = (pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], ["part", "key", "is_first", "t0", "held"])

    return run


def admitted(log: DataFrame, limit: int, window_seconds: int = 3600) -> DataFrame:
    """event_id, key, ts, admitted of a whole log (event_id, key, ts); ties by event_id. Requests without a key are those of one key.

    To the driver come what at most two keys of each range hold, ``limit`` times each.
    """
    window = window_seconds * 1_000_000
    timed = log.select("event_id", F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    ordered = timed.withColumn("t", F.unix_micros("ts"))
    ordered = ordered.repartitionByRange("key", "t", "event_id").sortWithinPartitions("key", "t", "event_id")
    ranges = materialize(ordered.withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)), "request-ranges")
    schema = "part long, key string, is_first boolean, t0 long, held array<long>"

    def ends(parts: list[int] | None, starts: dict[int, list[int]]) -> list:
        rows = ranges if parts is None else ranges.where(F.col("part").isin(parts))
        # A file holds one range; reading may deal a long one to several tasks, so it is put together again.
        whole = rows.select("part", "key", "t", "event_id").repartition("part").sortWithinPartitions("part", "key", "t", "event_id")
        return whole.mapInArrow(_replayed(starts, limit, window, True), schema).collect()

    known = ends(None, {})
    parts = sorted({r["part"] for r in known})
    first, last = {r["part"]: r for r in known if r["is_first"]}, {}
    for r in known:
        if r["part"] not in last or not r["is_first"]:
            last[r["part"]] = r
    starts: dict[int, list[int]] = {}
    rounds = 0
    while True:
        wrong: dict[int, list[int]] = {}
        chained = set()
        for before, part in zip(parts, parts[1:]):
            key, t0 = first[part]["key"], first[part]["t0"]
            held = last[before]["held"] if last[before]["key"] == key else []
            due = [t for t in held if t0 is None or t0 - t <= window]
            if due != starts.get(part, []) and not (rounds >= GUESSES and key in chained):
                wrong[part] = due
                chained.add(key)
        if not wrong:
            break
        for r in ends(list(wrong), wrong):
            if r["is_first"]:
                if last[r["part"]]["key"] == r["key"]:
                    last[r["part"]] = r
                first[r["part"]] = r
        starts |= wrong
        rounds += 1
    rows = ranges.repartition("part").sortWithinPartitions("part", "key", "t", "event_id")
    return rows.mapInArrow(_replayed({p: s for p, s in starts.items() if s}, limit, window, False), OUTPUT)


def admitted_stream(events: DataFrame, limit: int, window_seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """The same over a stream: state is the admitted times of a key. Within a batch events go in time order; later than the watermark they go in order of arrival.

    A task holds a key's events of one micro-batch, so the source's limit a trigger bounds what it holds.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0] if state.exists else [])
        whole = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        times = whole["ts"].astype("datetime64[us]").astype("int64").tolist()
        flags = _decide(times, held, limit, window_seconds * 1_000_000)
        state.update((list(held),))
        yield whole[["event_id", "key", "ts"]].assign(admitted=flags)

    keyed = events.select("event_id", F.col("key").cast("string").alias("key"), "ts").withWatermark("ts", late)
    return keyed.groupBy("key").applyInPandasWithState(step, OUTPUT, "times array<long>", "append", GroupStateTimeout.NoTimeout)
