"""Reacting to changed inputs: leading-edge throttling, in batch and in a stream, and full recomputation of a report."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _accepted(us, gap: int, last: int | None):
    """Places of the accepted among sorted times, and the last accepted time."""
    import numpy as np

    out, at = [], 0 if last is None else int(np.searchsorted(us, last + gap))
    while at < len(us):
        out.append(at)
        last = int(us[at])
        at = max(at + 1, int(np.searchsorted(us, last + gap)))
    return out, last


def throttle(events: DataFrame, keys: list[str], ts: str, seconds: float) -> DataFrame:
    """Of each key's events those accepted: the first, and each that comes so long after the last accepted one.

    One pass over each key's sorted times, in microseconds, that holds a batch at a time; equal times are one event.
    """
    from collections.abc import Iterator

    gap = max(1, round(seconds * 1_000_000))
    times = events.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")).where("_us is not null")
    by = Window.partitionBy(*keys).orderBy("_us")
    ordered = times.withColumn("_first", F.row_number().over(by) == 1)

    def scan(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last = None
        for b in batches:
            us = b.column(b.schema.get_field_index("_us")).to_numpy()
            first = b.column(b.schema.get_field_index("_first")).to_numpy(zero_copy_only=False)
            kept = []
            cuts = np.unique([0, *np.flatnonzero(first), len(us)]).tolist()
            for low, high in zip(cuts, cuts[1:]):
                found, last = _accepted(us[low:high], gap, None if first[low] else last)
                kept += [low + k for k in found]
            yield b.take(pa.array(kept, pa.int64()))

    return ordered.mapInArrow(scan, ordered.schema).select(*keys, F.timestamp_micros("_us").cast("timestamp_ntz").alias(ts))


def throttle_stream(events: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """The same in a stream, in order of arrival: key (string), ts of the accepted events; the state is the last of each key."""
    import pandas as pd

    gap = max(1, round(seconds * 1_000_000))

    def fold(k, frames, state):
        last = state.get[0] if state.exists else None
        out = []
        for frame in frames:
            times = frame[ts].sort_values().reset_index(drop=True)
            found, last = _accepted(times.astype("datetime64[us]").astype("int64").to_numpy(), gap, last)
            out.append(times[found])
        if last is not None:
            state.update((last,))
        kept = pd.concat(out) if out else pd.Series([], dtype="datetime64[us]")
        yield pd.DataFrame({"key": [k[0]] * len(kept), "ts": kept.to_numpy()})

    keyed = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias(ts))
    return keyed.groupBy("key").applyInPandasWithState(fold, "key string, ts timestamp", "last bigint", "append", "NoTimeout")


def with_created(modified: DataFrame, created: DataFrame) -> DataFrame:
    """Events of created files always count and leave the throttle alone."""
    return modified.unionByName(created)


def alive(states: DataFrame, as_of: datetime.datetime, seconds: float = 300.0) -> DataFrame:
    """Add whether a watcher's state (status, last_update) is ready and fresh."""
    age = F.timestamp_diff("MICROSECOND", F.col("last_update").try_cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz")) / 1e6
    return states.withColumn("alive", F.coalesce((F.col("status") == "ready") & (age < seconds), F.lit(False)))


def watch(spark: SparkSession, folder: str, recompute: Callable[[DataFrame, int], None], on_state: Callable[[str], None], checkpoint: str, every: str | None = None):
    """Recompute from the latest version whenever one arrives in a folder of whole versions (``tasks_<number>.txt``).

    The file source takes a path once, so an edit in place would go unseen; a writer drops a new version instead. Each
    batch goes regenerating, then ready or error. The first batch is the folder as it is. Returns the started query.
    """

    def each(batch: DataFrame, number: int) -> None:
        latest = batch.agg(F.max_by("value", F.regexp_extract("path", r"_([0-9]+)\.txt$", 1).cast("bigint")).alias("value"))
        if batch.isEmpty():
            return
        on_state("regenerating")
        try:
            recompute(latest.select(F.posexplode(F.split("value", "\n")).alias("pos", "line")), number)
        except Exception:
            on_state("error")
            raise
        on_state("ready")

    files = spark.readStream.schema("value string").option("wholetext", True).format("text").load(folder).withColumn("path", F.input_file_name())
    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
