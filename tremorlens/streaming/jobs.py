"""Streaming operators.

Keyed Python state sees one row per key and Arrow batch: a stateless combiner runs
first inside each partition, so a source that sends a third of all rows costs its
state task a few rows per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tremorlens.operators.consensus import JUMP_CEILING


def daily_counts(events: DataFrame, ts: str, keys: list[str], late: str = "2 days") -> DataFrame:
    """Counts per closed day; rows later than the watermark no longer change a day."""
    day = F.window(ts, "1 day")
    counted = events.withWatermark(ts, late).groupBy(day, *keys).agg(F.count("*").alias("n"))
    return counted.select(F.to_date("window.start").alias("day"), *keys, "n")


def suppress_repeats(events: DataFrame, ts: str, keys: list[str], horizon: str = "7 days") -> DataFrame:
    """The first of each key within the horizon."""
    return events.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


def _combiner(reduce: Callable, schema: str, df: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        for frame in batches:
            if len(frame):
                yield reduce(frame)

    return df.mapInPandas(run, schema)


def running_maximum(captures: DataFrame, ceiling: int = JUMP_CEILING) -> DataFrame:
    """Provisional consolidated figure per (event_key, metric).

    ``captures``: event_key, metric, day (text), rank (text, lower is better), value,
    outlet.  Emits each accepted change.  All captures of a key in a trigger are folded together by day
    and rank, however many frames they come in: what is held of them is the best rank of each
    (day, value).  A capture of a day before the current one of an earlier trigger is too late and changes
    nothing, and a day that has its value keeps it.  The daily batch series is the reference.
    """
    import pandas as pd

    keys = ["event_key", "metric"]
    columns = [*keys, "day", "rank", "value", "outlet"]
    schema = "event_key string, metric string, day string, rank string, value bigint, outlet string"

    def best_rank_per_value(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.sort_values(["rank", "outlet"]).drop_duplicates([*keys, "day", "value"])[columns]

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, base, current, taken = state.get if state.exists else (None, None, "", False)
        best: dict[tuple, tuple] = {}
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.day >= current:
                    place, found = (row.day, int(row.value)), (row.rank, row.outlet is not None, row.outlet or "")
                    if place not in best or found < best[place]:
                        best[place] = found
        out = []
        for (day, seen), (_, named, outlet) in sorted(best.items(), key=lambda kv: (kv[0][0], *kv[1], kv[0][1])):
            if day != current:
                base, current, taken = value, day, False
            if taken or (base is not None and (seen <= base or (base > 0 and seen > base * ceiling))):
                continue
            value, taken = seen, True
            out.append((*key, day, value, outlet if named else None))
        yield pd.DataFrame(out, columns=[*keys, "day", "value", "outlet"])
        state.update((value, base, current, taken))

    combined = _combiner(best_rank_per_value, schema, captures.select(*columns))
    return combined.groupBy(*keys).applyInPandasWithState(
        advance, "event_key string, metric string, day string, value bigint, outlet string",
        "value bigint, base bigint, day string, taken boolean", "append", GroupStateTimeout.NoTimeout,
    )


def silent_sources(events: DataFrame, source: str, ts: str, hours: int = 48, late: str = "1 hour") -> DataFrame:
    """One row when a source has sent nothing for ``hours`` of event time."""
    import pandas as pd

    def newest(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.groupby("source", as_index=False)["ts"].max()

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"source": [key[0]], "last_seen": [pd.Timestamp(last, unit="us")]})
            return
        seen = max(int(f["ts"].max().value // 1000) for f in frames)
        last = max(seen, state.get[0]) if state.exists else seen
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))

    marked = events.select(F.col(source).cast("string").alias("source"), F.col(ts).cast("timestamp").alias("ts"))
    combined = _combiner(newest, "source string, ts timestamp", marked).withWatermark("ts", late)
    return combined.groupBy("source").applyInPandasWithState(
        watch, "source string, last_seen timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def file_stream(spark: SparkSession, schema, path: str, files: int = 100) -> DataFrame:
    """Parquet files as a stream, oldest first, so many to a batch that a backlog does not come as one."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_once(stream: DataFrame, folder: str, mode: str = "append", on: Column | None = None) -> DataFrame:
    """Process what is there and read the result back from the shared folder."""
    out, log = f"{folder}/rows", f"{folder}/log"
    chosen = stream if on is None else stream.filter(on)
    query = (
        chosen.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", log).option("path", out)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
