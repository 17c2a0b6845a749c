"""Streams: incremental ingest, windowed counts with late data, and run collapse with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_reads(spark: SparkSession, path: str) -> DataFrame:
    """Read-support files as they arrive: gamete_set, contig, pos, count; bad rows are left out."""
    parts = F.split("value", "\t")
    body = spark.readStream.text(path).where(~F.col("value").startswith("#") & ~F.col("value").startswith("gameteSet"))
    members = F.filter(F.transform(F.split(parts[0], ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())
    return body.select(members.alias("gamete_set"), F.get(parts, 1).alias("contig"), F.get(parts, 2).try_cast("long").alias("pos"), F.get(parts, 3).try_cast("int").alias("count")).where("pos IS NOT NULL AND count IS NOT NULL")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts and sums by tumbling event-time windows; rows later than ``late`` are dropped on streams."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.window(ts, size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of each key: rows with less than ``gap`` between them."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def collapse_stream(rows: DataFrame, key: str, ord_col: str, label: str, ts: str | None = None, idle_ms: int = 600_000) -> DataFrame:
    """key, start, end, label, n: runs of equal labels, each emitted once a later row of its key ends it.

    State is the open run of each key: its label, first and last ordinal, and count. Rows of a batch are
    taken in the order of ``ord_col``; batches must follow each other, and a row that comes after a later
    one of its key is an error. With an event time ``ts`` rows later than ``idle_ms`` are dropped, and a
    key's last run is emitted once the watermark has passed its last row by ``idle_ms``.
    """
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = f"{key} {kind[key]}, start long, end long, label string, n long"
    columns = [key, "start", "end", "label", "n"]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = list(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(k[0], run[1], run[2], run[0], run[3])], columns=columns)
            return
        pdf = pd.concat(list(batches)).sort_values(ord_col)
        done = []
        for at, value in zip(pdf[ord_col].tolist(), pdf[label].tolist(), strict=True):
            if run is not None and at <= run[2]:
                raise ValueError(f"row {at} of {k[0]} comes after row {run[2]}")
            if run is not None and run[0] == value:
                run[2], run[3] = at, run[3] + 1
            else:
                if run is not None:
                    done.append((k[0], run[1], run[2], run[0], run[3]))
                run = [value, at, at, 1]
        state.update(tuple(run))
        if ts:
            last = int(pdf[ts].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(done, columns=columns)

    marked = rows.withWatermark(ts, f"{idle_ms} milliseconds") if ts else rows
    timeout = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    return marked.groupBy(key).applyInPandasWithState(step, out, "label string, start long, end long, n long", "append", timeout)
