"""Streaming forms of the frame and episode operators, for ledgers that arrive as they are measured."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_levels(events: DataFrame, key: str, ts: str, value: str, frame: str, hop: str, late: str) -> DataFrame:
    """key, start, end, n, mean level of sliding frames; rows later than `late` behind the newest are dropped by the
    watermark, which also bounds the state."""
    w = F.window(ts, frame, hop)
    return events.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("level")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "level")


def episodes(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """key, start, end, n of sessions whose neighbours are less than gap apart."""
    s = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(key, s.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last")).select(key, F.col("s.start").alias("start"), "last", "n")


def into_versions(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs what has arrived through write(batch, id), once each; restarts go on after the last whole batch."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refractory(events: DataFrame, key: str, ts: str, value: str, distance_sec: float, late: str) -> DataFrame:
    """key, ts, value of the events that stay when one within distance_sec of the last kept competes with it and the better
    value stays. Events come in order of time within a batch; the event held for a key is let go by the next distant one, or
    once the watermark, `late` behind the newest event, has passed it by distance_sec. State is one event a key."""

    def step(keys: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, out = (state.get if state.exists else None), []
        if state.hasTimedOut:
            out, held = [held], None
        else:
            for t, v in sorted((t, v) for pdf in pdfs for t, v in zip(pdf[ts], pdf[value], strict=True)):
                at = t.value // 1000
                if held is not None and at - held[0] <= distance_sec * 1e6:
                    held = (at, float(v)) if v > held[1] else held
                else:
                    out += [held] if held is not None else []
                    held = (at, float(v))
        if held is None:
            state.remove()
        else:
            state.update(held)
            state.setTimeoutTimestamp(max(int(held[0] // 1000 + distance_sec * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({key: [keys[0]] * len(out), ts: pd.to_datetime([x[0] for x in out], unit="us"), value: [x[1] for x in out]})

    kind = events.schema[key].dataType.simpleString()
    shape = events.withWatermark(ts, late).select(key, ts, F.col(value).cast("double").alias(value))
    return shape.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} timestamp, {value} double", "at long, best double", "append", "EventTimeTimeout")
