"""Streaming forms: first-wins dedup within a watermark, windowed counts, and the last edited word of each session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table as a stream (the files' schema is taken from the batch reader)."""
    schema = spark.read.parquet(f"{path}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*.parquet").parquet(path)


def first_wins(events: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def edited(before: list[str] | None, now: list[str]) -> str | None:
    """The one word inserted or replaced since ``before`` (after a deletion, the word that follows it)."""
    if len(now) == 1:
        return now[0]
    if not before or not now or abs(len(now) - len(before)) > 1 or before == now:
        return None
    same = next((k for k, (a, b) in enumerate(zip(before, now, strict=False)) if a != b), min(len(before), len(now)))
    if now[same + (len(now) >= len(before)) :] != before[same + (len(now) <= len(before)) :]:
        return None
    return now[min(same, len(now) - 1)]


def last_edited(sessions: DataFrame, session: str = "conv_id", turn: str = "turn", words: str = "words") -> DataFrame:
    """(session, turn, edited) of a stream of queries: the state of a session is its last query.  It is kept for good: a
    time-out by the clock would keep a bounded replay from ever ending."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(turn)
        before = list(state.get[0]) if state.exists else None
        out = []
        for at, now in zip(rows[turn], rows[words], strict=True):
            out.append((key[0], at, edited(before, list(now))))
            before = list(now)
        state.update((before,))
        yield pd.DataFrame(out, columns=[session, turn, "edited"])

    kinds = dict(sessions.dtypes)
    return sessions.groupBy(session).applyInPandasWithState(step, f"{session} {kinds[session]}, {turn} {kinds[turn]}, edited string", "words array<string>", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now; its rows are written below the checkpoint's folder and read back."""
    out = f"{checkpoint}/rows"
    query = stream.writeStream.outputMode("append").format("parquet").queryName(name).option("checkpointLocation", f"{checkpoint}/state").option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
