"""Streams that keep a state for each key: throttled attempts, and rows that expire.

Both give what their tables' counterparts give, whatever batches the rows come
in, and go on from their checkpoint after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

_MICROS = StructType([StructField("micros", LongType())])


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


class _Throttle(StatefulProcessor):
    """The state of a source: the time of its last attempt, allowed or not."""

    def __init__(self, source: str, at: str, tie: str, seconds: int):
        self.source, self.at, self.tie, self.micros = source, at, tie, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _MICROS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values([self.at, self.tie])
        at = _micros(frame[self.at])
        before = at.shift(1).astype("Int64")
        if self.last.exists():
            before.iloc[0] = self.last.get()[0]
        allowed = before.isna() | (at.astype("Int64") - before >= self.micros)
        self.last.update((int(at.iloc[-1]),))
        yield frame.assign(decision=["allowed" if x else "too_soon" for x in allowed.fillna(True)])

    def close(self) -> None:
        pass


def throttled(attempts: DataFrame, source: str, at: str, tie: str, seconds: int) -> DataFrame:
    """A stream of attempts, each marked allowed, or too_soon after the one before it at its source.

    Rows of one source must come in the order of ``at`` from batch to batch;
    within a batch they are sorted. Nothing but a time is kept for a source.
    """
    schema = StructType([*attempts.schema.fields, StructField("decision", attempts.sparkSession.createDataFrame([], "x string").schema["x"].dataType)])
    return attempts.groupBy(source).transformWithStateInPandas(_Throttle(source, at, tie, seconds), outputStructType=schema, outputMode="Append", timeMode="None")


class _Expiry(StatefulProcessor):
    """The state of a key: when it expires. A timer tells when that time has come."""

    def __init__(self, key: str, until: str):
        self.key, self.until = key, until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.end = handle.getValueState("end", _MICROS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = max(int(_micros(frame[self.until]).max()) for frame in rows)
        if self.end.exists():
            old = self.end.get()[0]
            if old >= last:
                return iter(())
            self.handle.deleteTimer(-(-old // 1000))
        self.end.update((last,))
        self.handle.registerTimer(-(-last // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = self.end.get()[0]
        self.end.clear()
        yield pd.DataFrame({self.key: [key[0]], self.until: pd.to_datetime([end], unit="us")})

    def close(self) -> None:
        pass


def expired(rows: DataFrame, key: str, until: str, late: str = "0 seconds") -> DataFrame:
    """key and until of rows whose time has passed, as the stream's own times pass it.

    ``rows``: a stream of key, ``at`` (the time of its row, which the watermark
    follows, ``late`` behind) and ``until``. A later row of a key that is held
    moves its end forward.
    """
    watched = rows.withWatermark("at", late)
    schema = StructType([rows.schema[key], rows.schema[until]])
    return watched.groupBy(key).transformWithStateInPandas(_Expiry(key, until), outputStructType=schema, outputMode="Append", timeMode="EventTime")
