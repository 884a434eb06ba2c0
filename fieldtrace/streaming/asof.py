"""An interpolating as-of join of two streams, with late rows.

Source and query rows of one key come in any order, up to the watermark's lateness. Both wait in typed list state. A query is answered
when the watermark has passed a source at or after it, so that no nearer one can come; a timer brings the watermark's news to keys
without new rows. A closing row says that its key has no rows behind it: once the watermark has passed it, open ends are given out
and the state goes. Of several sources at one time the greatest value counts.
State per key is what the lateness holds, and the last source before it.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Kinds of rows. A tick only brings time forward.
SOURCE, QUERY, CLOSE, TICK = 0, 1, 2, 3
#: Spark keeps typed state in this store only.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AsofJoin(StatefulProcessor):
    """Rows (key, t, kind, id, v), t in microseconds -> (key, id, v) of the query rows."""

    def __init__(self, key: str, clamp: bool) -> None:
        self.key, self.clamp = key, clamp

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sources = handle.getListState("sources", "t long, v double")
        self.queries = handle.getListState("queries", "t long, id long")
        self.ends = handle.getValueState("ends", "t long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = None
        for pdf in rows:
            for kind, state, other in ((SOURCE, self.sources, "v"), (QUERY, self.queries, "id")):
                own = pdf[pdf["kind"] == kind]
                if len(own):
                    state.appendList([(int(t), x) for t, x in zip(own["t"], own[other].tolist(), strict=True)])
            closing = pdf.loc[pdf["kind"] == CLOSE, "t"]
            if len(closing):
                self.ends.update((int(closing.max()),))
            due = pdf.loc[pdf["kind"] != TICK, "t"]
            if len(due):
                latest = max(int(due.max()), latest or 0)
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + 1)
        yield self._answer(key, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._answer(key, timerValues)

    def _answer(self, key: tuple, timer) -> pd.DataFrame:
        """Queries whose neighbours can change no more; what is not needed any longer leaves the state."""
        passed = timer.getCurrentWatermarkInMs() * 1000 - 1  # rows up to here have all come
        waiting = sorted(self.queries.get()) if self.queries.exists() else []
        points = sorted(self.sources.get()) if self.sources.exists() else []
        over = self.ends.exists() and self.ends.get()[0] <= passed
        times = [t for t, _ in points]
        out, left = [], []
        for t, i in waiting:
            before, after = bisect.bisect_right(times, t) - 1, bisect.bisect_left(times, t)
            if t <= passed and (over or after < len(times) and times[after] <= passed):
                # sources are sorted by value too, so the last one of a time is its greatest
                after = bisect.bisect_right(times, times[after]) - 1 if after < len(times) else after
                out.append((key[0], i, self._value(t, points[before] if before >= 0 else None, points[after] if after < len(times) else None)))
            else:
                left.append((t, i))
        first = bisect.bisect_right(times, min([passed, *(t for t, _ in left)])) - 1  # the last source that someone may still look back to
        keep = points[max(0, bisect.bisect_left(times, times[first])) :] if first >= 0 else points
        if over and not left:
            keep = []
            self.ends.clear()
        for state, rows in ((self.queries, left), (self.sources, keep)):
            if rows:
                state.put(rows)
            else:
                state.clear()
        return pd.DataFrame(out, columns=[self.key, "id", "v"])

    def _value(self, t: int, before: tuple | None, after: tuple | None) -> float | None:
        if before and after:
            return before[1] if before[0] == after[0] else before[1] + (after[1] - before[1]) * (t - before[0]) / (after[0] - before[0])
        return (before or after or (None, None))[1] if self.clamp else None

    def close(self) -> None:
        pass


def asof_stream(stream: DataFrame, key: str, ts: str, lateness: str, clamp: bool = False) -> DataFrame:
    """Values of the source rows at the query rows of a stream (key, ts, kind, id, v); kind is SOURCE, QUERY, CLOSE or TICK. -> key, id, v.

    Rows later than ``lateness`` behind the newest are dropped. The session's state store must be STORE.
    """
    rows = stream.withWatermark(ts, lateness).withColumn("t", F.unix_micros(F.col(ts).cast("timestamp")))
    kind = dict(stream.dtypes)[key]
    return rows.select(key, ts, "t", "kind", "id", "v").groupBy(key).transformWithStateInPandas(statefulProcessor=AsofJoin(key, clamp), outputStructType=f"{key} {kind}, id long, v double", outputMode="Append", timeMode="EventTime")


def run_available(out: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there, into Parquet under ``folder``, and read that."""
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{folder}/result")
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{folder}/result")


def store_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the store that typed state needs; the caller's own stays as it is."""
    other = spark.newSession()
    other.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    other.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    other.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return other
