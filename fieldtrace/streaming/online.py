"""Structured Streaming: windowed summaries with late data, and fixed-lag tracking with state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import kernels


def windowed_summary(stream: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", slide: str | None = None, lateness: str = "2 hours") -> DataFrame:
    """Count, mean and range of each key in tumbling or sliding windows; rows later than ``lateness`` are dropped by the watermark.

    Works on streams and tables alike. Medians have no incremental form; streams get means.
    """
    rows = stream.withColumn("_t", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("_t", lateness) if stream.isStreaming else rows
    span = F.window("_t", width, slide) if slide else F.window("_t", width)
    out = rows.groupBy(span.alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "mean", "low", "high")


def fixed_lag_stream(stream: DataFrame, key: str, order: str, value: str, dist: np.ndarray, ref: np.ndarray, lag: int, vmax: float, period: float, sigma: float = 1.2, timeout_ms: int | None = None) -> DataFrame:
    """Position of each sample once ``lag`` more have come. State per key: scores and the last ``lag`` back pointers.

    Samples of a key must arrive in order. With ``timeout_ms`` a key silent for so long gives out its tail and its state ends;
    without it, states stay and a run over what is available ends by itself.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dp, ring, waiting = (np.array(x) if i == 0 else x for i, x in enumerate(json.loads(state.get[0]))) if state.exists else (None, [], [])
        out: list[tuple] = []
        if state.hasTimedOut:
            out = [(name[0], waiting[-1 - k], float(dist[kernels._rewind([np.array(p) for p in ring[len(ring) - k :]], int(dp.argmax()))])) for k in range(len(waiting))]
            state.remove()
        else:
            for pdf in frames:
                pdf = pdf.sort_values(order, kind="stable")
                ll = kernels.log_likelihood(pdf[value].to_numpy(dtype=float), ref, sigma)
                for at, row in zip(pdf[order], ll, strict=True):
                    if dp is None:
                        dp = row
                    else:
                        now = kernels.viterbi(np.stack([dp, row]), dist, np.array([0.0, period]), vmax)
                        dp, ring = now["dp"], [*ring, now["back"][1].tolist()][-lag:] if lag else []
                    waiting.append(int(at))
                    if len(waiting) > lag:
                        out.append((name[0], waiting.pop(0), float(dist[kernels._rewind([np.array(p) for p in ring], int(dp.argmax()))])))
            state.update((json.dumps([dp.tolist(), ring, waiting]),))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=[key, order, "pred"])

    kind = dict(stream.dtypes)[key]
    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, {order} long, pred double", "state string", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    )
