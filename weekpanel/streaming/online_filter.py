"""Causal regime filter as a stateful stream: one posterior per sequence.

The stream needs a state store with typed state (``use_rocksdb`` sets it). Observations of a trigger arrive batch by batch;
only their log densities (one number per state) and times are held until they are taken in time order. An observation at
or before the last one of its sequence comes too late for a causal filter and is left out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weekpanel.functions import hmm_kernels as kernels

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(kernels)

STATE = "posterior array<double>, t timestamp"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class FilterProcessor(StatefulProcessor):
    """Carries the last normalised posterior of a sequence and its time; drops them when the sequence has ended."""

    def __init__(self, params: dict, key: str, idle_ms: int | None = None):
        self.start, self.trans, self.means, self.covars = (np.asarray(params[c], float) for c in ("start", "trans", "means", "covars"))
        self.key, self.idle_ms, self.kernels = key, idle_ms, kernels

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self._keep(np.asarray(row["posterior"], float), pd.Timestamp(row["t"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times, dense = [], []
        for pdf in rows:
            times.append(pdf["t"].to_numpy())
            dense.append(self.kernels.log_emissions(np.asarray(pdf["x"].tolist(), float), self.means, self.covars))
        t, log_b = np.concatenate(times), np.concatenate(dense)
        order = np.argsort(t, kind="stable")
        previous, last = None, None
        if self.state.exists():
            posterior, last = self.state.get()
            previous, last = np.asarray(posterior, float), np.datetime64(pd.Timestamp(last))
        kept, out = [], []
        for i in order:
            if last is not None and t[i] <= last:
                continue
            prior = self.start if previous is None else previous @ self.trans
            previous = self.kernels.normalized(np.log(np.clip(prior, self.kernels.TINY, None)) + log_b[i])
            kept.append(i)
            out.append(previous)
        if kept:
            self._keep(previous, pd.Timestamp(t[kept[-1]]))
        yield pd.DataFrame({
            self.key: [key[0]] * len(kept), "t": t[kept], "filtered": [p.tolist() for p in out], "regime": [int(np.argmax(p)) for p in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({self.key: pd.Series(dtype=object), "t": pd.Series(dtype="datetime64[ns]"), "filtered": pd.Series(dtype=object), "regime": pd.Series(dtype="int32")})

    def close(self) -> None:
        pass

    def _keep(self, posterior: np.ndarray, t: pd.Timestamp) -> None:
        self.state.update((posterior.tolist(), t.to_pydatetime()))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(t.timestamp() * 1000) + self.idle_ms)


def online_filter(
    observations: DataFrame, params: dict, key: str = "entity", initial: DataFrame | None = None, idle: str | None = None
) -> DataFrame:
    """Filtered posterior and regime of each arriving observation (columns key, t, x).

    ``initial`` (key, posterior, t) continues from a batch run. With ``idle`` (an interval such as '30 days') a sequence whose
    last observation lies that far behind the watermark has ended: its state is dropped, and what comes later starts anew.
    """
    idle_ms = None
    if idle is not None:
        observations = observations.withWatermark("t", "0 seconds")
        idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    schema = f"{key} {dict(observations.dtypes)[key]}, t timestamp, filtered array<double>, regime int"
    start = initial.select(key, F.col("posterior").cast("array<double>"), F.col("t").cast("timestamp")).groupBy(key) if initial is not None else None
    return observations.groupBy(key).transformWithStateInPandas(
        FilterProcessor(params, key, idle_ms), schema, "Append", "None" if idle is None else "EventTime", start)
