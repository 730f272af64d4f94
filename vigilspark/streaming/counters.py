"""Live counts of running streams: conditions observed in the plan, added up by a listener."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: What marks an observation as one of these counts.
MARK = "counts:"


def counting(df: DataFrame, name: str, **amounts: Column) -> DataFrame:
    """df, whose rows are counted under each name while it runs: a condition counts rows, a number is added up."""
    kinds = dict(df.select(*(c.alias(k) for k, c in amounts.items())).dtypes)
    return df.observe(f"{MARK}{name}", *((F.count_if(c) if kinds[k] == "boolean" else F.coalesce(F.sum(c).cast("bigint"), F.lit(0))).alias(k) for k, c in amounts.items()))


class Counters(StreamingQueryListener):
    """Sums over all triggers of all streams of a session since it was attached, and the failures of streams."""

    def __init__(self) -> None:
        self._lock, self._sums, self._failed, self._ended = threading.Lock(), {}, 0, 0

    def attach(self, spark: SparkSession) -> Counters:
        spark.streams.addListener(self)
        return self

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._lock:
            for name, row in event.progress.observedMetrics.items():
                if name.startswith(MARK):
                    for k, v in row.asDict().items():
                        key = (name[len(MARK) :], k)
                        self._sums[key] = self._sums.get(key, 0) + (v or 0)

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended += 1
            self._failed += event.exception is not None

    def snapshot(self) -> dict[tuple[str, str], int]:
        with self._lock:
            return dict(self._sums)

    def ended(self) -> tuple[int, int]:
        """Streams that ended, and those of them that failed."""
        with self._lock:
            return self._ended, self._failed

    def records(self, spark: SparkSession, name: str) -> DataFrame:
        """Counts of one observation as (name, amount), which stage_counts() takes."""
        return spark.createDataFrame([(k, v) for (n, k), v in sorted(self.snapshot().items()) if n == name], "name string, amount long")
