"""Running streams: the pump and the supervisor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def pump(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a stream through handle(batch, batch_id) until its input is used up; the first failure ends it."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def supervised(start: Callable[[], object], attempts: int, base: float, most: float, sleep: Callable[[float], None]) -> int:
    """Restart a query that fails, with growing pauses, up to `attempts` times in a row; a query that read rows begins a new row. Returns the restarts."""
    n = restarts = 0
    while True:
        query = start()
        try:
            query.awaitTermination()
            return restarts
        except Exception:  # noqa: BLE001  the query's own failure, whatever it is
            if any(p["numInputRows"] for p in getattr(query, "recentProgress", ())):
                n = 0
            if n == attempts:
                raise
            sleep(min(most, base * 2**n))
            n, restarts = n + 1, restarts + 1
