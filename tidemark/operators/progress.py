"""Records and bytes of a transfer, counted in the pass that writes or merges them."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Name of the metrics in a stream's progress.
NAME = "transfer"


def metrics() -> list[Column]:
    """Rows, and bytes of what they carry: the payload and the text kept aside in conflicts."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    return [F.count("*").alias("records"), F.coalesce(F.sum(size("serialized") + size("conflicting_serialized_data")), F.lit(0)).alias("bytes")]


def observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """``rows``, and what tells their records and bytes once they have been written.

    Ask for it right before the write: in the last stage a task's rows count once,
    however often it was run.
    """
    seen = Observation()
    return rows.observe(seen, *metrics()), seen


def watched(stream: DataFrame) -> DataFrame:
    """A stream of wire records whose progress says how many records and bytes each batch had."""
    return stream.observe(NAME, *metrics())


class Progress(StreamingQueryListener):
    """Batches, records and bytes of streams so far, by the name of their query.

    ``spark.streams.addListener(Progress())`` starts it; counts are those of this
    session, a restarted stream goes on from 0.
    """

    def __init__(self) -> None:
        self.totals: dict[str, Counter] = {}
        self.ended: dict[str, str | None] = {}
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self._names[str(event.runId)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = self._names.get(str(p.runId), p.name or str(p.id))
        row = p.observedMetrics.get(NAME)
        counts = {"records": row["records"], "bytes": row["bytes"]} if row is not None else {}
        self.totals.setdefault(name, Counter()).update({"batches": 1} | counts)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[self._names.get(str(event.runId), str(event.id))] = event.exception
