"""Figures of running queries, from `observe` and the progress events."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def rows_dropped(query: StreamingQuery) -> int:
    """Rows that came behind the watermark of the query and were left out, over its recent batches."""
    return sum(state.numRowsDroppedByWatermark for progress in query.recentProgress for state in progress.stateOperators)


class ObservedMetrics(StreamingQueryListener):
    """Keeps the last observed row of each name and the count of input rows of each query."""

    def __init__(self):
        self.observed: dict[str, dict] = {}
        self.input_rows: dict[str, int] = {}
        self.failures: list[str] = []

    def onQueryStarted(self, event) -> None:
        self.input_rows[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self.input_rows[str(progress.id)] = self.input_rows.get(str(progress.id), 0) + progress.numInputRows
        for name, row in progress.observedMetrics.items():
            self.observed[name] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failures.append(event.exception)
