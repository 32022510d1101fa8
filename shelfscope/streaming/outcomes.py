"""What came of each micro-batch, as rows: the metrics a stream observes, taken up as the batches end."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from shelfscope.sources import files

OUTCOMES = "query string, batch_id bigint, kind string, metric string, value bigint"


class Outcomes(StreamingQueryListener):
    """Keeps the observed metrics of every batch below ``folder``, one small file per batch; a batch that is repeated replaces its file."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.ended.discard(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.observedMetrics:
            return
        rows = [
            {"query": str(p.id), "batch_id": p.batchId, "kind": kind, "metric": metric, "value": int(value or 0)}
            for kind, metrics in p.observedMetrics.items()
            for metric, value in metrics.asDict().items()
        ]
        path = f"{self.folder}/{p.id}-{p.batchId:09d}.json"
        files.remove(self.spark, path)
        files.create_text(self.spark, path, "\n".join(map(json.dumps, rows)) + "\n")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until the last batch of an ended query is kept: listeners hear of a batch a little later than the query goes on."""
        until = time.monotonic() + seconds
        while str(query.runId) not in self.ended and time.monotonic() < until:
            time.sleep(0.05)

    def read(self) -> DataFrame:
        if not files.names(self.spark, self.folder):
            return self.spark.createDataFrame([], OUTCOMES)
        return self.spark.read.schema(OUTCOMES).json(self.folder)


def keep_outcomes(spark: SparkSession, folder: str) -> Outcomes:
    """Listen to the session's streams from now on. ``spark.streams.removeListener`` ends it."""
    kept = Outcomes(spark, folder)
    spark.streams.addListener(kept)
    return kept
