"""The health of a running loop: counts that Spark observes while a micro-batch runs, appended to a table by a listener.

Nothing is counted twice and no query is run for it: the counts are by-products of the stages that the stream runs anyhow.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "query string, batch bigint, name string, metric string, value bigint"


def observed(stream: DataFrame, name: str, conditions: dict[str, Column]) -> DataFrame:
    """stream, which counts its rows (as `rows`) and those for which each condition holds in every micro-batch."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


class Meter(StreamingQueryListener):
    """Appends every micro-batch's observed counts to a Parquet table; rows that couldn't be written are kept for the next time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.held: list[tuple[str, int, str, str, int]] = []
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with self.lock:
            self.held += [(str(p.id), p.batchId, name, k, int(v)) for name, row in p.observedMetrics.items() for k, v in row.asDict().items()]

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def flush(self) -> int:
        """Writes what was told so far and gives its count of rows. Not from the callbacks: they hold up Spark's event queue."""
        with self.lock:
            rows = list(self.held)
            if rows:
                self.spark.createDataFrame(rows, METRICS).coalesce(1).write.mode("append").parquet(self.path)
                self.held.clear()
        return len(rows)


def totals(spark: SparkSession, path: str, name: str) -> DataFrame:
    """metric and value over all batches of one name; a batch that was told twice, as after a restart, counts once."""
    return spark.read.schema(METRICS).parquet(path).filter(F.col("name") == name).dropDuplicates(["query", "batch", "metric"]).groupBy("metric").agg(F.sum("value").alias("value"))


def await_listeners(spark: SparkSession) -> None:
    """Until every event so far has reached the listeners."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
