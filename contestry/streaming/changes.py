"""Live samples as a stream: per key only what differs from the last sample seen goes on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def changed(stream: DataFrame, key: str, order: list[str], value: str, ttl_ms: int | None = None) -> DataFrame:
    """Rows of a stream whose value differs, null-safely, from the one before of their key; the first of a key stays.

    State is one value a key and ends after ttl_ms without samples, if given (not for a replay, where a processing-time
    limit would call for batches without end). Within a micro-batch rows are taken by order; a row
    that comes in a later batch than its successors is compared with the last one seen.
    """
    schema = stream.select(key, *order, value).schema

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")[schema.names]
        now = rows[value].astype(object).where(rows[value].notna(), None)
        before = now.shift(1)
        differs = ~((now == before) | (now.isna() & before.isna()))
        last = state.get if state.exists else None
        differs.iloc[0] = last is None or now.iloc[0] != last[0]
        state.update((now.iloc[-1],))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield rows[differs.astype(bool)]

    return stream.groupBy(key).applyInPandasWithState(step, schema, StructType([schema[value]]), "append", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def replay(stream: DataFrame) -> DataFrame:
    """All of a bounded stream, run to its end into Parquet files in the shared folder and read back."""
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    at = os.path.join(base, f"replay-{uuid.uuid4().hex}")
    run = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
