"""Standardizers are stateless Column functions, so a stream takes them as they are."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from brisa.plans.tables import standardize_table


def standardize_stream(stream: DataFrame, specs: Iterable[str], path: str, checkpoint: str, keep: Iterable[str] = ()) -> StreamingQuery:
    """Standardizes an endless table into Parquet files, exactly once; stops when all there is is done."""
    out = standardize_table(stream, specs, keep)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
