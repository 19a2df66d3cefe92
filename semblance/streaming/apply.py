"""Fitted transforms on streams: they are stateless Column expressions, so no operator of its own is needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from semblance.operators.prepare import Params, clip, impute, scale


def prepare_stream(stream: DataFrame, medians: Params | None = None, limits: Params | None = None, scalers: Sequence[Params] = ()) -> DataFrame:
    """Impute, clip and scale arriving rows with parameters fitted on a batch table."""
    out = stream if medians is None else impute(stream, medians)
    out = out if limits is None else clip(out, limits)
    for p in scalers:
        out = scale(out, p)
    return out


def write_prepared(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append prepared rows to parquet with a stream checkpoint in shared storage, then stop when caught up."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)
