"""A published projection kept up to date from a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from concordat.operators.contract import contract_projection


def publish_stream(
    source: DataFrame,
    columns: Sequence[str] | None,
    target: str,
    checkpoint: str,
    continuous: bool = False,
    interval: str = "10 seconds",
    fmt: str = "parquet",
) -> StreamingQuery:
    """Write the contract's columns of a stream to a folder.

    Continuous publication runs until stopped; otherwise what is there now is
    processed and the query ends.
    """
    writer = (
        contract_projection(source, columns)
        .writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    trigger = {"processingTime": interval} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start(target)
