"""Appending new observations to a stored matrix from a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..model import LabeledMatrix
from ..sources.bundle import append


def append_stream(
    stream: DataFrame,
    path: str,
    to_matrix: Callable[[DataFrame], LabeledMatrix],
    checkpoint: str,
    *,
    name: str = "append",
    once: bool = True,
) -> StreamingQuery:
    """Append every micro-batch to the bundle at ``path``.

    ``to_matrix`` turns a micro-batch into a labeled matrix with the stored
    variables. The batch id is committed with the data in one manifest, so a
    batch that is replayed after a failure is added once.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        append(batch.sparkSession, path, to_matrix(batch), stream=name, batch=batch_id)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer).start()
