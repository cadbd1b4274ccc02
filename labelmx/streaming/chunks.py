"""Chunked processing of rows as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..model import LabeledMatrix
from ..operators.reshape import map_chunks


def chunk_stream(
    stream: DataFrame,
    to_matrix: Callable[[DataFrame], LabeledMatrix],
    fn: Callable,
    schema: str,
    out: str,
    checkpoint: str,
    *,
    chunk_size: int = 6000,
    once: bool = True,
) -> StreamingQuery:
    """Apply ``fn`` to bounded row chunks of every micro-batch (see ``map_chunks``).

    Each batch writes its own folder of ``out``, so a replayed batch replaces
    its earlier result instead of adding to it.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        done = map_chunks(to_matrix(batch), fn, schema, chunk_size=chunk_size)
        done.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
