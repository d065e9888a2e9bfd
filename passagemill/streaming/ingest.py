"""Continuous ingest: new documents are processed as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..operators.embed import EmbedFn
from ..plans.ingest import Clock, run_ingest, utc_now
from ..sources.tables import Tables


def stream_ingest(
    documents: DataFrame,
    split: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    tables: Tables,
    cfg: EngineConfig,
    checkpoint: str,
    make_model: Callable[[], EmbedFn] | None = None,
    label: str = "batch",
    trigger: dict[str, object] | None = None,
    clock: Clock = utc_now,
) -> StreamingQuery:
    """Run the batch ingest on every micro-batch of a document stream.

    ``split`` turns a micro-batch into registry rows and Markdown rows. The run
    id is the batch number; a repeated batch is another attempt of its run, whose rows
    take the place of the first one's. ``trigger`` is that of the stream, such as
    ``{"processingTime": "1 minute"}``; by default it takes what is there and ends.
    """

    def ingest_batch(batch: DataFrame, number: int) -> None:
        registered, markdown = split(batch)
        run_ingest(tables, registered, markdown, cfg, f"{label}-{number:09d}", make_model, clock)

    return (
        documents.writeStream.foreachBatch(ingest_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
