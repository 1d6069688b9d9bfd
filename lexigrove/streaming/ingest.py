"""Continuous ingest: every micro-batch of a stream becomes a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lexigrove.operators.ingest import numbered, prepare
from lexigrove.sources.store import load, save, segments


def write_batch(root: str, batch: DataFrame, batch_id: int, skip_known_ids: bool = True) -> None:
    """Add a batch (idx, id, fields) to the store as segment ``batch_id``.

    A batch that is delivered again, after a failure, replaces its own segment if that was not finished and is passed
    over if it was.  With ``skip_known_ids``, documents whose id an earlier segment holds are left out.
    """
    spark = batch.sparkSession
    done = segments(spark, root)
    if batch_id in done:
        return
    earlier = [s for s in done if s < batch_id]
    known = load(spark, root, earlier).known_ids() if skip_known_ids and earlier else None
    accepted = numbered(prepare(batch, known).accepted, ["idx"])
    save(accepted, root, batch_id, overwrite=True)


def ingest(stream: DataFrame, root: str, checkpoint: str, skip_known_ids: bool = True) -> DataStreamWriter:
    """A writer that ingests ``stream`` (idx, id, fields) into the store at ``root``; call ``start()`` on it."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(root, batch.select(F.col("idx"), F.col("id"), F.col("fields")), batch_id, skip_known_ids)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
