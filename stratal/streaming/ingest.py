"""Incremental ingestion: a stream of axiom rows is added batch by batch, each hash once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from stratal.operators.mutations import add_rows
from stratal.sources import store


def ingest_axioms(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start adding the stream's rows (hash, type, data) to the store. A batch that is run again after a failure adds
    nothing twice, for adding skips hashes that are stored; one that loses a race reads again."""

    @store.retried
    def add(batch: DataFrame, _: int) -> None:
        with store.session(batch.sparkSession, path) as s:
            s.ontology, _new = add_rows(s.ontology, batch)
            s.commit()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
