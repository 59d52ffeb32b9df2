"""Detection on streams: each document is on its own, so the batch plan runs unchanged and keeps no state."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veilmark.operators import pipeline, store
from veilmark.operators.pipeline import Settings


def anonymise_stream(docs: DataFrame, how: Settings = Settings(), id_col: str = "doc_id") -> DataFrame:
    done = pipeline.anonymise(pipeline.detect(docs, how), how)
    return done.select(id_col, "anonymized_text", "mapping")


def write_with_mapping(anonymised: DataFrame, text_path: str, mapping_path: str, checkpoint: str, id_col: str = "doc_id") -> StreamingQuery:
    """Texts and the long mapping of every micro-batch, each batch in a folder of its own, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist(StorageLevel.DISK_ONLY)
        try:
            batch.drop("mapping").write.mode("overwrite").parquet(f"{text_path}/batch={number}")
            store.long_mapping(batch, id_col).write.mode("overwrite").parquet(f"{mapping_path}/batch={number}")
        finally:
            batch.unpersist()

    return anonymised.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
