"""Continuous ingest of record files: each file is read once, keys already seen within the watermark are dropped, and
each micro-batch is chunked and appended. An extension for growing corpora; the batch operators are reused as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from evigrain.functions import text as T
from evigrain.operators import chunking, records as R


def record_stream(spark: SparkSession, folder: str, schema: str = R.DDL + ", imported_at timestamp", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def deduplicated(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """The first row of each dedup key within the watermark; later copies come too late to matter and are dropped."""
    keyed = stream.withColumn("dedup_key", T.dedup_key(F.col("doi"), F.col("title"), F.col("year")))
    return keyed.withWatermark("imported_at", late).dropDuplicatesWithinWatermark(["dedup_key"])


def ingest(stream: DataFrame, out: str, checkpoint: str, chunker: str = "sentence", **trigger) -> StreamingQuery:
    """Canonicalise, name and chunk each micro-batch and append it; a batch that is run again overwrites itself."""
    def batch(df: DataFrame, number: int) -> None:
        named = R.canonical(df).withColumn("record_id", R.record_id())
        chunking.chunk(named, chunker, nfkc=True).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
