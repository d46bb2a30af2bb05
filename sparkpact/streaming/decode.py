"""Decoders over streams: they are stateless projections, so a stream is decoded as a table is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.core import Decoder
from ..plans.api import Result, decode, decode_json


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def decode_stream(stream: DataFrame, decoder: Decoder, column: str | None = None, json: bool = False, lossless: bool = False) -> Result:
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return decode_json(stream, decoder, column, lossless) if json else decode(stream, decoder, column)


def split_sinks(result: Result, valid_path: str, issues_path: str, checkpoint: str, *keys: str, once: bool = False):
    """Starts one query that writes valid rows and issues as Parquet: each batch is decoded once and written to both. A batch
    has a folder of its own (batch=n), which is written anew if the batch is repeated after a failure. `once`: what is
    there now, and then an end."""
    def write(batch: DataFrame, number: int) -> None:
        held = Result(batch.persist(), result.inputs)
        try:
            held.valid().write.mode("overwrite").parquet(f"{valid_path}/batch={number}")
            held.issues(*keys).write.mode("overwrite").parquet(f"{issues_path}/batch={number}")
        finally:
            held.all.unpersist()

    writer = result.all.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
