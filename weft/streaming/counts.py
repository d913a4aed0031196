"""Files that arrive, counted as a stream and appended with their hash."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and totals by type of all events, read as a stream of files until none is left."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    name = f"weft_events_{uuid.uuid4().hex}"
    # the parquet reader takes a file or a folder of parts alike; a stream wants a folder
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(_folder(sf_dir))
    counts = stream.where(F.input_file_name().contains("/events.parquet")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    running = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name).select("event_type", "n", F.round("total", 4).alias("total"))


def _folder(sf_dir: str) -> str:
    import os

    path = f"{sf_dir}/events.parquet"
    return path if os.path.isdir(path) else f"{sf_dir}/events.parquet*"


def upsert_facts(spark: SparkSession, source: str, schema, facts: str, checkpoint: str, key: str = "file"):
    """A stream of changed files (file, text): each batch appends their rows under their content hash.

    Not yet an upsert: nothing is parsed or replaced, and a text that a file had before is passed over.
    """

    def merge(batch: DataFrame, _: int) -> None:
        fresh = batch.withColumn("sha256", F.sha2("text", 256))
        fresh.write.mode("append").partitionBy("sha256").parquet(facts)

    return spark.readStream.schema(schema).json(source).dropDuplicates([key, "text"]).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
