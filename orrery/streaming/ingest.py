"""Incremental ingest: passages that arrive as files are upserted into an index table, exactly once by their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def upsert_stream(spark: SparkSession, folder: str, schema: StructType, target: str, checkpoint: str) -> StreamingQuery:
    """Reads Parquet files as they come; each batch is appended under its number, so that a batch that is run again replaces
    itself. ``current`` gives the latest row of each id."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["chunk_id", "ingested_at"]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The latest row of each id, from the compacted table and the batches since."""
    from orrery.operators.history import once

    rows = spark.read.parquet(target)
    order = F.struct("ingested_at", "batch").alias("_at")
    return once(rows.select("*", order), "chunk_id", "_at").drop("batch", "_at")


def compact(spark: SparkSession, target: str) -> None:
    """Puts the latest rows into one batch, under the greatest number so far, and removes the ones it replaces, so that the log
    does not grow for ever. Not while the stream runs."""
    p = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    old = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch="))
    if len(old) < 2:
        return
    whole = f"{target}/_compacted"  # readers pass over names that begin so
    current(spark, target).write.mode("overwrite").parquet(whole)
    for n in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/batch={n}"), True)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(whole), spark._jvm.org.apache.hadoop.fs.Path(f"{target}/batch={old[-1]}"))


def arrivals(spark: SparkSession, folder: str, schema: StructType, late: str = "30 days") -> DataFrame:
    """A stream of the passages that arrive per day and form, with rows over ``late`` behind left out."""
    s = spark.readStream.schema(schema).parquet(folder).withWatermark("ingested_at", late)
    return s.groupBy(F.window("ingested_at", "1 day").alias("day"), "form_type").agg(F.count("*").alias("n"))
