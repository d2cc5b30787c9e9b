"""Event-time windows, in batch and as streams with watermarks. Event times without zone are read as UTC."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.durable import delete_at_exit, shared_folder


def _at() -> F.Column:
    return F.col("ts").cast("timestamp")


def tumbling(events: DataFrame, length: str) -> DataFrame:
    w = events.groupBy(F.window(_at(), length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start_at"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str, step: str) -> DataFrame:
    w = events.groupBy(F.window(_at(), length, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start_at"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    w = events.withColumn("at", _at()).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    return w.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start_at"), F.col("last").cast("timestamp_ntz").alias("last_at"), "n")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream of files."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    single = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = single.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(single).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def stream_sessions(spark: SparkSession, path: str, gap: str, delay: str) -> DataFrame:
    return sessions_of(read_stream(spark, path).withColumn("at", _at()).withWatermark("at", delay), gap)


def sessions_of(events: DataFrame, gap: str) -> DataFrame:
    w = events.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    return w.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start_at"), F.col("last").cast("timestamp_ntz").alias("last_at"), "n")


def stream_deduplicated(spark: SparkSession, path: str, delay: str) -> DataFrame:
    events = read_stream(spark, path).withColumn("at", _at())
    twice = events.unionByName(read_stream(spark, path).withColumn("at", _at()).where("value > 10"))
    return twice.withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])


def stream_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is (``availableNow``) into a written table and read that. In update mode each batch's rows are appended."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/cairn/{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{base}/data" if mode == "append" else f"{base}/data/batch=none")  # so that there is a table even if nothing comes
    delete_at_exit(spark, base)
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        run = writer.format("parquet").option("path", f"{base}/data").start()
    else:
        run = writer.foreachBatch(lambda df, batch: df.write.mode("append").parquet(f"{base}/data/batch={batch}")).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data" if mode == "append" else f"{base}/data/*")
