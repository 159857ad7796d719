"""Event-time streaming over stored tables, drained to the end: the library's own addition to the run operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import remove, scratch


def drain(spark: SparkSession, path: str, plan, mode: str = "append", time: str | None = None, delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Run ``plan(stream)`` over the stored table at ``path`` until all of it is taken; results via the shared folder.
    The table is taken in bounded micro-batches. With ``time``, its event-time column, the end of the table is streamed
    last: a row beyond all others by more than the watermark's ``delay`` and a window's ``size``, so that every window
    of the table is closed and emitted."""
    home = scratch(spark, "stream")
    table = spark.read.parquet(path)
    wave = 128 * 2**20 * spark.sparkContext.defaultParallelism  # what the cores take at a time
    stream = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", wave).parquet(f"{path[:-1]}[{path[-1]}]")
    end = None
    if time is not None:
        last = table.agg(F.max(time).alias(time))
        end = last.select(*[(F.col(time) + F.expr(f"interval {delay}") + F.expr(f"interval {size}") + F.expr(f"interval {size}")).alias(time) if c == time else F.lit(None).cast(t).alias(c) for c, t in table.dtypes])
        end.limit(0).write.parquet(f"{home}/end")
        stream = stream.unionByName(spark.readStream.schema(end.schema).parquet(f"{home}/end"))
    out = plan(stream)
    if mode == "append":
        q = out.writeStream.outputMode("append").format("parquet").option("path", f"{home}/out")
    else:
        q = out.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{home}/out"))
    run = q.option("checkpointLocation", f"{home}/state").start()
    try:
        run.processAllAvailable()
        if end is not None:
            end.write.mode("append").parquet(f"{home}/end")
            run.processAllAvailable()
    finally:
        run.stop()
    remove(spark, f"{home}/state")
    return spark.read.schema(out.schema).parquet(f"{home}/out")


def windowed_counts(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tumbling windows per event type under a watermark."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    g = e.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def deduplicated(events: DataFrame, key: str = "event_id", delay: str = "1 day") -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark([key]).drop("at")
