"""Runs the session stream over a finished table of events, for checks and backfills."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sessions import SESSION, from_event_table
from .sessions import ROCKSDB, assemble_stream

#: Session of the event that closes a finished run.
CLOSING = "closing"
STORE = "spark.sql.streaming.stateStore.providerClass"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, in a temporary place of a local session, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tracemill-')}"
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_sessions(spark: SparkSession, events: str, batches: int = 2) -> DataFrame:
    """Feeds the table's events to the stream in so many batches, each second one in the wrong order of time, and an end event for each session, until all are read; returns what it wrote.

    A last event of a session of its own, long after all others, lets the watermark pass all timers; it gives no row.
    """
    folder = shared_folder(spark)
    rows = from_event_table(spark.read.parquet(events))
    ends = rows.groupBy("session_id").agg((F.max("seq") + 1).alias("seq"), F.max("at").alias("at")).withColumn("kind", F.lit("end"))
    # ends and what is rated or reported go first, so that most of a session's events follow its end
    part = F.when(F.col("kind").isin("end", "rate"), 0).otherwise(F.pmod(F.col("seq"), F.lit(batches - 1)) + 1)
    every = rows.unionByName(ends, allowMissingColumns=True)
    every.withColumn("_part", part).write.partitionBy("_part").parquet(f"{folder}/all")
    young = every.agg(F.max("at").alias("at")).select(F.lit(CLOSING).alias("session_id"), F.lit(0).cast("bigint").alias("seq"), F.lit("close").alias("kind"), (F.col("at") + F.expr("interval 1000 days")).alias("at"))
    closing = every.where("false").unionByName(young, allowMissingColumns=True)
    for i in range(batches):  # a file for each batch, in order
        spark.read.schema(rows.schema).parquet(f"{folder}/all/_part={i}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    closing.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        made = assemble_stream(stream, delay="400 days").where(F.col("session_id") != CLOSING)
        query = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(SESSION).parquet(f"{folder}/out")
