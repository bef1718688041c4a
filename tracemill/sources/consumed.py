"""The activity log summed once: a stream over its files, whose checkpoint is the offset of what was counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import activity_summary
from .files import listing

ACTIVITY = "action string, record_id string, quality_tier string, timestamp string"


def consume_activity(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """(action, n) over the lines of all files in folder that no earlier call with this state has counted.

    All or nothing: a line that isn't JSON stops the call, nothing of its batch counts as consumed, and the next call
    reads the batch again. Counts of a batch are written under its number before the batch is done, so a repeated batch
    replaces its own counts and isn't added twice. Empty folders give no rows.
    """
    counts = f"{state.rstrip('/')}/counts"

    def batches() -> set[int]:
        return {int(r.path.rsplit("batch=", 1)[1].split("/")[0]) for r in listing(spark, f"{counts}/batch=*/_SUCCESS").select("path").collect()}

    done = batches()

    def count(df: DataFrame, batch: int) -> None:
        activity_summary(df).write.mode("overwrite").parquet(f"{counts}/batch={batch}")

    lines = spark.readStream.schema(ACTIVITY).option("mode", "FAILFAST").json(folder)
    lines.writeStream.foreachBatch(count).option("checkpointLocation", f"{state.rstrip('/')}/offsets").trigger(availableNow=True).start().awaitTermination()
    new = sorted(batches() - done)
    schema = "action string, n bigint"
    rows = spark.read.schema(schema).parquet(*(f"{counts}/batch={b}" for b in new)) if new else spark.createDataFrame([], schema)
    return rows.groupBy("action").agg(F.sum("n").alias("n"))
