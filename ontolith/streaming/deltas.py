"""A streaming extension: change logs applied to a root table as they come. Not part of the batch semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.algebra import last_ops


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """events files as a stream of (event_id, ts, op, root_id)."""
    raw = spark.readStream.schema(schema).parquet(path)
    op = F.when(F.col("event_type").isin("signup", "view"), "add").when(F.col("event_type") == "error", "remove")
    return raw.select("event_id", "ts", op.alias("op"), F.concat(F.lit("Declaration(named_individual urn:d:user:"), F.col("user_id").cast("string"), F.lit(")")).alias("root_id")).where("op is not null")


def follow(log: DataFrame, target: str, checkpoint: str):
    """Appends each micro-batch's last operations to a table of partial states (max by time on read), idempotently by batch."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("root_id").agg(F.max(F.struct("ts", "event_id", "op")).alias("m")).select("root_id", "m.*")
        last.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, target: str) -> DataFrame:
    """The delta that the stream has gathered so far."""
    return last_ops(spark.read.parquet(target))
