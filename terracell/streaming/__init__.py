"""Structured Streaming variants; the batch operators do not need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import store


def windowed_means(stream: DataFrame, t: str, value: str, keys: list[str], window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``start, keys, average, n`` per tumbling window; rows later than the watermark are dropped by Spark.

    The state of a window is a sum and a count per key; it goes when the watermark passes.
    """
    at = F.col(t).cast("timestamp")
    rows = stream.withColumn("_t", at).withWatermark("_t", late)
    g = rows.groupBy(F.window("_t", window).alias("_w"), *keys).agg(F.avg(value).alias("average"), F.count(value).alias("n"))
    return g.select(F.col("_w.start").alias("start"), *keys, "average", "n")


def running_means(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, total, n, average`` of all rows so far, for sinks in update mode: a micro-batch emits the keys it changed.

    Sum and count of a key live in Spark's state store, so a batch costs its own rows and keys and nothing is rewritten; missing values count in neither, and a
    key with missing values only has a NULL average.
    """
    v = F.col(value)
    v = F.when(~F.isnan(v), v) if dict(stream.dtypes)[value] in ("double", "float") else v
    sums = stream.groupBy(*keys).agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.count(v).alias("n"))
    return sums.withColumn("average", F.try_divide("total", "n"))


def keep_running_changes(stream: DataFrame, keys: list[str], value: str, path: str, checkpoint: str):
    """Starts a query that appends what each micro-batch changed in :func:`running_means` under ``path``, by batch; a batch that is run again overwrites itself.

    :func:`latest` gives the present state.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return running_means(stream, keys, value).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()


def latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key in a table that :func:`keep_running_changes` wrote."""
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_s"))
    return last.select(*keys, *[F.col("_s")[c].alias(c) for c in rest])


def running_state(batch: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``keys, total, n`` of a micro-batch, to be merged with :func:`terracell.operators.temporal.merge_running`."""
    return batch.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.count(value).alias("n"))


def keep_running_means(stream: DataFrame, keys: list[str], value: str, state_path: str, checkpoint: str):
    """Starts a query that merges each micro-batch into a table of sums and counts under ``state_path``.

    Each batch writes a new version named by its number, so a batch that is run again after a failure overwrites its own version.
    The version before is kept for that; older ones go.
    """
    from ..operators.temporal import merge_running

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = running_state(batch, keys, F.col(value))
        if number:
            state = merge_running(spark.read.parquet(f"{state_path}/version={number - 1}"), state, keys)
        state.write.mode("overwrite").parquet(f"{state_path}/version={number}")
        if number > 1:
            store.discard(spark, f"{state_path}/version={number - 2}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).start()
