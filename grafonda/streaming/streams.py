"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from grafonda.operators.state import allowed


def new_articles(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Articles from files as they arrive, so many files a batch; texts without a letter are left out."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).where(F.length(F.trim("text")) > 0)


def rate_limited(events: DataFrame, key: str, time: str, order: str, most: int, window: float) -> DataFrame:
    """(key, order, allowed) of a stream: at most `most` allowed events within `window` seconds per key.

    State is the times of allowed events, at most `most` of them a key. A batch is decided in order of
    time; a row that comes in a later batch is judged against the state as it then is.
    """
    kinds = dict(events.dtypes)
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean"

    def step(k, frames, state: GroupState):
        log = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(frames)).sort_values([time, order], kind="stable")
        decided, log = allowed([t.timestamp() for t in pdf[time]], most, window, log)
        state.update((log,))
        yield pd.DataFrame({key: pdf[key].to_numpy(), order: pdf[order].to_numpy(), "allowed": decided})

    return events.groupBy(key).applyInPandasWithState(step, out, "log array<double>", "append", GroupStateTimeout.NoTimeout)


def gauges(events: DataFrame, time: str, kind: str, value: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per window and kind; rows later than `late` are dropped, as a watermark does."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def upsert_into(path: str, key: str, order: str):
    """A foreachBatch sink that keeps the latest row per key in a Parquet table.

    Every batch writes a new version beside the old one and then names it current, so a batch that is
    repeated after a failure leaves the same table.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        versions = [s.getPath().getName() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path))] if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)) else []
        older = sorted(int(v[1:]) for v in versions if v.startswith("v") and v[1:].isdigit() and int(v[1:]) < epoch and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{v}/_SUCCESS")))
        rows = spark.read.parquet(f"{path}/v{older[-1]}").unionByName(batch) if older else batch
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{path}/v{epoch}")
        for v in older[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}"), True)

    return write
