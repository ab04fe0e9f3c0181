"""Structured Streaming jobs: windowed features, scoring, log tails, dedupe, moderation, bounded state.

Every job writes through ``foreachBatch`` into a folder per micro-batch, so a replayed batch
overwrites its own output and a lost executor only costs a retry. State per key lives in the state
store (``streaming.state``): no table is rewritten.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions import text as tx
from vitalgrid.session import scratch_dir
from vitalgrid.sources.files import parse_feedback


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = 1) -> DataFrame:
    """Files of a folder as they arrive, some per batch; with no number, all that arrived since the last trigger."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_available(stream: DataFrame, out: str, mode: str = "append", write: Callable | None = None) -> None:
    """Drain the source once; each micro-batch lands in its own folder."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write or save)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_per_key(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Collapse update-mode output: the newest micro-batch wins for each key."""
    t = spark.read.parquet(f"{out}/data")
    rest = [c for c in t.columns if c not in keys and c != "batch_id"]
    best = t.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def feature_windows(
    stream: DataFrame, key: str, ts: str, metrics: Sequence[str], length: str = "5 minutes", delay: str = "10 minutes", names: Mapping[str, str] | None = None
) -> DataFrame:
    """Tumbling mean and sample deviation per metric, named <lower>_mean/_std and then renamed."""
    names = names or {}
    aggs = []
    for m in metrics:
        for stat, fn in (("mean", F.avg), ("std", F.stddev_samp)):
            name = f"{m.lower()}_{stat}"
            aggs.append(fn(m).alias(names.get(name, name)))
    src = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    return (
        src.groupBy(key, F.window(ts, length))
        .agg(F.count(F.lit(1)).alias("n"), *aggs)
        .withColumn("window_start", F.col("window.start"))
        .drop("window")
    )


def scored_batches(out: str, score: Callable[[DataFrame], DataFrame]) -> Callable:
    """For ``run_available``: every micro-batch is scored as a whole and written to its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/data/batch_id={batch_id}")

    return write


def rescored_feedback(lines: DataFrame) -> DataFrame:
    """Rated previews with their rule score, from new log lines."""
    ex = parse_feedback(lines)
    feats = ex.select("preview", "label", *[c.alias(n) for n, c in tx.response_features("preview").items()])
    return feats.select("preview", "label", tx.heuristic_score({n: F.col(n) for n in feats.columns}).alias("score"))


def first_messages(stream: DataFrame, ts: str, key: str, delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def moderated(stream: DataFrame) -> DataFrame:
    """Stateless flags on arriving turns."""
    return stream.select(
        "conv_id",
        "turn",
        tx.is_crisis("text").alias("crisis"),
        tx.is_soft_signal("text").alias("soft"),
        tx.language("text").alias("lang"),
        tx.is_trivial("text").alias("trivial"),
    )


def arrivals(df: DataFrame, path: str, conditions: Sequence, drain: Callable[[], None]) -> None:
    """Write the slices of a table one after another and drain the stream after each: every drain is a restart."""
    for cond in conditions:
        df.where(cond).write.mode("append").parquet(path)
        drain()


def stream_dir(spark: SparkSession, label: str) -> str:
    return scratch_dir(spark, label)
