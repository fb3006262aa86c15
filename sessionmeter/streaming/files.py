"""Closed log files as a stream.

The file source hands over each path once and whole, so all lines of a file arrive in one micro-batch
and the batch operators apply to it unchanged; no state has to live between batches. Lines that come piece by piece,
from a queue or as landed parts of a growing file, go through `streaming.state` instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionmeter.plans.store import DIALECTS, Store
from sessionmeter.sources.lines import LAYOUTS, LINE_BITS, START_STEP_BITS, is_codex_log

# Default and limits of the refresh interval in seconds; 0 turns it off.
REFRESH_DEFAULT, REFRESH_MIN, REFRESH_MAX = 30, 5, 3_600


def line_stream(spark: SparkSession, agent: str, root: str, files_per_trigger: int) -> DataFrame:
    """The lines of one agent's logs, by the same rules of place, depth and name as in batch."""
    below, options = LAYOUTS[agent]
    lines = (
        spark.readStream.options(**options).option("maxFilesPerTrigger", str(files_per_trigger))
        .text(root + below)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.unix_seconds(F.col("_metadata.file_modification_time")).alias("file_mtime"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_block_start").alias("block"),
            "value",
        )
    )
    return lines.where(is_codex_log(root)) if agent == "codex" else lines


def _ordered(batch: DataFrame) -> DataFrame:
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << LINE_BITS) - 1))
    order = F.shiftleft(F.shiftright("block", START_STEP_BITS), LINE_BITS) + row
    return batch.withColumn("ord", order).drop("block")


def run_batches(
    stream: DataFrame, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Write `work(batch)` of every micro-batch below `sink`; a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/stream_batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def stream_token_events(
    spark: SparkSession, agent: str, root: str, sink: str, checkpoint: str, files_per_trigger: int = 10_000
) -> StreamingQuery:
    dialect = DIALECTS[agent]
    stream = line_stream(spark, agent, root, files_per_trigger)
    return run_batches(stream, lambda lines: dialect.token_events(_ordered(lines)), sink, checkpoint)


def interval(seconds: int) -> int:
    return 0 if seconds == 0 else min(max(seconds, REFRESH_MIN), REFRESH_MAX)


def refresh_every(
    store: Store, roots: dict[str, str], checkpoint: str, seconds: int = REFRESH_DEFAULT,
    hermes_tables: Callable[[], tuple[DataFrame, DataFrame]] | None = None,
) -> StreamingQuery | None:
    """Refresh the store again and again; a slow refresh delays the next one, none overlap.

    `hermes_tables` gives the stored tables as they are at each refresh.
    """
    every = interval(seconds)
    if every == 0:
        return None

    def work(_batch: DataFrame, _batch_id: int) -> None:
        store.refresh(roots, hermes_tables() if hermes_tables else None)

    ticks = store.spark.readStream.format("rate").option("rowsPerSecond", "1").load()
    return (
        ticks.writeStream.option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{every} seconds")
        .foreachBatch(work)
        .start()
    )
