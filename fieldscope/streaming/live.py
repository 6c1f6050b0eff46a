"""Structured Streaming over growing trace output and arriving mutation results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.operators.trace import parse_trace


def stream_trace(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Parsed trace events of new files.

    Each line is ``<run>\\t<line number>\\t<trace line>``, as a log shipper tags it.
    ``seen_at`` is the file time, used as event time.
    """
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    tagged = raw.select(
        F.regexp_extract("value", r"^([^\t]*)\t", 1).alias("run_id"), F.regexp_extract("value", r"^[^\t]*\t(\d+)\t", 1).try_cast("int").alias("line_no"),
        F.regexp_replace("value", r"^[^\t]*\t\d+\t", "").alias("line"), F.col("_metadata.file_modification_time").alias("seen_at"),
    )
    return parse_trace(tagged)


def stream_run_features(events: DataFrame, delay: str = "1 hour", span: str = "1 day") -> DataFrame:
    """Running counts per run over already selected lines; windows of file time let old state expire.

    Add up the windows of a run for its totals.
    """
    inst = F.col("kind") == "Instruction"
    return events.withWatermark("seen_at", delay).groupBy(F.window("seen_at", span), "run_id").agg(
        F.count_if(inst).alias("instr_count"), F.count_if(F.col("kind") == "BasicBlock").alias("bb_exec_total"),
        F.count_if(inst & F.col("mnemonic").isin("cmp", "test")).alias("cmp_count"), F.count_if(inst & F.col("branch").isNotNull()).alias("branch_parsed"),
        F.count_if(inst & F.col("loop")).alias("loop_instruction_count"), F.count_if(F.col("kind") == "Other").alias("bad_lines"),
        F.count_if(F.col("kind") == "Taint").alias("taint_marks"),
    )


def stream_dedupe(payloads: DataFrame, keys: Sequence[str], event_time: str = "seen_at", delay: str = "1 hour") -> DataFrame:
    """Each (field, payload) once within the watermark."""
    return payloads.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available now into parquet; update mode keeps one file set per batch."""
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        # A repeated batch overwrites its own folder, so a retry leaves no second copy.
        save = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/part={batch}")
        q = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
