"""Continuous forms of the ingestion jobs.

Every job takes a streaming DataFrame and returns a started query.  Sinks that replace rows store
one partition per run and micro-batch (see ``write_batch``), so a replayed batch gives the same table and
a run with a fresh checkpoint adds to a table instead of replacing its first batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from reviewlake.operators.feedback import feedback_counts, outcome_labels
from reviewlake.operators.metrics import Prices, summary_groups, summary_of_groups, token_cost
from reviewlake.operators.validation import (
    metric_reject_reason,
    normalise_metrics,
    normalise_runs,
    run_reject_reason,
)
from reviewlake.operators.webhook import classify_events, split_events
from reviewlake.sources.pricing import price_rows
from reviewlake.sources.sinks import BUCKETS, read_stored, run_name, unseen_keys, write_batch


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_ingest_metrics(source: DataFrame, pricing: DataFrame | Prices, path: str, rejects: str, checkpoint: str,
                          available_now: bool = True) -> StreamingQuery:
    """Validated and completed metric rows to ``path``, rejected rows with a reason to ``rejects``.

    Both outputs of a micro-batch come from one cached read of it.
    """

    run = run_name(source.sparkSession, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = batch.withColumn("reject_reason", metric_reject_reason()).persist()
        valid = checked.where("reject_reason IS NULL").drop("reject_reason")
        write_batch(normalise_metrics(valid, pricing), path, batch_id, run)
        write_batch(checked.where("reject_reason IS NOT NULL"), rejects, batch_id, run)
        checked.unpersist()

    return _start(source.writeStream.foreachBatch(write), checkpoint, available_now)


def stream_upsert_runs(source: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Valid runs, completed with defaults; read with ``read_latest(path, 'run_id', ['ingest_seq'])``."""
    valid = source.where(run_reject_reason().isNull())

    run = run_name(source.sparkSession, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(normalise_runs(batch), path, batch_id, run)

    return _start(valid.writeStream.foreachBatch(write), checkpoint, available_now)


def stream_feedback_labels(source: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Labels follow the feedback: counts per record are state, each changed record is written again.

    Read the current labels with ``read_latest(path, 'record_id')``.
    """
    labels = outcome_labels(feedback_counts(source))

    run = run_name(source.sparkSession, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id, run)

    return _start(labels.writeStream.outputMode("update").foreachBatch(write), checkpoint, available_now)


def stream_webhook_feedback(source: DataFrame, records: DataFrame, path: str, ignored: str, checkpoint: str,
                            available_now: bool = True) -> StreamingQuery:
    """Webhook posts to feedback rows; posts that are not used go to ``ignored`` with a reason."""

    run = run_name(source.sparkSession, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = classify_events(batch, records).persist()
        feedback, unused = split_events(seen)
        write_batch(feedback, path, batch_id, run)
        write_batch(unused, ignored, batch_id, run)
        seen.unpersist()

    return _start(source.writeStream.foreachBatch(write), checkpoint, available_now)


def stream_metrics_windowed(source: DataFrame, path: str, checkpoint: str, prices: Prices | None = None, window: str = "1 day",
                            delay: str = "1 day", available_now: bool = True) -> StreamingQuery:
    """All summary measures per tumbling window of event time, below ``path``; read with ``read_windows`` and ``read_late``.

    The state is a table: each micro-batch stores its sums per (window, repository, project), which add up, so the distinct counts
    stay exact and a replayed batch replaces its own.  The watermark of a batch is the latest event time of all batches before it
    less ``delay``; a row whose window has ended by then is late: it goes to the side table and changes no window.
    """
    spark = source.sparkSession
    run = run_name(spark, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        others = read_stored(spark, f"{path}/marks", MARKS).where(~((F.col("run") == run) & (F.col("batch_id") == batch_id)))
        mark = others.agg((F.max("latest") - F.expr(f"interval {delay}")).alias("mark")).first().mark
        late = F.coalesce(F.window("ts", window)["end"] <= F.lit(mark).cast("timestamp"), F.lit(False))
        rows = rows.withColumn("late", late).persist()
        on_time = token_cost(rows.where(~F.col("late")).drop("late"), prices or price_rows())
        on_time = on_time.withColumn("window_start", F.window("ts", window)["start"])
        write_batch(summary_groups(on_time, ["window_start"]), f"{path}/sums", batch_id, run)
        write_batch(rows.where("late").drop("late"), f"{path}/late", batch_id, run)
        write_batch(rows.agg(F.max("ts").alias("latest")), f"{path}/marks", batch_id, run)
        rows.unpersist()

    return _start(source.writeStream.foreachBatch(write), checkpoint, available_now)


MARKS = "latest timestamp, run string, batch_id long"


def read_windows(spark: SparkSession, path: str, window: str = "1 day", closed_after: str | None = None) -> DataFrame:
    """One row per window with all summary measures.  With ``closed_after`` (the delay) only windows that can't change any more."""
    found = summary_of_groups(spark.read.parquet(f"{path}/sums"), ["window_start"])
    if closed_after is None:
        return found
    latest = spark.read.schema(MARKS).parquet(f"{path}/marks").agg((F.max("latest") - F.expr(f"interval {closed_after}")).alias("mark"))
    return found.where(F.col("window_start") + F.expr(f"interval {window}") <= latest.scalar())


def read_late(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows that came after their window had ended; ``schema`` is that of the source."""
    fields = [f for f in schema.fields if f.name != "ts"]
    return read_stored(spark, f"{path}/late", T.StructType([*fields, T.StructField("ts", T.TimestampType())]))


def stream_dedupe_records(source: DataFrame, path: str, checkpoint: str, key: str = "run_id", order: str = "ingest_seq",
                          buckets: int = BUCKETS, available_now: bool = True) -> StreamingQuery:
    """The first write per key wins, however far apart the writes are, also from another run over the same table.

    A micro-batch keeps its first row per key by ``order`` and leaves out keys that any other batch has stored: the stored
    table, bucketed by key, is the state.  A replayed batch leaves itself out and writes the same rows again.
    """
    run = run_name(source.sparkSession, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(unseen_keys(batch, path, batch_id, run, key, order, buckets), path, batch_id, run, ("bucket",))

    return _start(source.writeStream.foreachBatch(write), checkpoint, available_now)
