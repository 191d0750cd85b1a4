"""Writers: appends, keyed upserts and dataset export."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.operators.skew import first_rows
from reviewlake.session import cut_lineage


def append_metrics(df: DataFrame, path: str, batch: str = "") -> None:
    """Append metric rows; a row without an id gets a hash of its identifying columns and its place among equal rows.

    ``batch`` names the ingest batch: a retry of a batch gives the same ids, equal posts of other batches others.
    """
    same = ["repository", "project_id", "workflow_run_id", "ts"]
    place = F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64(*[c for c in df.columns if c not in same])))
    key = F.xxhash64(*same, F.lit(batch), place)
    rows = df.withColumn("id", F.coalesce("id", key)) if "id" in df.columns else df.withColumn("id", key)
    rows.write.mode("append").parquet(path)


def append_by_day(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append rows in one folder per day; time ranges and newest-first pages then read only the days they need.

    Rows are dealt by ranges of time, so a quiet day makes one file and a busy one several, not one large task.
    """
    df.withColumn("day", F.to_date(ts)).repartitionByRange("day", ts).write.partitionBy("day").mode("append").parquet(path)


def append_feedback(df: DataFrame, path: str) -> None:
    """Append feedback rows; stored rows are never changed."""
    df.write.mode("append").parquet(path)


def _file_writer(folder: str, key: str, most: int):
    """Function for tasks: sorted (name, text) rows to files ``<key>=<name>.txt`` in folders of ``most`` files.

    A folder is filled under a hidden name and renamed when the task has all its rows, so a task that is tried again, or twice at
    once, leaves one set of files.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        last, file, files, folders = None, None, 0, []
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != last:
                    if file:
                        file.close()
                    if files % most == 0:
                        done = f"{part:05d}-{files // most:05d}"
                        folders.append((f"{folder}/_{done}-{attempt}", f"{folder}/folder={done}"))
                        os.makedirs(folders[-1][0])
                    file, last, files = open(f"{folders[-1][0]}/{key}={name}.txt", "wb"), name, files + 1
                if text.is_valid:
                    file.write(text.as_buffer())
                file.write(b"\n")
        if file:
            file.close()
        for filled, done in folders:
            try:
                os.rename(filled, done)
            except OSError:  # another try of this task was first
                if not os.path.isdir(done):
                    raise
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return write


def write_text_files(df: DataFrame, path: str, key: str, value: str) -> None:
    """One text file per whole-number ``key`` and partition, at ``<path>/folder=…/<key>=…``; rows of a key are lines of its file.

    Hadoop's local file system starts processes for the rights of each file that it makes, and Spark's committer renames one
    folder after another in the driver.  So tasks write to a ``file:`` path themselves; elsewhere Spark writes, a folder per task.
    """
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    at = store.makeQualified(target).toUri()
    if at.getScheme() == "file":
        if store.exists(target):
            raise FileExistsError(path)
        store.mkdirs(target)
        name = F.coalesce(F.col(key).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
        rows = df.sortWithinPartitions(key).select(name, F.col(value).cast("string"))
        rows.mapInArrow(_file_writer(at.getPath(), key, FILES_PER_FOLDER), "files long").agg(F.sum("files")).collect()
    else:
        rows = df.select(F.spark_partition_id().alias("folder"), key, F.col(value).alias("value"))
        rows.write.partitionBy("folder", key).text(path)


def upsert_last(existing: DataFrame, new: DataFrame, key: str = "run_id", order: str = "ingest_seq") -> DataFrame:
    """One row per key: the last write wins.

    Only the new rows are ranked.  A stored row stays unless a new row of its key is as late or later; a new row that is
    older than the stored one is dropped.
    """
    latest = first_rows(new, [key], [F.desc(order)], 1)
    held = existing.select(F.col(key).alias("_key"), F.col(order).alias("_order"))
    wins = latest.join(held, (F.col(key) == F.col("_key")) & (F.col("_order") > F.col(order)), "left_anti")
    kept = existing.join(wins.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")
    return kept.unionByName(wins, allowMissingColumns=True)


def insert_first(existing: DataFrame, new: DataFrame, key: str = "run_id", order: str = "ingest_seq") -> DataFrame:
    """New rows whose key is not stored yet; within the new rows the first write wins."""
    unseen = new.join(existing.select(key).distinct(), key, "left_anti")
    return first_rows(unseen, [key], [F.asc(order)], 1)


def replace_keys(existing: DataFrame, new: DataFrame, key: str = "record_id") -> DataFrame:
    """Rows of ``new`` replace the stored rows of the same keys."""
    kept = existing.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


# Files of a folder: few enough to be listed by one task of many.
FILES_PER_FOLDER = 1000

# Partitions of a keyed table, fixed when it is made: choose it so that one partition is some tasks' work.
BUCKETS = 16


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    """The partition of a key in a bucketed table."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_stored(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A table written before, or no rows if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_name(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint folder belongs to; later runs sort behind earlier ones.

    It is written into the folder once, so a restart from the folder goes on under the same name, and a fresh folder
    gets another name: its micro-batches, which count from 0 again, never replace those of an earlier run.
    """
    path = f"{checkpoint}/run-name"
    held = read_stored(spark, path, "name string").first()
    if held is None:
        spark.range(1).select(F.lit(f"r{time.time_ns() // 1_000_000:014d}-{uuid.uuid4().hex[:8]}").alias("name")).coalesce(1).write.mode("overwrite").parquet(path)
        held = spark.read.parquet(path).first()
    return held.name


def write_batch(df: DataFrame, path: str, batch_id: int, run: str = "", by: tuple[str, ...] = ()) -> None:
    """Store one micro-batch of a run as its own partition (below the columns ``by``): a replayed batch overwrites itself."""
    (
        (df.repartition(*by) if by else df).withColumns({"run": F.lit(run), "batch_id": F.lit(batch_id).cast("long")}).write.partitionBy(*by, "run", "batch_id")
        .option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    )


def read_latest(spark: SparkSession, path: str, key: str, order: list[str] | None = None) -> DataFrame:
    """Current rows of a table of batches: per key the last row by ``order``, then by run and batch."""
    ranked = [*[F.desc(c) for c in order or []], F.desc_nulls_last("run"), F.desc("batch_id")]
    return first_rows(spark.read.parquet(path), [key], ranked, 1).drop("run", "batch_id")


def touched(df: DataFrame, bucket: str = "bucket") -> list[int]:
    """Buckets that rows fall into: at most as many as the table has."""
    return [r[0] for r in df.select(bucket).distinct().collect()]


def upsert_table(new: DataFrame, path: str, key: str, order: str | None = None, buckets: int = BUCKETS) -> None:
    """Copy on write: the partitions of the new rows' keys are read, merged and written again; all others stay untouched.

    The last write wins by ``order``; without it the new rows replace the stored rows of their keys.  The merged rows
    are stored aside before the partitions are replaced, so a replay of the same rows gives the same table.
    """
    rows = cut_lineage(new.withColumn("bucket", bucket_of(key, buckets)))
    existing = read_stored(new.sparkSession, path, rows.schema).where(F.col("bucket").isin(touched(rows)))
    merged = upsert_last(existing, rows, key, order) if order else replace_keys(existing, rows, key)
    cut_lineage(merged.repartition("bucket")).write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def unseen_keys(batch: DataFrame, path: str, batch_id: int, run: str, key: str, order: str, buckets: int = BUCKETS) -> DataFrame:
    """The first row per key of a micro-batch, with its ``bucket``, without keys that any other batch has stored.

    Of the stored table, only the key column of the touched buckets is read.
    """
    first = first_rows(batch, [key], [F.asc(order)], 1).withColumn("bucket", bucket_of(key, buckets)).persist()
    kind = batch.schema[key].dataType.simpleString()
    stored = read_stored(batch.sparkSession, path, f"`{key}` {kind}, bucket int, run string, batch_id long")
    stored = stored.where(F.col("bucket").isin(touched(first)) & ~((F.col("run") == run) & (F.col("batch_id") == batch_id)))
    held = stored.select(F.col(key).alias("_held"))
    return first.join(held, F.col(key).eqNullSafe(F.col("_held")), "left_anti")


# Lines of one file of a text form: a compressed file is read by one task.
FILE_LINES = 100_000


def export_dataset(df: DataFrame, path: str, fmt: str = "jsonl", compression: str | None = None) -> None:
    """Write an export as JSON lines, Parquet, or one JSON document in text parts.

    No form has a bound: the parts of the document are written side by side, and its text is the parts one after another.
    ``compression`` (such as gzip) is for the text forms, which repeat every name in every record.
    """
    options = {"compression": compression or "none", "maxRecordsPerFile": FILE_LINES}
    if fmt == "jsonl":
        df.write.mode("overwrite").options(**options).json(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif fmt == "json":
        json_document(df).write.mode("overwrite").options(**options).text(path)
    else:
        raise ValueError(f"unknown format {fmt!r}: use jsonl, json or parquet")


def json_document(df: DataFrame) -> DataFrame:
    """Lines of ``{"count": n, "data": [...]}`` in order, the latest record first; the first record has no comma in front."""
    keys = [c for c in ("created_at", "id", "part") if c in df.columns]
    text = F.to_json(F.struct(*df.columns))
    place = F.struct(*[F.col(k) for k in keys], F.xxhash64(text).alias("hash"))
    records = df.select(place.alias("place"), text.alias("json"))
    totals = records.agg(F.count("*").alias("n"), F.to_json(F.max("place")).alias("first")).first()
    comma = F.when(F.to_json("place") == F.lit(totals["first"]), "").otherwise(",")
    body = records.select(F.lit(1).alias("section"), "place", F.concat(comma, "json").alias("value"))
    frame = df.sparkSession.createDataFrame(
        [(0, f'{{"count":{totals["n"]},"data":['), (2, "]}")], "section int, value string")
    frame = frame.select("section", F.lit(None).cast(body.schema["place"].dataType).alias("place"), "value")
    return frame.unionByName(body).orderBy("section", F.desc("place")).select("value")


def compact(spark: SparkSession, path: str, target: str, key: str, order: list[str] | None = None) -> None:
    """Write the current rows of a table of batches as one batch of a new table."""
    write_batch(read_latest(spark, path, key, order), target, 0)
