"""Readers with fixed schemas: a missing column reads as NULL and nothing is inferred."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake import schemas


def _read(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def scan_run_metrics(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.RUN_METRICS, fmt)


def decoded(column: str, schema: str, default: Column) -> Column:
    """JSON text as a typed value; text that cannot be read becomes the default."""
    return F.coalesce(F.from_json(column, schema), default)


def decode_run_details(df: DataFrame) -> DataFrame:
    findings = F.array().cast(schemas.FINDINGS_JSON)
    zeros = F.struct(*[F.lit(0).cast("long").alias(s) for s in ("critical", "high", "medium", "low", "info")])
    severity = F.from_json("severity_distribution", schemas.SEVERITY_JSON)
    readable = F.coalesce(*[severity[s] for s in ("critical", "high", "medium", "low", "info")]).isNotNull()
    return df.withColumns({
        "validation_failures": decoded("validation_failures", schemas.FINDINGS_JSON, findings),
        "llm_findings": decoded("llm_findings", schemas.FINDINGS_JSON, findings),
        "per_file_results": decoded("per_file_results", schemas.PER_FILE_JSON, F.array().cast(schemas.PER_FILE_JSON)),
        "severity_distribution": F.when(readable, severity).otherwise(zeros),
        "source": F.coalesce("source", F.lit("pipeline")),
    })


def scan_run_details(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored runs with their JSON columns decoded."""
    return decode_run_details(_read(spark, path, schemas.RUN_DETAILS, fmt))


def scan_training(spark: SparkSession, records: str, feedback: str, labels: str | None = None,
                  fmt: str = "parquet") -> dict[str, DataFrame]:
    out = {
        "records": _read(spark, records, schemas.TRAINING_RECORDS, fmt),
        "feedback": _read(spark, feedback, schemas.TRAINING_FEEDBACK, fmt),
    }
    if labels:
        out["labels"] = _read(spark, labels, schemas.TRAINING_LABELS, fmt)
    return out


def _below(path: str, folder: str) -> list[str] | None:
    """The parts of ``path`` below ``folder``, if whatever they match is read with the folder; None if that is not certain.

    A folder's hidden files (``.x``, ``_x``) are left out when it is read, so each part must begin with another plain letter.
    """
    parts = path[len(folder):].strip("/").split("/")
    plain = all(p and p[0] not in "._" and p[0] not in _GLOB for p in parts)
    return parts if plain and not set("{}\\").intersection(path) else None


def _finds(spark: SparkSession, folder: str, parts: list[str]) -> bool:
    """Whether the glob ``parts`` find anything below ``folder``; stops at the first match."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(folder)
    store = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def found(at, parts: list[str]) -> bool:
        if not parts:
            return store.exists(at)
        if not store.isDirectory(at):
            return False
        if not _GLOB.intersection(parts[0]):
            return found(hadoop.Path(f"{at.toString()}/{parts[0]}"), parts[1:])
        matches = store.listStatus(at, hadoop.GlobFilter(parts[0]))
        return any(len(parts) == 1 or found(m.getPath(), parts[1:]) for m in matches)

    return found(top, parts)


def _separate(spark: SparkSession, paths: list[str]) -> list[str]:
    """``paths`` without those below another one, which add no file but would have all their names listed again.

    A path that finds nothing stays, so Spark reports it.
    """
    folders = {f for p in paths if (f := p.rstrip("/")) and f[-1] != ":" and not _GLOB.intersection(f)}

    def covered(path: str) -> bool:
        above = [f for f in accumulate(path.split("/")[:-1], "{}/{}".format) if f in folders]
        return any((parts := _below(path, f)) and _finds(spark, f, parts) for f in above)

    return [p for p in paths if not covered(p)]


def _for_small_files(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` whose tasks read as many small files as are worth a task."""
    session = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for key, value in SMALL_FILES.items():
        session.conf.set(key, value)
    return session


def scan_source_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Text files below files, folders or globs; one row per file, duplicates removed.

    A folder is read recursively.  Paths keep the form the file system reports.
    """
    reader = _for_small_files(spark).read.option("recursiveFileLookup", "true")
    # Paths may overlap: Spark's list of the files below them has each path once, so no text is shuffled to find the twins.
    text = reader.text(_separate(spark, paths), wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def scan_review_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Review results, one JSON document per file (or per line), flattened for ``review_to_metric``."""
    raw = spark.read.schema(schemas.REVIEW_RESULT).json(path, multiLine=multi_line)
    return raw.select(
        "workflow_run_id", "repository", F.col("timestamp").alias("ts"),
        F.coalesce("summary.totalFiles", F.lit(0)).alias("total_files"),
        F.col("summary.totalIssues").alias("total_issues"),
        F.col("summary.criticalCount").alias("critical_count"),
        F.col("summary.highCount").alias("high_count"),
        F.coalesce("summary.passThreshold", F.lit(False)).alias("pass_threshold"),
        F.col("tokenUsage.inputTokens").alias("input_tokens"),
        F.col("tokenUsage.outputTokens").alias("output_tokens"),
        F.col("tokenUsage.model").alias("model"), "duration",
    )


def conform(df: DataFrame, schema: str, defaults: dict | None = None) -> DataFrame:
    """Bring an older table to ``schema``: new columns get their default, types are aligned.

    A default also replaces NULL in a column that exists, as an added column with a default does.
    """
    defaults = defaults or {}
    target = df.sparkSession.createDataFrame([], schema).schema
    columns = []
    for field in target:
        value = F.col(field.name).cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        columns.append(value.alias(field.name))
    return df.select(*columns)


def scan_versions(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """One scan of a folder whose files were written under several versions of a table, as rows of ``schema``.

    The files' schemas are merged, so a column that some files lack is null in their rows and gets its default.
    """
    return conform(spark.read.option("mergeSchema", "true").parquet(path), schema, defaults)


# Defaults of columns added after the first release.
METRIC_DEFAULTS = {"cost_usd": 0.0, "source": "pipeline"}

# Characters with a meaning in a glob.
_GLOB = frozenset("*?[]{}\\")

# For source files, of which there are many small ones: Spark counts 4 MB for opening one, which makes a task of a few files.  The
# files of a task lie on many hosts, so their hosts, half of what the driver keeps of a file, are of no use.
SMALL_FILES = {"spark.sql.files.openCostInBytes": "64k", "spark.sql.sources.ignoreDataLocality": "true"}
