"""Reviewer feedback, outcome labels, dataset export and dashboard statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.jsnum import share_pct
from reviewlake.operators.filters import matching
from reviewlake.operators.skew import CHUNK, nested
from reviewlake.operators.validation import ACTIONS, CHANNELS
from reviewlake.session import local_table

# Label classes and page sizes.
LABELS = ("correct", "false_positive", "false_negative", "partial")
EXPORT_PAGE = 500
LIST_PAGE = 50


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """Per record: accepted, rejected and modified findings, and the gate votes.

    Rows without a finding type count as findings.
    """
    gate = F.col("finding_type").eqNullSafe("gate")
    action = F.col("action")
    return feedback.groupBy("record_id").agg(
        F.count_if(~gate & (action == "accept")).alias("true_positives"),
        F.count_if(~gate & (action == "reject")).alias("false_positives"),
        F.count_if(~gate & (action == "modify")).alias("false_negatives"),
        F.count_if(gate & (action == "accept")).alias("gate_accepts"),
        F.count_if(gate).alias("gate_totals"),
    )


def outcome_labels(counts: DataFrame) -> DataFrame:
    """Precision, recall, gate verdict, reward and label; NULL where a denominator is zero."""
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    gate = F.when(F.col("gate_totals") > 0, F.when(F.col("gate_accepts") == F.col("gate_totals"), 1).otherwise(0))
    judged = (tp + fp > 0) | (fn > 0)
    label = (
        F.when(judged & (fp == 0) & (fn == 0), "correct")
        .when(judged & (tp == 0) & (fn == 0), "false_positive")
        .when(judged & (tp == 0) & (fp == 0), "false_negative")
        .when(judged, "partial")
        .when(gate == 1, "correct")
        .when(gate == 0, "false_positive")
    )
    return counts.select(
        *[c for c in counts.columns if c not in ("gate_accepts", "gate_totals")],
        F.try_divide(tp, tp + fp).alias("precision_score"),
        F.try_divide(tp, tp + fn).alias("recall_score"),
        gate.alias("gate_correct"),
        F.try_divide(tp - fp, tp + fp).alias("rl_reward"),
        label.alias("supervised_label"),
    )


def labels_of(feedback: DataFrame) -> DataFrame:
    return outcome_labels(feedback_counts(feedback))


def record_lookup(df: DataFrame, records: DataFrame) -> DataFrame:
    """Add the record id of each run id; runs without a record are dropped."""
    return df.join(records.select("run_id", F.col("id").alias("record_id")), "run_id")


def _records_page(records: DataFrame, equal: dict, ts_from, ts_to, limit: int | None, offset: int) -> DataFrame:
    chosen = matching(records, equal, "created_at", ts_from, ts_to)
    if limit is None:
        return chosen
    return chosen.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def training_export(records: DataFrame, labels: DataFrame, feedback: DataFrame, *, labeled: bool = False,
                    model_version=None, repository=None, ts_from=None, ts_to=None,
                    limit: int | None = EXPORT_PAGE, offset: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Self-contained records: record columns, ``human_feedback`` array and ``outcome_labels`` struct.

    The page is taken before the joins, so only its feedback is collected.  ``limit=None`` exports
    everything.  A record with more than ``chunk`` feedback rows comes in ``parts`` rows; the union
    of their arrays is its feedback.
    """
    chosen = records
    if labeled:
        chosen = training_export_labeled(chosen, feedback)
    equal = {"model_version": model_version, "repository": repository}
    chosen = _records_page(chosen, equal, ts_from, ts_to, limit, offset)
    order = ["created_at", "finding_index", "finding_type", "action", "feedback_channel", "reviewer_id"]
    wanted = feedback.join(chosen.select(F.col("id").alias("record_id")), "record_id", "left_semi") if limit else feedback
    given = nested(wanted, ["record_id"], F.struct(*order), "human_feedback", order, chunk)
    label = F.when(F.col("supervised_label").isNotNull(), F.struct(
        "true_positives", "false_positives", "false_negatives",
        F.col("precision_score").alias("precision"), F.col("recall_score").alias("recall"),
        F.coalesce(F.col("gate_correct") == 1, F.lit(False)).alias("gate_correct"),
        "rl_reward", "supervised_label",
    ))
    # Labels are one row per record; feedback is one row per record and part.
    return (
        chosen.join(labels.withColumnRenamed("record_id", "id"), "id", "left")
        .join(given.withColumnRenamed("record_id", "id"), "id", "left")
        .select(
            *[chosen[c] for c in chosen.columns],
            F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"),
            F.coalesce("human_feedback", F.array().cast(given.schema["human_feedback"].dataType)).alias("human_feedback"),
            label.alias("outcome_labels"),
        )
    )


def training_export_labeled(records: DataFrame, feedback: DataFrame) -> DataFrame:
    """Records with at least one feedback row."""
    seen = feedback.select(F.col("record_id").alias("id")).distinct()
    return records.join(seen, "id", "left_semi")


def training_records_list(records: DataFrame, labels: DataFrame, feedback: DataFrame, *, repository=None,
                          labeled: bool = False, ts_from=None, ts_to=None,
                          limit: int | None = LIST_PAGE, offset: int = 0) -> DataFrame:
    """Light list with the number of feedback rows; ``labeled`` means a label exists."""
    counts = feedback.groupBy(F.col("record_id").alias("id")).agg(F.count("*").alias("feedback_count"))
    chosen = records
    if labeled:
        chosen = chosen.join(labels.where("supervised_label IS NOT NULL").select(F.col("record_id").alias("id")),
                             "id", "left_semi")
    chosen = _records_page(chosen, {"repository": repository}, ts_from, ts_to, limit, offset)
    kept = labels.select(
        F.col("record_id").alias("id"), "supervised_label", "precision_score", "recall_score", "rl_reward",
        "true_positives", "false_positives", "false_negatives",
    )
    return chosen.join(counts, "id", "left").join(kept, "id", "left").withColumn(
        "feedback_count", F.coalesce("feedback_count", F.lit(0))
    )


def training_stats_totals(records: DataFrame, labels: DataFrame, feedback: DataFrame) -> DataFrame:
    """Row counts of the three tables and the mean precision, recall and reward, in one aggregation."""
    none = F.lit(None).cast("double")
    scores = ("precision_score", "recall_score", "rl_reward")
    rows = (
        records.select(F.lit("r").alias("kind"), *[none.alias(c) for c in scores])
        .unionByName(feedback.select(F.lit("f").alias("kind"), *[none.alias(c) for c in scores]))
        .unionByName(labels.select(F.lit("l").alias("kind"), *scores))
    )
    return rows.agg(
        F.count_if(F.col("kind") == "r").alias("total_records"),
        F.count_if(F.col("kind") == "l").alias("labeled_records"),
        F.count_if(F.col("kind") == "f").alias("total_feedback"),
        F.avg("precision_score").alias("avg_precision"),
        F.avg("recall_score").alias("avg_recall"),
        F.avg("rl_reward").alias("avg_rl_reward"),
    )


def _distribution(df: DataFrame, column: str, domain: tuple[str, ...], total: DataFrame | None = None) -> DataFrame:
    """Counts and shares per value: every domain value has a row, other values keep theirs."""
    counts = df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("cnt"))
    keys = local_table(df.sparkSession, [(k,) for k in domain], "key string")
    filled = keys.join(counts, "key", "full_outer").select("key", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    # The rows are one per distinct value, so this window is over a handful of rows.
    whole = F.sum("cnt").over(Window.partitionBy())
    return filled.withColumn("share", share_pct(F.col("cnt"), whole))


def feedback_by_channel(feedback: DataFrame) -> DataFrame:
    return _distribution(feedback, "feedback_channel", CHANNELS)


def feedback_by_action(feedback: DataFrame) -> DataFrame:
    return _distribution(feedback, "action", ACTIONS)


def label_distribution(labels: DataFrame) -> DataFrame:
    """Counts per label; the share is of all label rows, including those without a label."""
    counted = _distribution(labels, "supervised_label", LABELS)
    return counted.where(F.col("key").isNotNull())


def model_drift(records: DataFrame, labels: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Precision, recall and false-positive rate per model version against the version before.

    Versions are ordered by first use.  An alert fires when precision drops, or the false-positive
    rate rises, by more than ``threshold``.
    """
    scored = records.join(labels.withColumnRenamed("record_id", "id"), "id", "left")
    per_version = scored.groupBy("model_version").agg(
        F.min("created_at").alias("first_seen"),
        F.coalesce(F.sum("true_positives"), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("false_positives"), F.lit(0)).alias("fp"),
        F.coalesce(F.sum("false_negatives"), F.lit(0)).alias("fn"),
    ).select(
        "model_version", "first_seen",
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"),
        F.try_divide("fp", F.col("tp") + F.col("fp")).alias("fp_rate"),
    )
    # One row per model version is left.
    before = Window.orderBy("first_seen", "model_version")
    drift = per_version.withColumns({
        "d_precision": F.col("precision") - F.lag("precision").over(before),
        "d_fp_rate": F.col("fp_rate") - F.lag("fp_rate").over(before),
    })
    alert = (F.col("d_precision") < -threshold) | (F.col("d_fp_rate") > threshold)
    return drift.withColumn("alert", F.coalesce(alert, F.lit(False)))
