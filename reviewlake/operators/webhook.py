"""Webhook posts to feedback rows, with a reason for every post that is not used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.severity import lookup

BODY = (
    "action string, sender struct<login:string>, comment struct<body:string>, reaction struct<content:string>, "
    "review struct<state:string, body:string>"
)
# Marker of the review comment, run id patterns and the mapped reactions and states.
MARKER = "AI Code Review"
RUN_IN_COMMENT = r"Run:\s*`([^`]+)`"
RUN_IN_REVIEW = r"(?i)run(?:_id)?[:\s]+([a-zA-Z0-9\-_]+)"
REACTIONS = {"+1": "accept", "-1": "reject"}
STATES = {"approved": "accept", "changes_requested": "reject"}


def read_events(events: DataFrame) -> DataFrame:
    """Parsed posts: run id, action, channel and the first reason to ignore that needs no lookup."""
    p = events.withColumn("b", F.from_json("body", BODY))
    comment, review = F.col("event") == "issue_comment", F.col("event") == "pull_request_review"
    said = F.coalesce("b.comment.body", F.lit(""))
    run = F.when(comment, F.regexp_extract(said, RUN_IN_COMMENT, 1)).when(
        review, F.regexp_extract(F.coalesce("b.review.body", F.lit("")), RUN_IN_REVIEW, 1)
    )
    early = (
        F.when(comment & (~F.col("b.action").eqNullSafe("created") | F.col("b.comment").isNull()), "not a new comment")
        .when(comment & ~said.contains(MARKER), "not an AI review comment")
        .when(comment & (run == ""), "could not extract run_id from comment")
        .when(review & (run == ""), "no run_id in review body")
        .when(~(comment | review), F.concat(F.lit("event "), "event"))
    )
    none = F.lit(None).cast("string")
    return p.select(
        *events.columns, run.alias("run_id"), early.alias("early_reason"),
        F.when(comment, lookup(F.col("b.reaction.content"), REACTIONS, none))
        .when(review, lookup(F.col("b.review.state"), STATES, none)).alias("action"),
        F.when(comment, "unsupported reaction type")
        .when(review, F.concat(F.lit("review state "), "b.review.state", F.lit(" not mapped"))).alias("late_reason"),
        F.when(comment, F.concat(F.lit("GitHub reaction: "), "b.reaction.content"))
        .when(review, F.concat(F.lit("PR review: "), "b.review.state")).alias("reason"),
        F.col("b.sender.login").alias("reviewer_id"),
        F.when(comment, "gh").when(review, "pr").alias("feedback_channel"),
    )


def classify_events(events: DataFrame, records: DataFrame) -> DataFrame:
    """Every post with ``record_id`` or ``ignored_reason``."""
    known = records.select("run_id", F.col("id").alias("record_id"))
    read = read_events(events)
    # Posts that are ignored for what they say need no record; without them no null run id is left as a hot key.
    ignored = read.where(F.col("early_reason").isNotNull()).withColumn("record_id", F.lit(None).cast(known.schema["record_id"].dataType))
    joined = read.where(F.col("early_reason").isNull()).join(known, "run_id", "left").unionByName(ignored)
    reason = (
        F.when(F.col("early_reason").isNotNull(), F.col("early_reason"))
        .when(F.col("record_id").isNull(), F.concat(F.lit("no training record for run "), "run_id"))
        .when(F.col("action").isNull(), F.col("late_reason"))
    )
    return joined.withColumn("ignored_reason", reason).drop("early_reason", "late_reason")


def webhook_feedback(events: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gate-level feedback rows, ignored posts with their reason)."""
    return split_events(classify_events(events, records))


def split_events(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two halves of classified posts."""
    feedback = seen.where("ignored_reason IS NULL").select(
        "event_id", "record_id", "run_id", F.lit("gate").alias("finding_type"), "action", "reason",
        F.lit("[]").alias("corrected_findings"), "reviewer_id", "feedback_channel",
    )
    return feedback, seen.where("ignored_reason IS NOT NULL").select("event_id", "event", "ignored_reason")
