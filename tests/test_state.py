"""Tables that later writes meet again: streams with fresh checkpoints, upserts, layouts, running sums."""

import datetime
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reviewlake.operators import filters, metrics
from reviewlake.sources import sinks, tables
from reviewlake.streaming import jobs


def sent(spark, folder, schema, *batches):
    """Rows as files, one per micro-batch, read as a stream."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_first_writes_survive_a_fresh_checkpoint(spark, tmp_path):
    schema, table = "run_id string, ingest_seq int, v string", str(tmp_path / "t")
    first = sent(spark, str(tmp_path / "a"), schema, [("a", 1, "first"), ("b", 2, "first"), ("a", 3, "no")], [("b", 4, "no"), (None, 5, "first")])
    jobs.stream_dedupe_records(first, table, str(tmp_path / "c1")).awaitTermination()
    second = sent(spark, str(tmp_path / "b"), schema, [("a", 0, "later"), ("c", 1, "first")], [(None, 0, "later"), ("d", 2, "first")])
    jobs.stream_dedupe_records(second, table, str(tmp_path / "c2")).awaitTermination()
    rows = [(r.run_id, r.v) for r in spark.read.parquet(table).collect()]
    assert sorted(rows, key=str) == sorted([(k, "first") for k in ("a", "b", "c", "d", None)], key=str)
    # The same source again, once more with a fresh checkpoint: nothing new.
    jobs.stream_dedupe_records(second, table, str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(table).count() == 5


def test_a_replayed_batch_writes_the_same(spark, tmp_path):
    table, rows = str(tmp_path / "t"), lambda *r: spark.createDataFrame(r, "run_id string, ingest_seq int")
    for _ in range(2):
        new = sinks.unseen_keys(rows(("a", 1), ("b", 1)), table, 0, "r1", "run_id", "ingest_seq")
        sinks.write_batch(new, table, 0, "r1", ("bucket",))
    assert sorted(r.run_id for r in spark.read.parquet(table).collect()) == ["a", "b"]
    plan = sinks.unseen_keys(rows(("a", 9)), table, 1, "r1", "run_id", "ingest_seq")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "ReadSchema: struct<run_id:string>" in plan


def test_other_sinks_keep_what_an_earlier_run_stored(spark, tmp_path):
    schema = "run_id string, workflow_run_id string, status string, gate_status string, ingest_seq int"
    from reviewlake.sources.corpus import table

    posts = table(spark, "/root/testdata/sf0.001", "raw_runs").where("run_id IS NOT NULL").withColumn("ingest_seq", F.col("ts"))
    path = str(tmp_path / "runs")
    for n, part in enumerate((posts.where("run_id < 'run-3'"), posts.where("run_id >= 'run-3'"))):
        part.write.parquet(str(tmp_path / f"p{n}"))
        feed = spark.readStream.schema(posts.schema).parquet(str(tmp_path / f"p{n}"))
        jobs.stream_upsert_runs(feed, path, str(tmp_path / f"c{n}")).awaitTermination()
    from reviewlake.operators.validation import run_reject_reason

    assert schema and spark.read.parquet(path).count() == posts.where(run_reject_reason().isNull()).count()


def test_run_names(spark, tmp_path):
    a, b = sinks.run_name(spark, str(tmp_path / "a")), sinks.run_name(spark, str(tmp_path / "b"))
    assert a < b and sinks.run_name(spark, str(tmp_path / "a")) == a


def files_of(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("run_id"), F.lit(1).alias("ingest_seq"), F.lit("old").alias("v"))
    sinks.upsert_table(rows, path, "run_id", "ingest_seq", 64)
    before = files_of(path)
    new = spark.createDataFrame([("k1", 2, "new"), ("k2", 0, "older"), ("x", 1, "new"), ("x", 3, "newest")], "run_id string, ingest_seq int, v string")
    for _ in range(2):
        sinks.upsert_table(new, path, "run_id", "ingest_seq", 64)
    found = {r.run_id: r.v for r in spark.read.parquet(path).collect()}
    assert len(found) == 1001 and (found["k1"], found["k2"], found["x"]) == ("new", "old", "newest")
    kept = {f for f in files_of(path) if before.get(f)}
    assert len(before) - len(kept) <= 3 and len(kept) > 50


def test_late_rows_go_to_the_side(spark, tmp_path):
    day = lambda n, h=0: datetime.datetime(2024, 1, n, h)
    schema = ("id long, repository string, project_id string, ts timestamp_ntz, status string, model string, input_tokens long, output_tokens long, "
              "total_tokens long, request_count long, files_reviewed long, issues_found long, critical_count long, high_count long, latency_ms long")
    row = lambda i, ts, repo="a": (i, repo, "p", ts, "success", None, 1, 1, 2, 1, 1, 0, 0, 0, 10)
    feed = sent(spark, str(tmp_path / "s"), schema, [row(1, day(1)), row(2, day(3), "b")], [row(3, day(1, 5)), row(4, day(2, 23)), row(5, day(3), "c")],
                [row(6, day(2), "d"), row(7, day(5))], [row(8, day(3)), row(9, day(4, 1))])
    path = str(tmp_path / "w")
    jobs.stream_metrics_windowed(feed, path, str(tmp_path / "c"), delay="1 day").awaitTermination()
    # Watermarks: none, day 2, day 2, day 4.
    assert sorted(r.id for r in jobs.read_late(spark, path, feed.schema).collect()) == [3, 8]
    got = {r.window_start.day: (r.total_runs, r.repositories) for r in jobs.read_windows(spark, path).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (2, 2), 4: (1, 1), 5: (1, 1)}
    assert {r.window_start.day for r in jobs.read_windows(spark, path, closed_after="1 day").collect()} == {1, 2, 3}


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_running_totals(spark, partitions):
    """One source holds most rows; ranges cut it."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rng = random.Random(1)
    rows = [(rng.choice(["ide", "ide", "ide", None, "app"]), i // 3, i, rng.choice([None, 5, 9]), 1, rng.choice([None, "m"])) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, ts long, id long, input_tokens long, output_tokens long, model string")
    w = Window.partitionBy("source").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("source", "ts", "id", F.sum(F.coalesce("input_tokens", F.lit(0))).over(w).alias("total_input_tokens"),
                     F.sum("output_tokens").over(w).alias("total_output_tokens"), F.count("*").over(w).alias("call_count"),
                     F.coalesce("model", F.lit("")).alias("last_model"))
    got = metrics.running_token_totals(df)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pages_read_the_newest_days(spark, tmp_path):
    path = str(tmp_path / "t")
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, "r", "p", "ok", "ide" if i % 3 else "x", start + datetime.timedelta(hours=i)) for i in range(24 * 40)]
    df = spark.createDataFrame([*rows, (9999, "r", "p", "ok", "ide", None)], "id long, repository string, project_id string, status string, source string, ts timestamp_ntz")
    sinks.append_by_day(df, path)
    stored = spark.read.parquet(path)
    for kind in ({}, {"ts_from": "2024-01-03", "ts_to": "2024-01-20"}, {"limit": 5000}, {"limit": 3, "offset": 70}):
        got = [r.id for r in filters.filter_metrics(stored, source="ide", **kind).collect()]
        assert got == [r.id for r in filters.filter_metrics(df, source="ide", **kind).collect()] and got
    plan = filters.filter_metrics(stored, source="ide", limit=10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_two_versions_in_one_folder(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a")], "id long, repository string").write.parquet(path)
    spark.createDataFrame([(2, "b", 0.5, "ide"), (3, "c", None, None)], "id long, repository string, cost_usd double, source string").write.mode("append").parquet(path)
    out = tables.scan_versions(spark, path, "id long, cost_usd double, source string, branch string", tables.METRIC_DEFAULTS)
    assert sorted(map(tuple, out.collect())) == [(1, 0.0, "pipeline", None), (2, 0.5, "ide", None), (3, 0.0, "pipeline", None)]
