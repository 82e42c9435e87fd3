"""A stream gives the same rows whatever the order of its files and the number of its micro-batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import events as E
from millrace.session import new_path
from millrace.streaming import ingest as I
from millrace.streaming import sessions as S


@pytest.fixture(scope="module")
def backlog(spark):
    """400 events of eight days in eight files; every file holds events of every day."""
    rnd = random.Random(3)
    zero = datetime(2024, 1, 1)
    rows = [(i, f"k{i % 3}" if i % 4 else "hot", zero + timedelta(minutes=rnd.randrange(8 * 1440)), float(i)) for i in range(400)]
    path = new_path(spark, "backlog")
    spark.createDataFrame(rows, "event_id long, k string, ts timestamp, v double").repartition(8, "event_id").write.parquet(path)
    return spark.read.parquet(path)


def replay(backlog, slices, make, mode="append"):
    path = new_path(backlog.sparkSession, "out")
    out = I.replayed(backlog, "ts", lambda stream, at: I.run_available(make(stream), path, at, mode), slices)
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("make", [
    lambda d: I.without_redeliveries(d.withColumn("c", F.explode(F.array(F.lit(1), F.lit(2)))).drop("c"), "event_id", "ts", "1 hour"),
    lambda d: S.activity_sessions(d, "k", "ts", "40 minutes", "5 minutes"),
    lambda d: S.first_event_limit(d.select("k", "event_id", (F.unix_micros("ts") / 1e6).alias("seconds")), "k", "seconds", 3, 7200.0),
])
def test_slices_do_not_change_the_rows(backlog, make):
    one = replay(backlog, 1, make)
    assert one and replay(backlog, 5, make) == one


def test_every_event_is_in_a_session_or_after_the_watermark(backlog):
    out = replay(backlog, 5, lambda d: S.activity_sessions(d, "k", "ts", "40 minutes", "5 minutes"))
    last = backlog.agg(F.max("ts")).first()[0]
    closed = [r for r in out if r[2] <= last - timedelta(minutes=5)]
    assert closed == out and sum(r[3] for r in out) >= 390


def test_first_event_limit_row_by_row(backlog):
    got = dict((r[1], r[3]) for r in replay(backlog, 4, lambda d: S.first_event_limit(
        d.select("k", "event_id", (F.unix_micros("ts") / 1e6).alias("seconds")), "k", "seconds", 3, 7200.0)))
    state, want = {}, {}
    for r in sorted(backlog.collect(), key=lambda r: (r["ts"], r["event_id"])):
        start, used = state.get(r["k"], (None, 0))
        if start is None or r["ts"] >= start + timedelta(hours=2):
            start, used = r["ts"], 0
        want[r["event_id"]] = used < 3
        state[r["k"]] = (start, used + (used < 3))
    assert got == want


def test_rollup_counts_every_event(backlog):
    path = new_path(backlog.sparkSession, "cells")
    out = I.replayed(backlog, "ts", lambda d, at: I.upserted_cells(
        E.rollup(d.withWatermark("ts", "1 hour"), "ts", "1 hour", ["k"], "v"), path, ["start", "k"], at), 5)
    assert out.agg(F.sum("n")).first()[0] == 400


def test_uploads_spread_over_micro_batches(backlog):
    spark = backlog.sparkSession
    feed = backlog.select(
        "event_id", F.col("event_id").alias("seq"), (F.col("event_id") % 5).alias("batch_id"), F.when(F.col("event_id") >= 390, "install").alias("kind"),
        F.when(F.col("event_id") >= 390, F.concat(F.lit("i"), F.col("event_id"))).alias("install_id"))
    path = new_path(spark, "uploads")
    feed.write.parquet(path)
    stream = I.file_stream(spark, path, "*.parquet", feed.schema, per_batch=1)
    out = I.attributed_batches(stream, new_path(spark, "attributed"))
    want = {i: f"i{i if i >= 390 else 390 + i % 5}" for i in range(400)}
    assert {r["event_id"]: r["install_id"] for r in out.collect()} == want


def test_no_events(spark):
    empty = spark.createDataFrame([], "event_id long, k string, ts timestamp, v double")
    assert replay(empty, 3, lambda d: I.without_redeliveries(d, "event_id", "ts", "1 hour")) == []
