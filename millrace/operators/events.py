"""Reports over an at-least-once event feed: adoption, usage, reliability, durations, sessions, interruptions.

The feed has one row per event: ``event_id, kind, install_id, session_id, seq, started_seq, agent, outcome,
error_class, duration_ms, received_at`` and what else a report names. Redeliveries are removed first
(:func:`distinct_events`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.windows import running_min, running_total, top_per_group, value_at_rank

# Installs (or starts) needed before a rate is shown; hours before an open start counts as a crash.
MIN_FOR_RATE = 5
GRACE_HOURS = 24
FAILED = ("failed", "timeout")


def distinct_events(feed: DataFrame, key: str = "event_id") -> DataFrame:
    """One row per event; of several deliveries the first received is kept."""
    order = F.struct(F.col("received_at"), F.xxhash64(*feed.columns))
    kept = feed.groupBy(key).agg(F.min_by(F.struct(*[c for c in feed.columns if c != key]), order).alias("_e"))
    return kept.select(key, "_e.*")


def _rate(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part / whole, 1)


def adoption(feed: DataFrame) -> DataFrame:
    """Installs, events, the upper median and maximum per install, installs with a single event."""
    per = feed.where("install_id is not null").groupBy("install_id").agg(F.count("*").alias("c"))
    median = value_at_rank(per, "c", {"m": lambda n: F.floor(n / 2)}, descending=True).select("m").scalar()
    return per.agg(
        F.count("*").alias("installations"), F.sum("c").alias("events"), F.max("c").alias("events_per_install_max"),
        F.count_if(F.col("c") == 1).alias("single_event_installs"),
    ).withColumn("events_per_install_median", median)


def _completions(feed: DataFrame) -> DataFrame:
    return feed.where((F.col("kind") == "completed") & F.col("agent").isNotNull())


def capability_usage(feed: DataFrame) -> DataFrame:
    return _completions(feed).groupBy("agent").agg(
        F.count("*").alias("runs"), F.countDistinct("install_id").alias("installations"))


def reliability(feed: DataFrame) -> DataFrame:
    """Runs, failures and the commonest error per agent; the failure rate only from five installs on."""
    done = _completions(feed)
    failed = F.col("outcome").isin(*FAILED)
    per = done.groupBy("agent").agg(
        F.count("*").alias("runs"), F.count_if(failed).alias("failures"), F.countDistinct("install_id").alias("installations"))
    errors = done.where(failed).groupBy("agent", F.coalesce("error_class", F.lit("unknown")).alias("top_error")).agg(
        F.count("*").alias("n"))
    worst = top_per_group(errors, ["agent"], [F.desc("n"), F.asc("top_error")], 1).select("agent", "top_error")
    rate = F.when(F.col("installations") >= MIN_FOR_RATE, _rate(F.col("failures"), F.col("runs")))
    return per.join(worst, "agent", "left").withColumn("failure_rate_pct", rate)


def performance(feed: DataFrame) -> DataFrame:
    """Duration percentiles per agent by position, not by interpolation."""
    def at(share):
        return lambda n: F.least(F.floor(n * F.lit(share)), n - 1)

    timed = feed.where("agent is not null and duration_ms is not null")
    spots = {"p50_ms": at(0.5), "p95_ms": at(0.95), "max_ms": lambda n: n - 1}
    return value_at_rank(timed, "duration_ms", spots, ["agent"]).withColumnRenamed("n", "samples")


def environments(feed: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, value, n) over each install's first record."""
    order = F.struct("received_at", "event_id")
    first = feed.where("kind = 'install' and install_id is not null").groupBy("install_id").agg(
        F.min_by(F.struct(*[F.col(d).cast("string").alias(d) for d in dimensions]), order).alias("e")).select("e.*")
    return distribution(first, dimensions)


def distribution(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    long = df.select(*[F.col(d).cast("string").alias(d) for d in dimensions]).unpivot([], list(dimensions), "dimension", "value")
    return long.where("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def data_shapes(feed: DataFrame) -> DataFrame:
    return distribution(feed.where("kind = 'dataset'"), ["row_count_bucket", "file_format", "sampled"])


def freshness(feed: DataFrame, now: Column, days: int = 7) -> DataFrame:
    older = F.col("received_at") < now - F.expr(f"interval {days} days")
    return feed.agg(F.count("*").alias("events_held"), F.count_if(~older).alias("received_lately"),
                    F.count_if(older).alias("older"))


def session_records(feed: DataFrame) -> DataFrame:
    known = F.col("kind").isin("started", "completed") & F.col("session_id").isNotNull() & (F.col("session_id") != "")
    return feed.where(known).withColumn("agent", F.coalesce("agent", F.lit("unknown")))


def unfinished(records: DataFrame, cutoff: Column) -> DataFrame:
    """Starts that no completion points back to, old enough to judge. Keys are (session, seq), so nothing piles up."""
    done = records.where("kind = 'completed'").select("session_id", F.col("started_seq").alias("seq")).distinct()
    starts = records.where("kind = 'started'").join(done, ["session_id", "seq"], "left_anti")
    return starts.where(F.col("received_at").isNull() | (F.col("received_at") <= cutoff))


def top_level_ms(records: DataFrame, **kw) -> DataFrame:
    """(session_id, total_ms): completions whose start was outermost.

    Depth is a running sum of +1 / -1 that never goes below zero; the clamped value is the sum minus the lowest sum so
    far when that is negative.
    """
    order = ["seq", "event_id"]
    step = F.when(F.col("kind") == "started", 1).otherwise(-1).cast("bigint")
    slim = records.select("session_id", "seq", "event_id", "kind", "started_seq", "duration_ms", step.alias("_step"))
    walked = running_total(slim, "_step", "_sum", order, ["session_id"], **kw)
    walked = running_min(walked, "_sum", "_low", order, ["session_id"], **kw)
    depth_after = F.col("_sum") - F.least(F.lit(0).cast("bigint"), F.col("_low"))
    outer = walked.where((F.col("kind") == "started") & (depth_after == 1)).select("session_id", F.col("seq").alias("started_seq")).distinct()
    done = walked.where("kind = 'completed'").join(outer, ["session_id", "started_seq"], "left_semi")
    return done.groupBy("session_id").agg(F.sum(F.coalesce("duration_ms", F.lit(0))).alias("total_ms"))


def sessions(feed: DataFrame, now: Column, limit: int = 20, **kw) -> DataFrame:
    """One row per session: starts, completions, failures, never finished, top-level time; the worst ``limit``."""
    records = session_records(feed)
    cutoff = now - F.expr(f"interval {GRACE_HOURS} hours")
    base = records.groupBy("session_id").agg(
        F.count_if(F.col("kind") == "started").alias("agents_started"),
        F.count_if(F.col("kind") == "completed").alias("agents_completed"),
        F.count_if((F.col("kind") == "completed") & ~F.col("outcome").eqNullSafe("success")).alias("failed"))
    lost = unfinished(records, cutoff).groupBy("session_id").agg(F.count("*").alias("never_finished"))
    out = base.join(lost, "session_id", "left").join(top_level_ms(records, **kw), "session_id", "left")
    out = out.fillna(0, ["never_finished", "total_ms"])
    return out.orderBy(F.desc("never_finished"), F.desc("failed"), "session_id").limit(limit)


def session_order(feed: DataFrame, chosen: DataFrame) -> DataFrame:
    """(session_id, position, agent): agents of the chosen sessions in the order they started, as rows."""
    starts = session_records(feed).where("kind = 'started'").join(chosen.select("session_id"), "session_id", "left_semi")
    w = Window.partitionBy("session_id").orderBy("seq", "event_id")
    return starts.select("session_id", F.row_number().over(w).alias("position"), "agent")


def interrupted(feed: DataFrame, now: Column) -> DataFrame:
    """Per agent, starts old enough to judge and how many never came back; the rate only from five starts on."""
    records = session_records(feed)
    cutoff = now - F.expr(f"interval {GRACE_HOURS} hours")
    old = records.where((F.col("kind") == "started") & (F.col("received_at").isNull() | (F.col("received_at") <= cutoff)))
    started = old.groupBy("agent").agg(F.count("*").alias("started"))
    lost = unfinished(records, cutoff).groupBy("agent").agg(F.count("*").alias("never_finished"))
    out = started.join(lost, "agent", "left").fillna(0, ["never_finished"])
    rate = F.when(F.col("started") >= MIN_FOR_RATE, _rate(F.col("never_finished"), F.col("started")))
    return out.withColumn("interrupted_pct", rate)


def first_installs(feed: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(batch, _first): each upload's first install record; the least of several parts' firsts is the first of the whole."""
    return feed.where("kind = 'install' and install_id is not null").groupBy(batch).agg(
        F.min(F.struct("seq", "event_id", "install_id")).alias("_first"))


def with_owner(feed: DataFrame, firsts: DataFrame, batch: str = "batch_id") -> DataFrame:
    return feed.join(firsts, batch, "left").withColumn("install_id", F.coalesce("install_id", "_first.install_id")).drop("_first")


def attributed(feed: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Events without an install id inherit their batch's, taken from its first install record."""
    return with_owner(feed, first_installs(feed, batch), batch)


def checked_events(feed: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``rejected``: the first rule a record breaks, null for a valid one."""
    reason = F.lit(None).cast("string")
    for name, valid in reversed(list(rules.items())):
        reason = F.when(~F.coalesce(valid, F.lit(False)), name).otherwise(reason)
    return feed.withColumn("rejected", reason)


def within_rate(feed: DataFrame, key: str, time: str, per_minute: int, tie: Sequence[str]) -> DataFrame:
    """Events a fixed calendar-minute limit lets through: the first ``per_minute`` of each key and minute."""
    minute = feed.withColumn("_minute", F.date_trunc("minute", F.col(time)))
    order = [F.asc(time), *[F.asc(c) for c in tie]]
    return top_per_group(minute, [key, "_minute"], order, per_minute, "_i").drop("_i", "_minute")


def retained(feed: DataFrame, time: str, now: Column, days: int) -> DataFrame:
    """What a retention run keeps."""
    return feed.where(F.col(time) >= now - F.expr(f"interval {days} days"))


def rollup(feed: DataFrame, time: str, every: str, by: Sequence[str], value: str) -> DataFrame:
    """Tumbling-window counts and sums; the same expression serves a batch and a stream."""
    cells = feed.groupBy(F.window(time, every), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return cells.select(F.col("window.start").alias("start"), *by, "n", "total")
