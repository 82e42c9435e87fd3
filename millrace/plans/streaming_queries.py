"""Streams over the events table, run until nothing is left, and compared with the batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import events as E
from millrace.plans.event_queries import FEED, LOST, feed
from millrace.plans.registry import query
from millrace.session import new_path
from millrace.session import read_table as t
from millrace.sources import sinks as W
from millrace.streaming import ingest as I
from millrace.streaming import sessions as S


def _instants(rows):
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant


def _stream(spark, sf):
    return _instants(I.file_stream(spark, sf, "events.parquet", t(spark, sf, "events").schema))


@query("stream_without_redeliveries", "L1", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def stream_without_redeliveries(spark, sf):
    copies = F.explode(F.when(F.col("event_id") % 7 == 0, F.sequence(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1))))
    path = new_path(spark, "unique")

    def run(stream, checkpoint):
        delivered = _instants(stream).withColumn("copy", copies).drop("copy")
        return I.run_available(I.without_redeliveries(delivered, "event_id", "ts", "30 days"), path, checkpoint)

    out = I.replayed(t(spark, sf, "events"), "ts", run)
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("batch_without_redeliveries", "L1", "SELECT count(*) AS stored, sum(CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END)::BIGINT AS duplicates FROM events")
def batch_without_redeliveries(spark, sf):
    copies = F.explode(F.when(F.col("event_id") % 7 == 0, F.sequence(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1))))
    delivered = t(spark, sf, "events").withColumn("copy", copies).drop("copy").withColumnRenamed("ts", "received_at")
    kept = E.distinct_events(delivered)
    return kept.agg(F.count("*").alias("stored")).withColumn("duplicates", delivered.agg(F.count("*")).scalar() - F.col("stored"))


@query("stream_attribution", "L2", """
WITH f AS (SELECT event_id, strftime(ts, '%Y%m%d%H') AS batch_id, CASE WHEN event_id % 10 = 7 THEN 'i' || user_id END AS install_id FROM events),
 o AS (SELECT batch_id, arg_min(install_id, event_id) AS owner FROM f WHERE install_id IS NOT NULL GROUP BY 1)
SELECT coalesce(install_id, owner) AS install_id, count(*) AS n FROM f LEFT JOIN o USING (batch_id) GROUP BY 1
""")
def stream_attribution(spark, sf):
    k = F.col("event_id")
    # Every upload is spread over all eight files, and every file is a micro-batch of its own.
    spread = new_path(spark, "uploads")
    events = t(spark, sf, "events")
    events.repartition(8, "event_id").write.parquet(spread)
    f = _instants(I.file_stream(spark, spread, "*.parquet", events.schema, per_batch=1)).select(
        k, k.alias("seq"), F.date_format("ts", "yyyyMMddHH").alias("batch_id"), F.when(k % 10 == 7, "install").alias("kind"),
        F.when(k % 10 == 7, F.concat(F.lit("i"), F.col("user_id").cast("string"))).alias("install_id"))
    return I.attributed_batches(f, new_path(spark, "attributed")).groupBy("install_id").agg(F.count("*").alias("n"))


RULES_SQL = """
CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'error') THEN 'event_type' WHEN NOT value BETWEEN 0 AND 40 THEN 'value'
 WHEN (props->>'$.k')::BIGINT % 9 = 0 THEN 'props' END
"""


@query("stream_validation", "L3", f"SELECT {RULES_SQL} AS rejected, count(*) AS n FROM events GROUP BY 1")
def stream_validation(spark, sf):
    rules = {
        "event_type": F.col("event_type").isin("click", "view", "purchase", "error"), "value": F.col("value").between(0, 40),
        "props": F.get_json_object("props", "$.k").cast("bigint") % 9 != 0,
    }
    good, bad = new_path(spark, "valid"), new_path(spark, "rejected")
    I.validated(_stream(spark, sf), rules, good, bad)
    kept = spark.read.parquet(good).select(F.lit(None).cast("string").alias("rejected"))
    return kept.unionByName(spark.read.parquet(bad).select("rejected")).groupBy("rejected").agg(F.count("*").alias("n"))


@query("stream_lost_starts", "L4", FEED + """
, c AS (SELECT DISTINCT session_id, started_seq, received_at FROM feed WHERE kind = 'completed'), w AS (SELECT max(received_at) AS m FROM feed WHERE kind = 'started'),
 v AS (SELECT max(received_at) AS m FROM feed WHERE kind = 'completed')
SELECT s.event_id FROM feed s, w, v WHERE s.kind = 'started' AND s.received_at < least(w.m, v.m) - INTERVAL 25 HOUR AND NOT EXISTS
 (SELECT 1 FROM c WHERE c.session_id = s.session_id AND c.started_seq = s.seq AND c.received_at >= s.received_at AND c.received_at <= s.received_at + INTERVAL 24 HOUR)
""")
def stream_lost_starts(spark, sf):
    path = new_path(spark, "lost")

    def run(stream, checkpoint):
        rows = stream.withColumn("received_at", F.col("received_at").cast("timestamp"))
        lost = S.lost_starts(rows.where("kind = 'started'"), rows.where("kind = 'completed'"))
        return I.run_available(lost, path, checkpoint)

    return I.replayed(feed(spark, sf), "received_at", run).select("event_id")


@query("stream_activity_sessions", "L5", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events),
 s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g),
 a AS (SELECT user_id, i, max(ts) + INTERVAL 2 HOUR AS ends, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS n FROM a WHERE ends <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1
""")
def stream_activity_sessions(spark, sf):
    path = new_path(spark, "activity")

    def run(stream, checkpoint):
        return I.run_available(S.activity_sessions(_instants(stream), "user_id", "ts", "2 hours", "1 hour"), path, checkpoint)

    out = I.replayed(t(spark, sf, "events"), "ts", run)
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("fixed_window_rate_limit", "L6", """
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) AS i FROM events) WHERE i <= 1
""")
def fixed_window_rate_limit(spark, sf):
    return E.within_rate(t(spark, sf, "events"), "event_type", "ts", 1, ["event_id"]).select("event_id")


@query("stream_first_event_rate_limit", "L6", """
WITH RECURSIVE e AS (SELECT event_type, event_id, epoch_us(ts) / 1e6 AS s FROM events),
 w AS (SELECT event_type, min(s) AS start FROM e GROUP BY 1
  UNION ALL SELECT w.event_type, (SELECT min(s) FROM e WHERE e.event_type = w.event_type AND e.s >= w.start + 3600.0) FROM w
  WHERE EXISTS (SELECT 1 FROM e WHERE e.event_type = w.event_type AND e.s >= w.start + 3600.0)),
 r AS (SELECT e.event_type, row_number() OVER (PARTITION BY e.event_type, w.start ORDER BY e.s, e.event_id) <= 20 AS allowed
  FROM e ASOF JOIN w ON e.event_type = w.event_type AND e.s >= w.start)
SELECT event_type, count(*) FILTER (allowed) AS allowed, count(*) FILTER (NOT allowed) AS refused FROM r GROUP BY 1
""")
def stream_first_event_rate_limit(spark, sf):
    path = new_path(spark, "limited")

    def run(stream, checkpoint):
        rows = _instants(stream).select("event_type", "event_id", (F.unix_micros("ts") / 1e6).alias("seconds"))
        return I.run_available(S.first_event_limit(rows, "event_type", "seconds", 20, 3600.0), path, checkpoint)

    out = I.replayed(t(spark, sf, "events"), "ts", run)
    return out.groupBy("event_type").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


@query("retention_purge", "L7", """
SELECT event_type, count(*) AS n FROM events WHERE ts::DATE >= (SELECT max(ts)::DATE FROM events) - 10 GROUP BY 1
""")
def retention_purge(spark, sf):
    path, target = new_path(spark, "by-day"), new_path(spark, "kept")
    events = t(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    W.write_files(events, path, by=["day"])
    cutoff = events.agg(F.date_format(F.date_sub(F.max("ts").cast("date"), 10), "yyyy-MM-dd")).first()[0]
    return I.purge_days(spark, path, cutoff, target).groupBy("event_type").agg(F.count("*").alias("n"))


@query("retained_events", "L7", """
SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY 1
""")
def retained_events(spark, sf):
    events = t(spark, sf, "events")
    return E.retained(events, "ts", events.agg(F.max("ts")).scalar(), 10).groupBy("event_type").agg(F.count("*").alias("n"))


@query("incremental_export", "L8", """
SELECT 1 AS run, count(*) AS n FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 2, count(*) FROM events WHERE event_id % 2 = 1
""")
def incremental_export(spark, sf):
    source, state, target = (new_path(spark, n) for n in ("outbox", "cursor", "exported"))
    events = t(spark, sf, "events")
    counts = []
    for odd in (0, 1):
        events.where(F.col("event_id") % 2 == odd).write.mode("append").parquet(source)
        rows = I.file_stream(spark, source, "*.parquet", events.schema)
        counts.append(I.run_available(rows, target, state).agg(F.count("*").alias("n")))
    first = counts[0].first()["n"]
    return spark.createDataFrame([(1, first)], "run int, n bigint").unionByName(
        counts[1].select(F.lit(2).alias("run"), (F.col("n") - first).alias("n")))


@query("stream_rollup", "L9", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def stream_rollup(spark, sf):
    path = new_path(spark, "rollup")

    def run(stream, checkpoint):
        cells = E.rollup(_instants(stream).withWatermark("ts", "1 day"), "ts", "1 hour", ["event_type"], "value")
        return I.upserted_cells(cells, path, ["start", "event_type"], checkpoint)

    out = I.replayed(t(spark, sf, "events"), "ts", run)
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})


@query("batch_rollup", "L9", """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def batch_rollup(spark, sf):
    return E.rollup(t(spark, sf, "events"), "ts", "1 day", ["event_type"], "value").withColumn("total", F.round("total", 4))
