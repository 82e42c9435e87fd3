"""Event-feed reports on a feed derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import events as E
from millrace.plans.registry import query
from millrace.session import read_table as t

# The feed: a user is an install, a user's hour a session, positions count within the session.
FEED = """
WITH f AS (SELECT event_id, ts AS received_at, 'i' || user_id AS install_id, 'i' || user_id || '-' || strftime(ts, '%Y%m%d') AS session_id,
  row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS seq, event_type AS agent, value, user_id,
  CASE WHEN event_id % 2 = 0 THEN 'started' WHEN event_id % 10 = 7 THEN 'install' WHEN event_id % 10 = 9 THEN 'dataset' ELSE 'completed' END AS kind FROM events),
 feed AS (SELECT *, CASE WHEN kind = 'completed' THEN seq - 1 - event_id % 3 END AS started_seq,
  CASE WHEN kind = 'completed' THEN CASE event_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'timeout' ELSE 'success' END END AS outcome,
  CASE WHEN event_id % 7 = 0 THEN 'KeyError' END AS error_class, CASE WHEN kind = 'completed' THEN floor(value * 100)::BIGINT END AS duration_ms FROM f),
 stamp AS (SELECT max(ts) AS now FROM events)
"""


def feed(spark, sf) -> DataFrame:
    from millrace.operators.windows import row_numbers

    events = t(spark, sf, "events").withColumn("_day", F.date_format("ts", "yyyyMMdd"))
    e = row_numbers(events, "seq", ["ts", "event_id"], ["user_id", "_day"])
    k = F.col("event_id")
    kind = F.when(k % 2 == 0, "started").when(k % 10 == 7, "install").when(k % 10 == 9, "dataset").otherwise("completed")
    install = F.concat(F.lit("i"), F.col("user_id").cast("string"))
    e = e.select(k, F.col("ts").alias("received_at"), install.alias("install_id"),
                 F.concat(install, F.lit("-"), "_day").alias("session_id"), "seq", F.col("event_type").alias("agent"),
                 "value", "user_id", kind.alias("kind"))
    done = F.col("kind") == "completed"
    return e.withColumns({
        "started_seq": F.when(done, F.col("seq") - 1 - k % 3),
        "outcome": F.when(done, F.when(k % 7 == 0, "failed").when(k % 7 == 1, "timeout").otherwise("success")),
        "error_class": F.when(k % 7 == 0, "KeyError"),
        "duration_ms": F.when(done, F.floor(F.col("value") * 100)),
    })


def now(spark, sf):
    return t(spark, sf, "events").agg(F.max("ts")).scalar()


@query("adoption", "K1", FEED + """
, p AS (SELECT install_id, count(*) AS c FROM feed GROUP BY 1), l AS (SELECT list_reverse_sort(list(c)) AS v, count(*) AS n FROM p)
SELECT count(*) AS installations, sum(c)::BIGINT AS events, (SELECT v[n // 2 + 1] FROM l) AS events_per_install_median, max(c) AS events_per_install_max,
 count(*) FILTER (WHERE c = 1) AS single_event_installs FROM p
""")
def adoption(spark, sf):
    return E.adoption(feed(spark, sf))


@query("capability_usage", "K2", FEED + "SELECT agent, count(*) AS runs, count(DISTINCT install_id) AS installations FROM feed WHERE kind = 'completed' GROUP BY 1")
def capability_usage(spark, sf):
    return E.capability_usage(feed(spark, sf))


@query("reliability", "K3", FEED + """
, p AS (SELECT agent, count(*) AS runs, count(*) FILTER (WHERE outcome IN ('failed', 'timeout')) AS failures, count(DISTINCT install_id) AS installations FROM feed WHERE kind = 'completed' GROUP BY 1),
 e AS (SELECT agent, coalesce(error_class, 'unknown') AS top_error, row_number() OVER (PARTITION BY agent ORDER BY count(*) DESC, coalesce(error_class, 'unknown')) AS i
  FROM feed WHERE kind = 'completed' AND outcome IN ('failed', 'timeout') GROUP BY 1, 2)
SELECT p.*, top_error, CASE WHEN installations >= 5 THEN round(100.0 * failures / runs, 1) END::DOUBLE AS failure_rate_pct FROM p LEFT JOIN e ON p.agent = e.agent AND i = 1
""")
def reliability(spark, sf):
    return E.reliability(feed(spark, sf))


@query("performance", "K4", FEED + """
, l AS (SELECT agent, list_sort(list(duration_ms)) AS v, count(*) AS samples FROM feed WHERE duration_ms IS NOT NULL GROUP BY 1)
SELECT agent, samples, v[least(floor(0.5 * samples), samples - 1)::BIGINT + 1] AS p50_ms, v[least(floor(0.95 * samples), samples - 1)::BIGINT + 1] AS p95_ms, v[samples] AS max_ms FROM l
""")
def performance(spark, sf):
    return E.performance(feed(spark, sf))


@query("environments", "K5", FEED + """
, r AS (SELECT install_id, agent AS os, (user_id % 4)::VARCHAR AS cpu_count, row_number() OVER (PARTITION BY install_id ORDER BY received_at, event_id) AS i FROM feed WHERE kind = 'install')
SELECT 'os' AS dimension, os AS value, count(*) AS n FROM r WHERE i = 1 GROUP BY 2 UNION ALL SELECT 'cpu_count', cpu_count, count(*) FROM r WHERE i = 1 GROUP BY 2
""")
def environments(spark, sf):
    f = feed(spark, sf).withColumns({"os": F.col("agent"), "cpu_count": F.col("user_id") % 4})
    return E.environments(f, ["os", "cpu_count"])


@query("data_shapes", "K6", FEED + """
, d AS (SELECT CASE WHEN value <= 10 THEN '0-10' ELSE '10+' END AS b, agent AS f, (event_id % 3 = 0)::VARCHAR AS s FROM feed WHERE kind = 'dataset')
SELECT 'row_count_bucket' AS dimension, b AS value, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'file_format', f, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'sampled', s, count(*) FROM d GROUP BY 2
""")
def data_shapes(spark, sf):
    f = feed(spark, sf).withColumns({
        "row_count_bucket": F.when(F.col("value") <= 10, "0-10").otherwise("10+"), "file_format": F.col("agent"),
        "sampled": F.col("event_id") % 3 == 0})
    return E.data_shapes(f)


@query("freshness", "K7", """
SELECT count(*) AS events_held, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS received_lately,
 count(*) FILTER (WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS older FROM events
""")
def freshness(spark, sf):
    return E.freshness(t(spark, sf, "events").withColumnRenamed("ts", "received_at"), now(spark, sf))


LOST = """
, lost AS (SELECT s.* FROM feed s, stamp WHERE s.kind = 'started' AND s.received_at <= stamp.now - INTERVAL 24 HOUR AND NOT EXISTS
  (SELECT 1 FROM feed c WHERE c.kind = 'completed' AND c.session_id = s.session_id AND c.started_seq = s.seq))
"""
WALK = """
, rec AS (SELECT * FROM feed WHERE kind IN ('started', 'completed')),
 w AS (SELECT *, sum(CASE kind WHEN 'started' THEN 1 ELSE -1 END) OVER (PARTITION BY session_id ORDER BY seq, event_id ROWS UNBOUNDED PRECEDING) AS s FROM rec),
 m AS (SELECT *, min(s) OVER (PARTITION BY session_id ORDER BY seq, event_id ROWS UNBOUNDED PRECEDING) AS low FROM w),
 o AS (SELECT DISTINCT session_id, seq FROM m WHERE kind = 'started' AND s - least(0, low) = 1),
 tl AS (SELECT m.session_id, sum(duration_ms)::BIGINT AS total_ms FROM m JOIN o ON m.session_id = o.session_id AND m.started_seq = o.seq WHERE m.kind = 'completed' GROUP BY 1)
"""
SESSIONS = FEED + LOST + WALK + """
, b AS (SELECT session_id, count(*) FILTER (WHERE kind = 'started') AS agents_started, count(*) FILTER (WHERE kind = 'completed') AS agents_completed,
  count(*) FILTER (WHERE kind = 'completed' AND outcome <> 'success') AS failed FROM rec GROUP BY 1),
 top AS (SELECT b.*, coalesce(x.n, 0) AS never_finished, coalesce(total_ms, 0) AS total_ms FROM b LEFT JOIN (SELECT session_id, count(*) AS n FROM lost GROUP BY 1) x USING (session_id)
  LEFT JOIN tl USING (session_id) ORDER BY never_finished DESC, failed DESC, session_id LIMIT 20)
"""


@query("sessions", "K8 K9 H6", SESSIONS + "SELECT * FROM top")
def sessions(spark, sf):
    return E.sessions(feed(spark, sf), now(spark, sf))


@query("session_order", "K8", SESSIONS + """
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq, event_id)::INTEGER AS position, agent FROM rec JOIN top USING (session_id) WHERE kind = 'started'
""")
def session_order(spark, sf):
    f = feed(spark, sf)
    return E.session_order(f, E.sessions(f, now(spark, sf)))


@query("top_level_time", "K9", FEED + WALK + "SELECT * FROM tl")
def top_level_time(spark, sf):
    return E.top_level_ms(E.session_records(feed(spark, sf)))


@query("unfinished_starts", "H6", FEED + LOST + "SELECT session_id, seq, agent FROM lost")
def unfinished_starts(spark, sf):
    cutoff = now(spark, sf) - F.expr("interval 24 hours")
    return E.unfinished(E.session_records(feed(spark, sf)), cutoff).select("session_id", "seq", "agent")


@query("interrupted_agents", "K10", FEED + LOST + """
, s AS (SELECT agent, count(*) AS started FROM feed, stamp WHERE kind = 'started' AND received_at <= now - INTERVAL 24 HOUR GROUP BY 1),
 k AS (SELECT agent, count(*) AS never_finished FROM lost GROUP BY 1)
SELECT agent, started, coalesce(never_finished, 0) AS never_finished, CASE WHEN started >= 5 THEN round(100.0 * coalesce(never_finished, 0) / started, 1) END::DOUBLE AS interrupted_pct FROM s LEFT JOIN k USING (agent)
""")
def interrupted_agents(spark, sf):
    return E.interrupted(feed(spark, sf), now(spark, sf))


@query("batch_attribution", "L2", """
WITH f AS (SELECT event_id, strftime(ts, '%Y%m%d%H') AS batch_id, CASE WHEN event_id % 10 = 7 THEN 'i' || user_id END AS install_id FROM events),
 o AS (SELECT batch_id, arg_min(install_id, event_id) AS owner FROM f WHERE install_id IS NOT NULL GROUP BY 1)
SELECT coalesce(install_id, owner) AS install_id, count(*) AS n FROM f LEFT JOIN o USING (batch_id) GROUP BY 1
""")
def batch_attribution(spark, sf):
    k = F.col("event_id")
    f = t(spark, sf, "events").select(
        k, k.alias("seq"), F.date_format("ts", "yyyyMMddHH").alias("batch_id"), F.when(k % 10 == 7, "install").alias("kind"),
        F.when(k % 10 == 7, F.concat(F.lit("i"), F.col("user_id").cast("string"))).alias("install_id"))
    return E.attributed(f).groupBy("install_id").agg(F.count("*").alias("n"))


@query("document_collection_events", "A16", """
SELECT count(*) AS n, count(try_cast(props->>'$.k' AS BIGINT)) AS with_k, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events
""")
def document_collection_events(spark, sf):
    from millrace.sources.collections import flatten_documents

    flat = flatten_documents(t(spark, sf, "events"), "props")
    return flat.agg(F.count("*").alias("n"), F.count(F.col("k").try_cast("bigint")).alias("with_k"),
                    F.sum(F.col("k").cast("bigint")).alias("total"))
