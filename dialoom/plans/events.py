"""Queries over execution logs; events and orders stand for them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import dedup, summary, validate
from ..sources import cache
from .base import query


def _log(t):
    return t("events").withColumn("ok", F.col("event_type") != "error")


@query("""
SELECT user_id, event_type, CASE WHEN event_type = 'view' THEN 'unknown_tool' WHEN n IS NULL THEN 'not_replayed' WHEN ok AND NOT r_ok THEN 'failed' WHEN NOT ok AND r_ok THEN 'recovered' ELSE 'same' END AS outcome, count(*) AS n
FROM (SELECT e.*, e.event_type <> 'error' AS ok, r.n, r.r_ok FROM events e LEFT JOIN (SELECT user_id AS u, event_type AS t, count(*) AS n, count(*) % 2 = 0 AS r_ok FROM events WHERE user_id % 5 > 0 GROUP BY ALL) r ON e.user_id = u AND e.event_type = t) GROUP BY ALL""")
def replay_outcomes(t):
    key = F.concat_ws(":", "user_id", "event_type")
    calls = _log(t).select(F.col("user_id").alias("dialog_id"), F.col("event_type").alias("name"), key.alias("cache_key"), "ok")
    results = t("events").where("user_id % 5 > 0").groupBy(key.alias("cache_key")).agg((F.count("*") % 2 == 0).alias("ok"))
    tools = t("events").where("event_type <> 'view'").select(F.col("event_type").alias("name"))
    r = validate.replayed(calls, results, tools)
    return r.groupBy(F.col("dialog_id").alias("user_id"), F.col("name").alias("event_type"), "outcome").agg(F.count("*").alias("n"))


@query("""
SELECT e.event_id, r.ok, r.ok IS NOT NULL AS cached FROM events e LEFT JOIN (SELECT DISTINCT user_id, true AS ok FROM events WHERE event_type = 'error') r USING (user_id)""")
def cache_lookup(t):
    results = t("events").where("event_type = 'error'").select(F.col("user_id").alias("cache_key")).distinct().withColumns({"ok": F.lit(True), "error": F.lit(None).cast("string")})
    return cache.replay(t("events").select("event_id", F.col("user_id").alias("cache_key")), results).select("event_id", "ok", "cached")


@query("""
SELECT DISTINCT user_id AS cache_key FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50)""")
def cache_missing(t):
    return cache.missing(t("events").select(F.col("user_id").alias("cache_key")), t("events").where("event_type = 'purchase' and value > 50").select(F.col("user_id").alias("cache_key")).distinct())


@query("""
WITH f AS (SELECT user_id, min((ts, event_id)) FILTER (event_type = 'error') AS f, max((ts, event_id)) FILTER (event_type <> 'error') AS g, count(*) FILTER (event_type = 'error') AS n_failed FROM events GROUP BY user_id)
SELECT user_id, n_failed, coalesce(g > f, false) AS recovered FROM f""")
def failure_recovery(t):
    return validate.failure_order(_log(t), "user_id", ["ts", "event_id"])


@query("""
SELECT user_id, max(n) > 1 AS repeated FROM (SELECT user_id, props, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL) GROUP BY user_id""")
def repeated_failures(t):
    return validate.repeated_failures(_log(t), "user_id", ["event_type", "props"])


@query("""
WITH w AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, count(*) AS n, min(event_id) AS first_event FROM w WHERE event_type = 'error' GROUP BY user_id, i HAVING count(*) >= 2""")
def failure_streaks(t):
    return validate.streaks(_log(t), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2).select("user_id", "n", F.col("first.event_id").alias("first_event"))


@query("""
SELECT user_id, event_id, gap_s FROM (SELECT *, epoch_us(ts) // 1000000 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000000 AS gap_s FROM events) WHERE gap_s > 36000""")
def stall_gaps(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").withColumn("gap_s", F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(w).cast("timestamp"))).where("gap_s > 36000").select("user_id", "event_id", "gap_s")


@query("""
SELECT user_id, event_type, day, event_id FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, event_type, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def first_seen_events(t):
    d = t("events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return dedup.first_seen(d, ["user_id", "event_type", "day"], ["ts", "event_id"]).select("user_id", "event_type", "day", "event_id")


@query("""
SELECT b.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(least(0, min(floor(value)))::BIGINT, greatest(200, max(floor(value)))::BIGINT + 1))::INT AS bin FROM events) b LEFT JOIN (SELECT floor(value)::INT AS bin, count(*) AS n FROM events GROUP BY 1) USING (bin)""")
def value_histogram(t):
    return summary.histogram(t("events"), F.floor("value"), 0, 200)


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def event_arguments(t):
    return t("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, count(*) FILTER (value > 20) AS n_bad FROM events GROUP BY ALL""")
def hourly_rates(t):
    d = t("events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("n_bad"))
    return d.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "n_bad")


@query("""
SELECT CASE WHEN p IN ('tomtom-', 'tomtom-x') THEN 'tomtom' WHEN p IN ('here_x') THEN 'here' WHEN p IN ('osrm_x', 'open_meteo_x') THEN 'keyless' ELSE 'other' END AS provider, count(*) AS n FROM (SELECT ['tomtom-x', 'here_x', 'osrm_x', 'open_meteo_x', 'my_here_x'][event_id % 5 + 1] AS p FROM events) GROUP BY 1""")
def provider_counts(t):
    name = F.element_at(F.array(*map(F.lit, ("tomtom-x", "here_x", "osrm_x", "open_meteo_x", "my_here_x"))), (F.col("event_id") % 5 + 1).cast("int"))
    return t("events").groupBy(geo.provider(name).alias("provider")).agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def customers_without_orders(t):
    return t("customer").join(t("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""
SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels""")
def ids_in_both(t):
    return t("documents").select("doc_id").intersect(t("labels").select("doc_id"))


@query("""
SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1""")
def ids_without_good_label(t):
    return t("documents").select("doc_id").exceptAll(t("labels").where("quality = 1").select("doc_id"))
