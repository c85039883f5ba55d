"""Queries of the query log: lifecycle, misses, rates, latency, annotations, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import catalog as K
from tessella.operators.ranks import percentile, values_at
from tessella.registry import query
from tessella.streaming.lifecycle import rate_windows

from .views import table, with_

LOG = """log AS (SELECT event_id AS request_id, user_id, ts, value, CASE WHEN event_id % 4 <> 0 THEN user_id % 7 END AS top, CASE WHEN event_id % 3 <> 0 THEN user_id % 5 END AS chosen,
               event_id % 11 = 0 AS none_of_these, event_id % 6 <> 0 AS answered FROM events)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("request_id"), "user_id", "ts", "value",
        F.when(e % 4 != 0, F.col("user_id") % 7).alias("top"), F.when(e % 3 != 0, F.col("user_id") % 5).alias("chosen"),
        (e % 11 == 0).alias("none_of_these"), (e % 6 != 0).alias("answered"),
    )


@query(with_(LOG) + "SELECT request_id, top, chosen FROM log WHERE answered AND (none_of_these OR chosen <> top)")
def b10_misses(spark, sf):
    return log(spark, sf).where(F.col("answered") & (F.col("none_of_these") | (F.col("chosen") != F.col("top")))).select("request_id", "top", "chosen")


@query(with_(LOG) + "SELECT CASE WHEN request_id % 13 = 0 THEN 'refused' WHEN request_id % 17 = 0 THEN 'outage' ELSE 'ok' END AS kind, count(*) AS n, round(avg(value), 4) AS mean FROM log GROUP BY 1")
def b22_error_split(spark, sf):
    status = F.when(F.col("request_id") % 13 == 0, 422).when(F.col("request_id") % 17 == 0, 503).otherwise(200)
    kind = F.when(status.between(400, 499), "refused").when(status >= 500, "outage").otherwise("ok")
    return log(spark, sf).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query(with_(LOG) + "SELECT request_id, c_name AS title, n_name AS origin FROM log LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def c26_support_lookup(spark, sf):
    c, n = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), table(spark, sf, "nation").select("n_nationkey", "n_name")
    met = log(spark, sf).join(c, F.col("user_id") == F.col("c_custkey"), "left").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return met.select("request_id", F.col("c_name").alias("title"), F.col("n_name").alias("origin"))


@query(with_(LOG) + "SELECT request_id, a.n_name AS top_name, b.n_name AS chosen_name FROM log LEFT JOIN nation a ON top = a.n_nationkey LEFT JOIN nation b ON chosen = b.n_nationkey")
def c27_chosen_and_top(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("top_name")), n.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("chosen_name"))
    met = log(spark, sf).join(F.broadcast(a), F.col("top") == F.col("ka"), "left").join(F.broadcast(b), F.col("chosen") == F.col("kb"), "left")
    return met.select("request_id", "top_name", "chosen_name")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def i1_latest_state(spark, sf):
    return K.latest(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), "user_id", "ts", "event_id").drop("ts")


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 2")
def i2_rate_window(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n"))
    return e.where("n > 2")


@query("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, count(*) FILTER (WHERE value > 50) AS slow FROM events GROUP BY event_type")
def i5_latency(spark, sf):
    """The exact percentile of each of the few types of events."""
    e = table(spark, sf, "events")
    slow = e.groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("slow"))
    high = [(r.event_type, percentile(e.where(F.col("event_type").eqNullSafe(r.event_type)), "value", 0.95)) for r in slow.collect()]
    p95 = spark.createDataFrame(high, "event_type string, p95 double")
    return slow.join(F.broadcast(p95), "event_type").select("event_type", F.round("p95", 6).alias("p95"), "slow")


@query("SELECT user_id, date_trunc('minute', ts) AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def i6_minute_rate(spark, sf):
    """Keys with more requests in a minute than allowed."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rate_windows(e, "user_id", limit=1).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id")
def e10_last_turn(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    turns = c.groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn"))
    return turns


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|7'), doc_id) <= greatest(1, CAST(floor(count(*) OVER () * 0.15) AS BIGINT)) AS val FROM documents")
def e11_split(spark, sf):
    """A seeded split of exact size: the k-th digest is found by counts of parts, not by a global sort."""
    h = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("7")))
    d = table(spark, sf, "documents").select("doc_id", h.alias("h")).withColumn("head", F.conv(F.substring("h", 1, 12), 16, 10).cast("double"))
    k = max(1, int(d.count() * 0.15))
    head = values_at(d, "head", [k - 1])[k - 1]
    rest = k - d.where(F.col("head") < head).count()  # places among the digests that begin alike
    last = d.where(F.col("head") == head).orderBy("h", "doc_id").limit(rest).agg(F.max(F.struct("h", "doc_id")).alias("last"))
    return d.join(F.broadcast(last)).select("doc_id", (F.struct("h", "doc_id") <= F.col("last")).alias("val"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || '|3'), doc_id LIMIT 100")
def f8_hash_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("3"))).alias("h"))
    return d.orderBy("h", "doc_id").limit(100).select("doc_id")
