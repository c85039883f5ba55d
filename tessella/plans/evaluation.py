"""Queries that measure retrieval: recall, separation, bands, sweeps, drift, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.checkpoints import durable
from tessella.functions import scoring as S
from tessella.operators import match as M
from tessella.operators.ranks import percentile, values_at
from tessella.registry import query

from .retrieval import ANSWERS, BAND, FUSED, HITS, answers, fused, hits
from .views import buttons, records, table, with_

RANKED = "ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY fused DESC, rid) AS INTEGER) AS rank FROM fused)"


@query(with_(*HITS) + "SELECT count(*) AS answerable, round(avg((first = 1)::INTEGER), 6) AS recall_1, round(avg((first <= 5)::INTEGER), 6) AS recall_5 FROM (SELECT qid, coalesce(min(rk) FILTER (WHERE rid = qid), 999) AS first FROM hits GROUP BY qid)")
def d19_recall(spark, sf):
    first = hits(spark, sf).groupBy("qid").agg(F.coalesce(F.min(F.when(F.col("rid") == F.col("qid"), F.col("rk"))), F.lit(999)).alias("first"))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return first.agg(F.count("*").alias("answerable"), share(F.col("first") == 1).alias("recall_1"), share(F.col("first") <= 5).alias("recall_5"))


@query(with_(*HITS) + "SELECT rid = qid AS same, round(min(score), 6) AS low, round(median(score), 6) AS mid, round(max(score), 6) AS high, count(*) AS n FROM hits GROUP BY 1")
def d20_separation(spark, sf):
    rows = durable(hits(spark, sf).select((F.col("rid") == F.col("qid")).alias("same"), "score"))
    ends = rows.groupBy("same").agg(S.rounded(F.min("score")).alias("low"), S.rounded(F.max("score")).alias("high"), F.count("*").alias("n"))
    middle = [(same, percentile(rows.where(F.col("same") == same), "score", 0.5)) for same in (False, True)]
    return ends.join(F.broadcast(spark.createDataFrame(middle, "same boolean, mid double")), "same").withColumn("mid", F.round("mid", 6))


@query(with_(*HITS) + "SELECT qid, round(max(score) FILTER (WHERE rid = qid), 6) AS self_score, round(max(score) FILTER (WHERE rid <> qid), 6) AS decoy_score FROM hits GROUP BY qid")
def d22_self_decoy(spark, sf):
    same = F.col("rid") == F.col("qid")
    return hits(spark, sf).groupBy("qid").agg(S.rounded(F.max(F.when(same, F.col("score")))).alias("self_score"), S.rounded(F.max(F.when(~same, F.col("score")))).alias("decoy_score"))


@query(with_(*HITS) + "SELECT round(avg(s - d), 6) AS separation, count(*) AS n FROM (SELECT max(score) FILTER (WHERE rid = qid) AS s, max(score) FILTER (WHERE rid <> qid) AS d FROM hits GROUP BY qid) WHERE s IS NOT NULL AND d IS NOT NULL")
def d21_mean_separation(spark, sf):
    both = d22_self_decoy(spark, sf).where("self_score IS NOT NULL AND decoy_score IS NOT NULL")
    return both.agg(F.round(F.avg(F.col("self_score") - F.col("decoy_score")), 6).alias("separation"), F.count("*").alias("n"))


@query(with_(*ANSWERS, "s AS (SELECT list_sort(list(top)) AS v, count(*) AS n FROM answers)") + "SELECT v[least(n - 1, CAST(floor(0.1 * n) AS BIGINT)) + 1] AS q10, v[least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) + 1] AS q50, v[least(n - 1, CAST(floor(0.9 * n) AS BIGINT)) + 1] AS q90 FROM s")
def d23_quantiles(spark, sf):
    top = durable(answers(spark, sf).select("top"))
    n = top.count()
    ranks = {f"q{p}": min(n - 1, int(p / 100 * n)) for p in (10, 50, 90)}
    found = values_at(top, "top", list(ranks.values()))
    return spark.createDataFrame([tuple(found[k] for k in ranks.values())], ", ".join(f"{name} double" for name in ranks))


@query(with_(*ANSWERS) + f"SELECT band, count(*) AS n, sum(ok::INTEGER)::BIGINT AS correct, round(avg(ok::INTEGER), 6) AS precision FROM (SELECT {BAND} AS band, top_rid = qid AS ok FROM answers) GROUP BY band")
def d24_band_precision(spark, sf):
    a = answers(spark, sf).select(S.band(F.col("top"), F.col("margin"), F.col("n")).alias("band"), (F.col("top_rid") == F.col("qid")).cast("int").alias("ok"))
    return a.groupBy("band").agg(F.count("*").alias("n"), F.sum("ok").alias("correct"), F.round(F.avg("ok"), 6).alias("precision"))


@query(
    with_(*ANSWERS)
    + """SELECT s / 100e0 AS min_score, m / 100e0 AS min_margin, count(*) AS n, sum((top_rid = qid)::INTEGER)::BIGINT AS correct,
         round(avg((top_rid = qid)::INTEGER), 6) AS precision
         FROM answers, (SELECT unnest(range(30, 70, 5)) AS s), (SELECT unnest(range(0, 25, 5)) AS m)
         WHERE top > s / 100e0 AND margin > m / 100e0 GROUP BY s, m"""
)
def d25_sweep(spark, sf):
    grid = spark.range(30, 70, 5).select((F.col("id") / 100).alias("min_score")).join(spark.range(0, 25, 5).select((F.col("id") / 100).alias("min_margin")))
    met = answers(spark, sf).join(F.broadcast(grid), (F.col("top") > F.col("min_score")) & (F.col("margin") > F.col("min_margin")))
    ok = (F.col("top_rid") == F.col("qid")).cast("int")
    return met.groupBy("min_score", "min_margin").agg(F.count("*").alias("n"), F.sum(ok).alias("correct"), F.round(F.avg(ok), 6).alias("precision"))


@query(with_(*ANSWERS) + "SELECT f / 100e0 AS floor, count(*) FILTER (WHERE top <= f / 100e0 AND top_rid = qid) AS correct_lost, count(*) FILTER (WHERE top <= f / 100e0 AND top_rid <> qid) AS wrong_rejected FROM answers, (SELECT unnest(range(30, 75, 5)) AS f) GROUP BY f")
def d26_floor_sweep(spark, sf):
    grid = spark.range(30, 75, 5).select((F.col("id") / 100).alias("floor"))
    met = answers(spark, sf).join(F.broadcast(grid))
    low, ok = F.col("top") <= F.col("floor"), F.col("top_rid") == F.col("qid")
    return met.groupBy("floor").agg(F.count_if(low & ok).alias("correct_lost"), F.count_if(low & ~ok).alias("wrong_rejected"))


@query(with_(*FUSED, RANKED) + "SELECT qid, coalesce(min(rank) FILTER (WHERE rid = qid), 0) AS rank FROM ranked GROUP BY qid")
def e3_rank(spark, sf):
    return M.ranked(fused(spark, sf)).groupBy("qid").agg(F.coalesce(F.min(F.when(F.col("rid") == F.col("qid"), F.col("rank"))), F.lit(0)).alias("rank"))


@query(
    with_(*ANSWERS)
    + "SELECT qid || '.jpg' AS photo, top_rid AS top_id, (top_rid = qid)::INTEGER AS correct, top, margin FROM answers"
)
def a13_eval_rows(spark, sf):
    photo = F.concat(F.col("qid").cast("string"), F.lit(".jpg"))
    return answers(spark, sf).select(photo.alias("photo"), F.col("top_rid").alias("top_id"), (F.col("top_rid") == F.col("qid")).cast("int").alias("correct"), "top", "margin")


@query(
    """WITH two AS (SELECT user_id, event_type, round(value, 6) AS v, round(value * 1.01 + (event_id % 3) - 1, 6) AS w FROM events)
       SELECT event_type AS band, count(*) AS n, count(*) FILTER (WHERE v <> w) AS n_differ, round(min(w - v), 4) AS low, round(max(w - v), 4) AS high,
              round(avg(abs(w - v)), 4) AS mean_abs FROM two GROUP BY event_type"""
)
def d27_drift(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.round("value", 6).alias("v"), F.round(F.col("value") * 1.01 + F.col("event_id") % 3 - 1, 6).alias("w"))
    d = F.col("w") - F.col("v")
    return e.groupBy(F.col("event_type").alias("band")).agg(
        F.count("*").alias("n"), F.count_if(d != 0).alias("n_differ"), F.round(F.min(d), 4).alias("low"), F.round(F.max(d), 4).alias("high"), F.round(F.avg(F.abs(d)), 4).alias("mean_abs")
    )


@query(with_("buttons", "records", "s AS (SELECT list_sort(list(quality)) AS v, count(*) AS n, round(avg(quality), 6) AS mean FROM records)") + "SELECT round(v[1], 6) AS low, round(v[n // 2 + 1], 6) AS mid, round(v[n], 6) AS high, mean FROM s")
def d13_distribution(spark, sf):
    rows = durable(records(spark, sf).select("quality"))
    n = rows.count()
    found = values_at(rows, "quality", [0, n // 2, n - 1])
    one = rows.agg(F.round(F.avg("quality"), 6).alias("mean"))
    return one.select(*[F.round(F.lit(found[k]), 6).alias(name) for name, k in (("low", 0), ("mid", n // 2), ("high", n - 1))], "mean")


@query(with_("buttons", "records") + "SELECT count(*) AS records, count(brand) AS with_brand, count(code) AS with_code, count(*) FILTER (WHERE n_buttons = 0) AS empty, round(100 * count(code) / count(*), 6) AS code_percent FROM records")
def d14_coverage(spark, sf):
    return records(spark, sf).agg(
        F.count("*").alias("records"), F.count("brand").alias("with_brand"), F.count("code").alias("with_code"), F.count_if(F.col("n_buttons") == 0).alias("empty"),
        F.round(F.try_divide(100 * F.count("code"), F.count("*")), 6).alias("code_percent"),
    )


@query(with_("buttons", "records") + "SELECT code, n, array_to_string(rids[1:4], ',') || CASE WHEN n > 4 THEN '...' ELSE '' END AS owners FROM (SELECT code, count(*) AS n, list_sort(list(rid)) AS rids FROM records WHERE code IS NOT NULL GROUP BY code HAVING count(*) > 1) ORDER BY n DESC, code LIMIT 15")
def d15_duplicate_codes(spark, sf):
    rows = records(spark, sf).where("code IS NOT NULL").select("code", "rid")
    worst = rows.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "code").limit(15)
    place = F.row_number().over(Window.partitionBy("code").orderBy("rid"))
    shown = rows.join(F.broadcast(worst), "code").withColumn("place", place).where("place <= 4")
    owners = F.array_join(F.sort_array(F.collect_list("rid")).cast("array<string>"), ",")
    return shown.groupBy("code", "n").agg(owners.alias("owners")).select("code", "n", F.concat("owners", F.when(F.col("n") > 4, "...").otherwise("")).alias("owners"))


@query(with_("buttons") + "SELECT color, count(*) AS n, round(count(*) / (SELECT count(*) FROM buttons), 6) AS share FROM buttons GROUP BY color")
def d17_histogram(spark, sf):
    b = buttons(spark, sf).groupBy("color").agg(F.count("*").alias("n"))
    return b.select("color", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query(
    with_("buttons")
    + """SELECT rid, round(0.32 * (CASE WHEN n < 6 OR n > 70 THEN 0.2 WHEN n BETWEEN 14 AND 50 THEN 1.0 ELSE 0.65 END)
           + 0.13 * (CASE WHEN aspect BETWEEN 2.0 AND 6.5 THEN 1.0 ELSE 0.5 END) + 0.22 * conf + 0.13 * votes + 0.10 * orient
           + 0.10 * least(labelled / n / 0.35, 1.0), 6)::DOUBLE AS quality
         FROM (SELECT rid, count(*) AS n, 1 + CAST(rid % 60 AS DOUBLE) / 10 AS aspect, avg(x) AS conf, avg(least(1 + pos % 4, 3) / 3) AS votes,
                      CAST(rid % 97 AS DOUBLE) / 97 AS orient, count(*) FILTER (WHERE pos % 3 = 0) AS labelled FROM buttons GROUP BY rid)"""
)
def d12_quality(spark, sf):
    b = buttons(spark, sf).groupBy("rid").agg(
        F.count("*").alias("n"), F.avg("x").alias("conf"), F.avg(F.least(1 + F.col("pos") % 4, F.lit(3)) / 3).alias("votes"), F.count_if(F.col("pos") % 3 == 0).alias("labelled")
    )
    aspect, orient = 1 + (F.col("rid") % 60).cast("double") / 10, (F.col("rid") % 97).cast("double") / 97
    return b.select("rid", F.round(S.extraction_quality(F.col("n"), aspect, F.col("conf"), F.col("votes"), orient, F.col("labelled")), 6).alias("quality"))


@query(with_("buttons") + "SELECT rid, list_sort(list(h))[count(*) // 2 + 1] AS mid FROM buttons GROUP BY rid")
def d37_upper_median(spark, sf):
    return buttons(spark, sf).groupBy("rid").agg(F.collect_list("h").alias("v")).select("rid", S.index_quantile(F.col("v"), 0.5).alias("mid"))


