"""Queries of tokens, index, retrieval, fusion and bands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import config as C
from tessella.checkpoints import durable, release
from tessella.functions import scoring as S
from tessella.operators import index as I
from tessella.operators import match as M
from tessella.registry import query

from .views import SQL, buttons, one_part_each, records, sized_buttons, table, with_


def cell_sql(v: str, g: int) -> str:
    at = f"(least(greatest({v}, 0), 0.999999) * {g})"
    c = f"CAST(floor{at} AS INTEGER)"
    return f"""CASE WHEN {at} - {c} < 0.25 AND {c} > 0 THEN [{c}, {c} - 1]
                    WHEN {at} - {c} > 0.75 AND {c} < {g - 1} THEN [{c}, {c} + 1] ELSE [{c}] END"""


def token_sql(name: str, source: str, key: str) -> str:
    """A CTE of the distinct grid tokens of the buttons in `source`."""
    return f"""{name} AS (
        SELECT DISTINCT {key}, unnest([concat_ws('|', 'G', cx, cy, color, s), concat_ws('|', 'Gc', cx, cy, color), concat_ws('|', 'Gs', cx, cy, s),
                               concat_ws('|', 'L', cx, cy, l), concat_ws('|', 'LT', l)]) AS token
        FROM (SELECT {key}, color, s, l, cx, unnest(cys) AS cy FROM (
            SELECT {key}, color, CASE WHEN w < 0.12 THEN 0 WHEN w < 0.25 THEN 1 ELSE 2 END AS s,
                   regexp_replace(upper(label), '[^A-Z0-9]+', '', 'g') AS l,
                   unnest({cell_sql("x", 12)}) AS cx, {cell_sql("y", 32)} AS cys FROM {source})))"""


SQL["placed"] = """placed AS (
    SELECT *, rid * 2 AS doc, false AS flipped FROM buttons
    UNION ALL BY NAME SELECT * REPLACE (1 - x AS x, 1 - y AS y), rid * 2 + 1 AS doc, true AS flipped FROM buttons WHERE rid % 7 = 0)"""
SQL["docs"] = "docs AS (SELECT DISTINCT doc, rid, flipped FROM placed)"
SQL["tokens"] = token_sql("tokens", "placed", "doc")
SQL["stats"] = """stats AS (
    SELECT token, count(*) AS df, greatest(ln((SELECT count(*) FROM docs) / count(*)), 1e-6) AS idf FROM tokens GROUP BY token)"""
SQL["norms"] = "norms AS (SELECT doc, greatest(sum(idf), 1e-6) AS norm FROM tokens JOIN stats USING (token) GROUP BY doc)"
SQL["asked_buttons"] = """asked_buttons AS (
    SELECT rid AS qid, x + 1e0 / 24 AS x, y, w, h, color, CASE WHEN pos % 5 = 0 THEN 'other ' || label ELSE label END AS label
    FROM buttons WHERE rid % 10 = 3 AND pos % 3 <> 0)"""
SQL["q_tokens"] = token_sql("q_tokens", "asked_buttons", "qid")
SQL["usable"] = """usable AS (
    SELECT * FROM stats WHERE idf >= 0.15 AND ((SELECT count(*) FROM docs) < 200 OR df <= CAST(floor(0.25 * (SELECT count(*) FROM docs)) AS BIGINT)))"""
SQL["scored"] = """asked AS (SELECT qid, token, idf FROM q_tokens JOIN usable USING (token)),
    q_mass AS (SELECT qid, sum(idf) AS q_mass FROM asked GROUP BY qid),
    masses AS (SELECT qid, doc, sum(idf) AS mass FROM asked JOIN tokens USING (token) GROUP BY qid, doc),
    scored AS (SELECT qid, doc, mass, round(least(mass / (sqrt(norm) * sqrt(q_mass)), 1), 9) AS score
               FROM masses JOIN norms USING (doc) JOIN q_mass USING (qid))"""
SQL["hits"] = """hits AS (
    SELECT qid, rid, flipped, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS INTEGER) AS rk FROM (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS r FROM scored) JOIN docs USING (doc)
        WHERE r <= 200 QUALIFY row_number() OVER (PARTITION BY qid, rid ORDER BY score DESC, flipped) = 1)
    QUALIFY rk <= 100)"""
SQL["queries"] = """queries AS (SELECT rid AS qid, brand, code, aspect, n_buttons, quality FROM records WHERE rid % 10 = 3)"""
SQL["candidates"] = """coded AS (SELECT q.qid, r.rid FROM queries q JOIN records r ON q.code = r.code),
    candidates AS (
        SELECT qid, rid, max(score) AS score, bool_or(by_code) AS by_code FROM (
            SELECT qid, rid, score, false AS by_code FROM hits UNION ALL SELECT qid, rid, 0, true FROM coded) GROUP BY qid, rid)"""
SQL["chosen"] = """chosen AS (
    SELECT qid, rid, score, by_code FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS place,
               sum(by_code::INTEGER) OVER (PARTITION BY qid) AS kept, count(*) OVER (PARTITION BY qid) AS n FROM candidates)
    WHERE n <= 25 OR by_code OR place <= greatest(0, 25 - kept))"""
SQL["fused"] = """fused AS (
    SELECT c.qid, c.rid, c.score, by_code,
           round(0.25 * c.score
           + 0.15 * (CASE WHEN q.brand IS NULL OR r.brand IS NULL THEN 0.5 WHEN q.brand = r.brand THEN 1.0 ELSE 0.0 END)
           + 0.05 * greatest(0, 1 - (abs(q.aspect - r.aspect) / greatest(q.aspect, r.aspect)) / 0.35)
           + CASE WHEN q.code IS NULL OR r.code IS NULL THEN 0 WHEN q.code = r.code THEN 0.40
                  WHEN levenshtein(q.code, r.code) <= 2 THEN 0.20 ELSE 0 END, 6)::DOUBLE AS fused
    FROM chosen c JOIN records r USING (rid) JOIN queries q USING (qid))"""
SQL["answers"] = """answers AS (
    SELECT qid, rid AS top_rid, fused AS top, round(fused - second, 6) AS margin, n FROM (
        SELECT *, row_number() OVER w AS rank, lead(fused, 1, 0) OVER w AS second, count(*) OVER (PARTITION BY qid) AS n
        FROM fused WINDOW w AS (PARTITION BY qid ORDER BY fused DESC, rid)) WHERE rank = 1)"""

INDEX = ("buttons", "placed", "docs", "tokens", "stats", "norms")
SCORED = (*INDEX, "asked_buttons", "q_tokens", "usable", "scored")
HITS = (*SCORED, "hits")
FUSED = ("buttons", "records", "queries", *INDEX[1:], *SCORED[len(INDEX) :], "hits", "candidates", "chosen", "fused")
ANSWERS = (*FUSED, "answers")


_indexes: dict[tuple[str, str], I.TokenIndex] = {}
_records: dict[tuple[str, str], DataFrame] = {}
_hits: dict[tuple[str, str], DataFrame] = {}


def index(spark: SparkSession, sf_dir: str) -> I.TokenIndex:
    """The index of the records, built once for each session and folder, and again if its files are gone."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes or not _indexes[key].readable():
        _indexes[key] = I.TokenIndex(sized_buttons(spark, sf_dir), F.col("rid") % 7 == 0)
    return _indexes[key]


def _once(made: dict[tuple[str, str], DataFrame], spark: SparkSession, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is written once for each session and folder, and again if its files are gone."""
    key = (spark.sparkContext.applicationId, sf_dir)
    try:
        made[key].limit(1).count()
    except Exception:  # not there yet, or Spark's error for lost files
        made[key] = durable(make())
        release(spark)
    return made[key]


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records, written: fusion reads them several times."""

    def make() -> DataFrame:
        one_part = one_part_each(spark, sf_dir)
        release(spark)
        return records(spark, sf_dir, one_part)

    return _once(_records, spark, sf_dir, make)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perturbed copies of every tenth record: buttons dropped, relabelled and shifted; written, and dealt by query, so that
    its tokens need no further shuffle."""
    b = buttons(spark, sf_dir).where("rid % 10 = 3 AND pos % 3 <> 0")
    label = F.when(F.col("pos") % 5 == 0, F.concat(F.lit("other "), "label")).otherwise(F.col("label"))
    rows = durable(b.select(F.col("rid").alias("qid"), (F.col("x") + 1 / 24).alias("x"), "y", "w", "h", "color", label.alias("label")))
    release(spark)
    return rows.repartition("qid")


def scored(spark: SparkSession, sf_dir: str) -> tuple[I.TokenIndex, DataFrame]:
    found = index(spark, sf_dir)
    return found, found.scores(I.grid_tokens(asked(spark, sf_dir), "qid"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retrieved records of all queries, written: retrieval costs far more than what is asked of it, and its shuffle
    files are gone before that begins."""
    return _once(_hits, spark, sf_dir, lambda: index(spark, sf_dir).retrieve(I.grid_tokens(asked(spark, sf_dir), "qid")))


def queries_of(rows: DataFrame) -> DataFrame:
    return rows.where("rid % 10 = 3").select(F.col("rid").alias("qid"), "brand", "code", "aspect", "n_buttons", "quality")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue(spark, sf_dir)
    return M.with_code_hits(hits(spark, sf_dir), M.code_hits(queries_of(rows), rows))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue(spark, sf_dir)
    if rows.groupBy("rid").count().where("count > 1").isEmpty():
        return M.fuse_by_code(hits(spark, sf_dir), queries_of(rows), rows, F.lit(0.0))
    return M.fuse(M.prefilter(candidates(spark, sf_dir)), queries_of(rows), rows, F.lit(0.0))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.answers(fused(spark, sf_dir))


@query(with_("buttons", token_sql("t", "buttons", "rid")) + "SELECT rid, token FROM t")
def b23_grid_tokens(spark, sf):
    return I.grid_tokens(buttons(spark, sf), "rid")


@query(with_("buttons", token_sql("t", "buttons", "rid")) + "SELECT count(*) AS n_tokens, count(DISTINCT token) AS n_distinct, count(DISTINCT rid) AS n_docs FROM t")
def g1_token_distinct(spark, sf):
    return I.grid_tokens(buttons(spark, sf), "rid").agg(F.count("*").alias("n_tokens"), F.countDistinct("token").alias("n_distinct"), F.countDistinct("rid").alias("n_docs"))


@query(
    with_("buttons")
    + """, b AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY rid) AS n FROM buttons) WHERE n BETWEEN 3 AND 80),
    near AS (
        SELECT *, row_number() OVER (PARTITION BY rid, pos ORDER BY d, pos_o) AS r FROM (
            SELECT a.rid, a.pos, a.color, o.pos AS pos_o, o.color AS c, o.x - a.x AS dx, o.y - a.y AS dy,
                   sqrt((o.x - a.x) * (o.x - a.x) + (o.y - a.y) * (o.y - a.y)) AS d
            FROM b a JOIN b o ON a.rid = o.rid AND a.pos <> o.pos) QUALIFY r <= 5),
    t AS (
        SELECT DISTINCT p.rid, concat_ws('|', 'T', CAST(floor(10 * least(p.d, q.d) / greatest(p.d, q.d) + 0.5) AS BIGINT),
               CAST(floor(degrees(acos(least(greatest((p.dx * q.dx + p.dy * q.dy) / (p.d * q.d), -1), 1))) / 15 + 0.5) AS BIGINT),
               p.color, least(p.c, q.c), greatest(p.c, q.c)) AS token
        FROM near p JOIN near q ON p.rid = q.rid AND p.pos = q.pos AND p.r < q.r WHERE p.d >= 1e-9 AND q.d >= 1e-9)
    SELECT rid, token FROM t"""
)
def c25_triplets(spark, sf):
    return I.triplet_tokens(buttons(spark, sf), "rid")


@query(with_(*INDEX) + "SELECT token, df, round(idf, 6) AS idf FROM stats")
def d1_idf(spark, sf):
    return index(spark, sf).stats.withColumn("idf", F.round("idf", 6))


@query(with_(*INDEX) + "SELECT doc, round(norm, 6) AS norm FROM norms")
def d2_doc_norms(spark, sf):
    return index(spark, sf).norms.withColumn("norm", F.round("norm", 6))


@query(with_(*INDEX) + "SELECT count(*) AS postings, round(count(*) / (SELECT count(DISTINCT rid) FROM docs), 6) AS per_record, round(count(*) / (SELECT count(DISTINCT rid) FROM docs) * 50000 * 4 / 1e6, 6) AS mb_at_50k FROM tokens")
def d33_index_stats(spark, sf):
    found = index(spark, sf)
    n = found.docs.agg(F.countDistinct("rid").alias("n"))
    per = F.col("postings") / F.col("n")
    return found.stats.agg(F.sum("df").alias("postings")).join(F.broadcast(n)).select("postings", F.round(per, 6).alias("per_record"), F.round(per * 50000 * 4 / 1e6, 6).alias("mb_at_50k"))


@query(with_(*SCORED[:-1]) + "SELECT count(*) AS kept, sum(df)::BIGINT AS postings FROM usable")
def b18_df_filter(spark, sf):
    found = index(spark, sf)
    return I.usable_tokens(found.stats, found.n_docs).agg(F.count("*").alias("kept"), F.sum("df").alias("postings"))


@query(with_(*SCORED[:-1]) + "SELECT qid, count(*) AS n_tokens, sum(df)::BIGINT AS postings FROM q_tokens JOIN usable USING (token) GROUP BY qid")
def c3_token_postings(spark, sf):
    found = index(spark, sf)
    asked_tokens = I.grid_tokens(asked(spark, sf), "qid")
    return asked_tokens.join(I.usable_tokens(found.stats, found.n_docs), "token").groupBy("qid").agg(F.count("*").alias("n_tokens"), F.sum("df").alias("postings"))


@query(with_(*SCORED) + "SELECT qid, doc, round(mass, 6) AS mass FROM scored")
def d3_mass(spark, sf):
    return index(spark, sf).masses(I.grid_tokens(asked(spark, sf), "qid")).withColumn("mass", S.rounded(F.col("mass")))


@query(with_(*HITS) + "SELECT qid, rid, flipped, round(score, 6) AS score, rk FROM hits")
def d5_retrieve_topk(spark, sf):
    return hits(spark, sf).withColumn("score", S.rounded(F.col("score")))


@query(with_(*SCORED) + "SELECT qid, rid, round(max(score), 6) AS score, count(*) AS n_docs FROM scored JOIN docs USING (doc) GROUP BY qid, rid HAVING count(*) > 1")
def d6_collapse(spark, sf):
    found, rows = scored(spark, sf)
    return rows.join(found.docs, "doc").groupBy("qid", "rid").agg(F.round(F.max("score"), 6).alias("score"), F.count("*").alias("n_docs")).where("n_docs > 1")


@query(with_(*HITS) + "SELECT qid, rid, flipped, round(score, 6) AS score FROM hits QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, qid) = 1")
def e1_best_per_key(spark, sf):
    best = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "qid"))
    return hits(spark, sf).withColumn("b", best).where("b = 1").select("qid", "rid", "flipped", S.rounded(F.col("score")).alias("score"))


@query(
    with_(*SCORED[:-1], "turned AS (SELECT * REPLACE (1 - x AS x, 1 - y AS y) FROM asked_buttons)", token_sql("t_tokens", "turned", "qid"))
    + "SELECT qid, count(*) AS n_tokens, count(*) FILTER (WHERE upright AND turned) AS both_ways FROM (SELECT qid, token, bool_or(k = 0) AS upright, bool_or(k = 1) AS turned FROM (SELECT *, 0 AS k FROM q_tokens UNION ALL SELECT *, 1 FROM t_tokens) GROUP BY qid, token) GROUP BY qid"
)
def g3_orientation_union(spark, sf):
    q = asked(spark, sf)
    up = I.grid_tokens(q, "qid").withColumn("k", F.lit(0))
    down = I.grid_tokens(q.withColumns({"x": 1 - F.col("x"), "y": 1 - F.col("y")}), "qid").withColumn("k", F.lit(1))
    both = up.unionByName(down).groupBy("qid", "token").agg(F.countDistinct("k").alias("ways"))
    return both.groupBy("qid").agg(F.count("*").alias("n_tokens"), F.count_if(F.col("ways") == 2).alias("both_ways"))


@query(
    with_(*HITS)
    + "SELECT qid, rid, flipped, score FROM (SELECT qid, rid, flipped, round(score, 6) AS score, row_number() OVER (PARTITION BY qid, rid ORDER BY score DESC, way) AS b FROM (SELECT *, 0 AS way FROM hits WHERE rk <= 20 UNION ALL SELECT qid, rid, NOT flipped, score, rk, 1 FROM hits WHERE rk <= 30 AND rid % 2 = 0)) WHERE b = 1"
)
def d42_best_orientation(spark, sf):
    h = hits(spark, sf)
    first = h.where("rk <= 20").withColumn("way", F.lit(0))
    second = h.where("rk <= 30 AND rid % 2 = 0").withColumns({"flipped": ~F.col("flipped"), "way": F.lit(1)})
    best = F.row_number().over(Window.partitionBy("qid", "rid").orderBy(F.desc("score"), "way"))
    return first.unionByName(second).withColumn("b", best).where("b = 1").select("qid", "rid", "flipped", S.rounded(F.col("score")).alias("score"))


@query(with_("buttons", "records", "queries") + "SELECT q.qid, r.rid FROM queries q JOIN records r ON q.code = r.code")
def c6_code_fast_path(spark, sf):
    rows = catalogue(spark, sf)
    return M.code_hits(queries_of(rows), rows)


@query(
    with_("buttons", "records", "queries")
    + "SELECT a.code, b.code AS near, CAST(levenshtein(a.code, b.code) AS INTEGER) AS edits FROM (SELECT DISTINCT code FROM queries) a JOIN (SELECT DISTINCT code FROM records) b ON levenshtein(a.code, b.code) <= 2"
)
def c7_fuzzy_code(spark, sf):
    rows = catalogue(spark, sf)
    return M.fuzzy_codes(queries_of(rows).select("code"), rows.select("code"))


@query(with_(*HITS, "records") + "SELECT qid, rid, rk, brand, code, n_buttons FROM hits JOIN records USING (rid) WHERE rk <= 5 AND n_buttons > 20")
def c4_candidate_lookup(spark, sf):
    return hits(spark, sf).where("rk <= 5").join(catalogue(spark, sf).where("n_buttons > 20"), "rid").select("qid", "rid", "rk", "brand", "code", "n_buttons")


@query(with_(*HITS, "records") + "SELECT qid, rid, rk, brand, r.rid IS NULL AS missing FROM hits LEFT JOIN (SELECT rid, brand FROM records WHERE rid % 4 <> 0) r USING (rid) WHERE rk <= 5".replace("r.rid IS NULL", "brand IS NULL"))
def c5_candidate_left(spark, sf):
    catalog = catalogue(spark, sf).where("rid % 4 <> 0").select("rid", "brand")
    return hits(spark, sf).where("rk <= 5").join(catalog, "rid", "left").select("qid", "rid", "rk", "brand", F.col("brand").isNull().alias("missing"))


@query(with_(*ANSWERS[:-2]) + "SELECT qid, rid, round(score, 6) AS score, by_code FROM chosen")
def f2_prefilter(spark, sf):
    return M.prefilter(candidates(spark, sf)).withColumn("score", S.rounded(F.col("score")))


@query(with_(*FUSED) + "SELECT qid, rid, round(score, 6) AS tier1, by_code, fused FROM fused")
def h4_fusion(spark, sf):
    return fused(spark, sf).select("qid", "rid", S.rounded(F.col("score")).alias("tier1"), "by_code", "fused")


@query(with_(*FUSED) + "SELECT qid, rid, fused, CAST(row_number() OVER (PARTITION BY qid ORDER BY fused DESC, rid) AS INTEGER) AS rank FROM fused QUALIFY rank <= 5")
def f3_final_topk(spark, sf):
    return M.ranked(fused(spark, sf)).where(F.col("rank") <= C.TOP_K).select("qid", "rid", "fused", "rank")


@query(with_(*ANSWERS) + "SELECT * FROM answers")
def e2_margin(spark, sf):
    return answers(spark, sf)


BAND = "CASE WHEN n > 1 AND margin <= 0.01 AND top > 0.45 THEN 'low' WHEN top > 0.65 AND margin > 0.10 THEN 'high' WHEN top > 0.50 THEN 'medium' WHEN top > 0.45 THEN 'low' ELSE 'none' END"
SWEEP_BAND = "CASE WHEN top > 0.65 AND margin > 0.10 THEN 'high' WHEN top > 0.50 THEN 'medium' WHEN top > 0.45 THEN 'low' ELSE 'none' END"


@query(with_(*ANSWERS) + f"SELECT qid, {BAND} AS band, {SWEEP_BAND} AS sweep_band FROM answers")
def h3_band(spark, sf):
    top, margin = F.col("top"), F.col("margin")
    return answers(spark, sf).select("qid", S.band(top, margin, F.col("n")).alias("band"), S.sweep_band(top, margin).alias("sweep_band"))


@query(
    with_(*ANSWERS)
    + f"""SELECT qid, CASE WHEN band = 'none' AND n_buttons >= 8 AND quality >= 0.60 THEN 'not_in_catalog' WHEN band = 'none' THEN 'reshoot'
          WHEN n > 1 AND margin <= 0.01 AND top > 0.45 THEN 'tied' WHEN band <> 'high' AND code IS NULL THEN 'photograph_back' END AS hint
          FROM (SELECT *, {BAND} AS band FROM answers JOIN queries USING (qid))"""
)
def b11_hint(spark, sf):
    met = answers(spark, sf).join(queries_of(catalogue(spark, sf)), "qid")
    return met.select("qid", S.hint(*[F.col(c) for c in ("top", "margin", "n", "code", "n_buttons", "quality")]).alias("hint"))


@query(with_(*FUSED) + "SELECT qid, fused.rid, coalesce(code, 'id:' || rid) AS grp, min(rank) AS first_rank, count(*) AS n FROM (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY fused DESC, rid) AS INTEGER) AS rank FROM fused) JOIN (SELECT rid, code FROM records) USING (rid) WHERE rank <= 10) fused GROUP BY ALL".replace("fused.rid, ", "", 1))
def d28_group_candidates(spark, sf):
    top = M.ranked(fused(spark, sf)).where("rank <= 10").join(catalogue(spark, sf).select("rid", "code"), "rid")
    key = F.coalesce(F.expr("nullif(code, '')"), F.concat(F.lit("id:"), F.col("rid").cast("string")))
    return top.groupBy("qid", key.alias("grp")).agg(F.min("rank").alias("first_rank"), F.count("*").alias("n"))


@query(with_(*FUSED) + """SELECT qid, '{"record_id":"' || rid || '","by_code":' || by_code || ',"rank":' || rank || '}' AS body FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, rid) AS rank FROM fused) WHERE rank <= 3""")
def b20_candidate_json(spark, sf):
    top = M.ranked(fused(spark, sf)).where("rank <= 3")
    return top.select("qid", F.to_json(F.struct(F.col("rid").cast("string").alias("record_id"), "by_code", "rank")).alias("body"))


@query(
    with_(*HITS)
    + "SELECT qid, rid, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS INTEGER) AS place FROM hits WHERE rid % 5 <> qid % 5 QUALIFY place <= 5"
)
def c19_leave_group_out(spark, sf):
    left = hits(spark, sf).where("rid % 5 <> qid % 5")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rid"))
    return left.withColumn("place", rank).where("place <= 5").select("qid", "rid", S.rounded(F.col("score")).alias("score"), "place")


@query(with_(*FUSED) + "SELECT lpad(CAST(rank AS VARCHAR), 4, '0') || '_' || rid || '.jpg' AS name FROM (SELECT rid, row_number() OVER (ORDER BY top, rid) AS rank FROM (SELECT rid, max(fused) AS top FROM fused GROUP BY rid)) WHERE rank <= 50")
def a14_worst_overlays(spark, sf):
    worst = fused(spark, sf).groupBy("rid").agg(F.max("fused").alias("top")).orderBy("top", "rid").limit(50)
    rank = F.row_number().over(Window.orderBy("top", "rid"))
    return worst.select(F.format_string("%04d_%s.jpg", rank, F.col("rid").cast("string")).alias("name"))


@query(with_("buttons") + "SELECT count(DISTINCT rid) AS records, count(*) AS buttons, (SELECT count(*) FROM customer) AS catalogue, count(DISTINCT rid) = (SELECT count(*) FROM customer) AS in_step FROM buttons")
def d39_in_step(spark, sf):
    found = buttons(spark, sf).agg(F.countDistinct("rid").alias("records"), F.count("*").alias("buttons"))
    known = table(spark, sf, "customer").agg(F.count("*").alias("catalogue"))
    return found.join(F.broadcast(known)).select("records", "buttons", "catalogue", (F.col("records") == F.col("catalogue")).alias("in_step"))
