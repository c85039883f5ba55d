"""Queries of what was read: codes, colours, orientation, rebuild lists; brands, stamps and engines in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import config as C
from tessella.operators import reading as R
from tessella.registry import query

from .catalog import WORDS
from .views import SQL, buttons, table, with_

SQL["printed"] = """printed AS (
    SELECT rid, pos AS region, x, y, CAST(pos % 10 AS DOUBLE) / 10 AS conf, CAST(1 + pos % 2 AS INTEGER) AS agree,
           CASE WHEN pos % 8 = 1 THEN 'HDMI2 RM-D' || (partkey % 900 + 100) ELSE 'BN' || (partkey % 90 + 10) || 'A AB ' || (partkey % 9000 + 1000) END AS text
    FROM buttons WHERE pos % 4 = 1)"""


def printed(b: DataFrame) -> DataFrame:
    """Every fourth button as a region with printed text."""
    part = lambda n, low: (F.col("partkey") % n + low).cast("string")
    text = F.when(F.col("pos") % 8 == 1, F.concat(F.lit("HDMI2 RM-D"), part(900, 100))).otherwise(F.concat(F.lit("BN"), part(90, 10), F.lit("A AB "), part(9000, 1000)))
    conf, agree = (F.col("pos") % 10).cast("double") / 10, (1 + F.col("pos") % 2).cast("int")
    return b.where("pos % 4 = 1").select("rid", F.col("pos").alias("region"), "x", "y", conf.alias("conf"), agree.alias("agree"), text.alias("text"))


@query(
    with_("buttons", "printed")
    + f"""SELECT rid, arg_max(replace(tok, ' ', '-'), (score, -region, -i)) AS code FROM (
        SELECT *, round(1.0e0 + conf + CASE WHEN y > 0.75 THEN 0.5 ELSE 0 END + CASE WHEN alone THEN 0.5 ELSE 0 END + CASE WHEN contains(tok, '-') THEN 0.75 ELSE 0 END
                  - CASE WHEN legend THEN 0.6 ELSE 0 END + CASE WHEN agree > 1 THEN 0.25 ELSE 0 END, 9) AS score FROM (
            SELECT rid, region, y, conf, agree, unnest(l) AS tok, generate_subscripts(l, 1) AS i, alone, legend FROM (
                SELECT *, regexp_extract_all(text, '{C.MODEL_PATTERN}') AS l,
                       NOT EXISTS (SELECT 1 FROM printed o WHERE o.rid = p.rid AND o.region <> p.region AND sqrt((o.x - p.x) ** 2 + (o.y - p.y) ** 2) < 0.12) AS alone,
                       EXISTS (SELECT 1 FROM buttons b WHERE b.rid = p.rid AND b.pos % 4 <> 1 AND sqrt((p.x - b.x) ** 2 + (p.y - b.y) ** 2) < 0.05) AS legend
                FROM printed p)))
        WHERE regexp_replace(tok, '[- ]', '', 'g') NOT IN ({WORDS}) AND length(regexp_replace(tok, '[- ]', '', 'g')) >= 5
              AND regexp_matches(tok, '[0-9]') AND regexp_matches(tok, '[A-Z]') GROUP BY rid"""
)
def h8_printed_code(spark, sf):
    b = buttons(spark, sf)
    return R.find_model_code(printed(b), b.where("pos % 4 <> 1"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN v < 65 THEN 'black' WHEN s < 85 THEN CASE WHEN v > 185 THEN 'white' ELSE 'grey' END
       WHEN h BETWEEN 0 AND 8 OR h BETWEEN 172 AND 180 THEN 'red' WHEN h BETWEEN 9 AND 22 THEN 'orange' WHEN h BETWEEN 23 AND 33 THEN 'yellow'
       WHEN h BETWEEN 34 AND 85 THEN 'green' WHEN h BETWEEN 86 AND 130 THEN 'blue' WHEN h BETWEEN 131 AND 158 THEN 'purple' ELSE 'grey' END AS colour
       FROM (SELECT l_orderkey, l_linenumber, l_partkey * 7 % 181 AS h, l_suppkey * 13 % 256 AS s, l_orderkey * 5 % 256 AS v FROM lineitem)""")
def h9_colour_name(spark, sf):
    name = R.colour_name(F.col("l_partkey") * 7 % 181, F.col("l_suppkey") * 13 % 256, F.col("l_orderkey") * 5 % 256)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", name.alias("colour"))


@query("""SELECT rid, CASE WHEN text THEN down > up ELSE flip END AS flip, CASE WHEN text THEN false ELSE conf < 0.25 END AS ambiguous,
       round(CASE WHEN text THEN least(0.5 + margin, 1) ELSE conf END, 3) AS confidence, CASE WHEN text THEN 'text' ELSE 'geometry' END AS source FROM (
       SELECT *, abs(up - down) / (up + down) AS margin, up + down >= 1 AND abs(up - down) / (up + down) >= 0.25 AS text FROM (
           SELECT c_custkey AS rid, CAST(c_custkey % 13 AS DOUBLE) / 4 AS up, CAST(c_custkey % 7 AS DOUBLE) / 2 AS down, c_custkey % 2 = 0 AS flip, CAST(c_custkey % 97 AS DOUBLE) / 97 AS conf FROM customer))""")
def h10_orientation_text(spark, sf):
    rid = F.col("c_custkey")
    conf = (rid % 97).cast("double") / 97
    said = R.orientation_from_text((rid % 13).cast("double") / 4, (rid % 7).cast("double") / 2, rid % 2 == 0, conf < 0.25, conf)
    return table(spark, sf, "customer").select(rid.alias("rid"), said.alias("s")).select("rid", "s.flip", "s.ambiguous", F.round("s.confidence", 3).alias("confidence"), "s.source")


@query("""WITH low AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING NOT bool_or(o_orderkey % 29 = 0) AND sum(CAST(o_orderkey % 71 AS DOUBLE) / 71) < 4)
       SELECT 'photo' || k AS stem, n, k IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) AS listed FROM low""")
def c28_rebuild_list(spark, sf):
    """Photos to extract again, and whether the manifest has a line for each (else they are left alone)."""
    key = F.col("o_orderkey")
    record_id = F.concat(F.lit("photo"), F.col("o_custkey").cast("string"), F.lit("_"), key.cast("string"))
    made = table(spark, sf, "orders").select(record_id.alias("record_id"), ((key % 71).cast("double") / 71).alias("area_frac"), (key % 29 == 0).alias("full_frame"))
    manifest = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("photo"), F.col("c_custkey").cast("string")).alias("stem"), F.lit(True).alias("listed"))
    return R.affected_stems(made, 4.0).join(manifest, "stem", "left").select("stem", "n", F.coalesce("listed", F.lit(False)).alias("listed"))


def read_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as regions of a record."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rid"), F.posexplode(F.split("text", "\n")).alias("region", "text"))
    k = F.col("region")
    return lines.where(F.length("text") > 0).select("rid", "region", (k % 10 / 10).alias("y"), (0.01 + k % 4 / 100).alias("h"), "text", ((k * 7) % 10 / 10).alias("conf"))


@query()
def v8_find_brand(spark, sf):
    brands = table(spark, sf, "part").select(F.col("p_name").alias("brand")).distinct()
    return R.find_brand(read_text(spark, sf), brands)


@query()
def v9_drop_stamps(spark, sf):
    kept = R.drop_stamps(read_text(spark, sf), ["LICENSED"], ["LICENSEDUNDERTHEAPACHELICENSE"])
    return kept.groupBy("rid").agg(F.count("*").alias("n"))


@query()
def v10_agreed_regions(spark, sf):
    b = buttons(spark, sf).where("pos % 4 = 0")
    text = F.when((F.col("engine") == 1) & (F.col("pos") % 8 == 0), F.reverse("label")).otherwise(F.col("label"))
    conf = (F.col("pos") * 3 + F.col("engine")) % 10 / 10
    twice = b.withColumn("engine", F.explode(F.array(F.lit(0), F.lit(1))))
    return R.agreed_regions(twice.withColumns({"x": F.col("x") + F.col("engine") * 0.01, "text": text, "conf": conf})).drop("engines")
