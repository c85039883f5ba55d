"""Stand-in views: records, buttons and a query log built from the driver's tables, for Spark and DuckDB alike."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.checkpoints import shared_folder
from tessella.functions.geometry import size_bucket

#: The order of the lines of a customer.
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buttons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line of a customer's orders. What a line needs of its keys is worked out before the joins, so
    that these move narrow rows; a reader that takes no pos has no keys of lines moved."""
    xi = (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17 + F.col("l_partkey") * 7) % 997
    yi = (F.col("l_orderkey") * 13 + F.col("l_suppkey") * 29 + F.col("l_linenumber") * 53) % 991
    color = F.concat("l_returnflag", "l_linestatus")
    lines = table(spark, sf_dir, "lineitem").select(*LINE, "l_quantity", xi.cast("short").alias("xi"), yi.cast("short").alias("yi"), color.alias("color"))
    lines = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("o_custkey").orderBy(*LINE)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    rows = lines.withColumn("pos", F.row_number().over(order)).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("o_custkey").alias("rid"),
        "pos",
        (F.col("xi").cast("double") / 997).alias("x"),
        (F.col("yi").cast("double") / 991).alias("y"),
        (F.col("l_quantity") / 150).alias("w"),
        (F.col("l_quantity") / 300).alias("h"),
        "color",
        F.col("p_name").alias("label"),
        F.col("l_partkey").alias("partkey"),
        F.col("p_brand").alias("brand"),
    )


def sized_buttons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, x, y, size, color and label of buttons(), by way of narrow rows: both places and the size bucket of a line move
    as one number, 996 more than a place of -996 to 996, 1993 for none."""
    part = lambda v: F.coalesce(v.cast("int") + 996, F.lit(1993))
    xi = (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17 + F.col("l_partkey") * 7) % 997
    yi = (F.col("l_orderkey") * 13 + F.col("l_suppkey") * 29 + F.col("l_linenumber") * 53) % 991
    packed = (part(xi) * 1994 + part(yi)) * 3 + size_bucket(F.coalesce(F.col("l_quantity") / 150, F.lit(0.0)))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", packed.alias("packed"), F.concat("l_returnflag", "l_linestatus").alias("color"))
    lines = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = lines.select(F.col("o_custkey").alias("rid"), "l_partkey", "packed", "color").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    place = lambda v, n: F.when(v < 1993, (v - 996).cast("double") / n)
    x, y = F.expr("packed div 5982").cast("int"), F.expr("packed div 3 % 1994").cast("int")
    return rows.select("rid", place(x, 997).alias("x"), place(y, 991).alias("y"), (F.col("packed") % 3).cast("int").alias("size"), "color", F.col("p_name").alias("label"))


def one_part_each(spark: SparkSession, sf_dir: str) -> bool:
    """Whether every line has a part, and one only."""
    used = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    held = table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.count("*").alias("n"))
    return used.join(held, F.col("l_partkey") == F.col("p_partkey"), "left").where("n IS NULL OR n > 1").isEmpty()


def records(spark: SparkSession, sf_dir: str, one_part: bool = False) -> DataFrame:
    """One row for each customer, with or without buttons. The first button is the least by the keys of lines, found
    order by order before customers meet. one_part: every line is known to have one part, so that parts need to meet the
    first lines only, and lines move as one row an order."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    lines = table(spark, sf_dir, "lineitem").select(*LINE)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("rid"))
    if one_part:
        first = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min(F.struct(*LINE)).alias("f"))
        found = first.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("rid").agg(F.sum("n").alias("n"), F.min("f").alias("f"))
        found = found.join(parts, F.col("f.l_partkey") == F.col("p_partkey")).select("rid", "n", F.col("f").withField("brand", F.col("brand")).alias("f"))
    else:
        lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        found = lines.groupBy("rid").agg(F.count("*").alias("n"), F.min(F.struct(*LINE, "brand")).alias("f"))
    rid = F.col("c_custkey")
    out = table(spark, sf_dir, "customer").select("c_custkey").join(found, rid == F.col("rid"), "left")
    code = F.concat(F.lit("RM"), (F.col("f.l_partkey") % 700 + 100).cast("string"))
    return out.select(
        rid.alias("rid"),
        F.col("f.brand").alias("brand"),
        F.when(rid % 3 != 0, code).alias("code"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_buttons"),
        (1 + (rid % 60).cast("double") / 10).alias("aspect"),
        ((rid % 83).cast("double") / 83).alias("area_frac"),
        ((rid % 89).cast("double") / 89).alias("quality"),
        ((rid % 97).cast("double") / 97).alias("orientation_conf"),
    )


def written(lines: DataFrame, name: str) -> str:
    """A column of text as files of lines in the shared folder, for readers to read."""
    folder = f"{shared_folder(lines.sparkSession)}/{name}-{uuid.uuid4().hex}"
    lines.toDF("value").write.text(folder)
    return folder


SQL = {
    "buttons": """buttons AS (
        SELECT o_custkey AS rid,
               CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS pos,
               CAST((l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7) % 997 AS DOUBLE) / 997 AS x,
               CAST((l_orderkey * 13 + l_suppkey * 29 + l_linenumber * 53) % 991 AS DOUBLE) / 991 AS y,
               l_quantity / 150 AS w, l_quantity / 300 AS h, l_returnflag || l_linestatus AS color,
               p_name AS label, l_partkey AS partkey, p_brand AS brand
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    "records": """records AS (
        SELECT c_custkey AS rid, brand, CASE WHEN c_custkey % 3 <> 0 THEN 'RM' || CAST(partkey % 700 + 100 AS VARCHAR) END AS code,
               coalesce(n, 0) AS n_buttons, 1 + CAST(c_custkey % 60 AS DOUBLE) / 10 AS aspect,
               CAST(c_custkey % 83 AS DOUBLE) / 83 AS area_frac, CAST(c_custkey % 89 AS DOUBLE) / 89 AS quality,
               CAST(c_custkey % 97 AS DOUBLE) / 97 AS orientation_conf
        FROM customer LEFT JOIN (SELECT rid, count(*) AS n, arg_min(brand, pos) AS brand, arg_min(partkey, pos) AS partkey FROM buttons GROUP BY rid) f
             ON c_custkey = rid)""",
}


def with_(*parts: str) -> str:
    """A WITH clause of named views (keys of SQL) and further CTEs."""
    return "WITH " + ",\n".join(SQL.get(p, p) for p in parts) + "\n"
