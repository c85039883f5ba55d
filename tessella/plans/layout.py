"""Queries of geometry: spatial joins in a record, crops of a photo, audit and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import config as C
from tessella.functions import geometry as G
from tessella.functions import text as T
from tessella.operators import layout as L
from tessella.registry import query

from .views import SQL, buttons, records, table, with_

SQL["regions"] = """regions AS (
    SELECT rid, pos AS region, x + 0.03e0 AS x, y + 0.02e0 AS y, w * 2 AS w, h / 2 AS h, label AS text, CAST(pos % 10 AS DOUBLE) / 10 AS conf
    FROM buttons WHERE pos % 4 = 0)"""
SQL["crops"] = """crops AS (
    SELECT o_custkey AS photo, o_orderkey AS crop, count(l_orderkey) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS regions,
           CAST(o_orderkey % 71 AS DOUBLE) / 71 AS area_frac,
           count(l_orderkey) / (CAST(1 + o_orderkey % 71 AS DOUBLE) / 71 * 10) AS density
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 30 GROUP BY o_custkey, o_orderkey)"""
SQL["dense"] = """dense AS (
    SELECT *, coalesce(density > 3.0 OR (count(*) OVER p > 1 AND density > 1.0 AND density > 3.0 * min(CASE WHEN density > 0 THEN density END) OVER p), false) AS dense
    FROM crops WINDOW p AS (PARTITION BY photo))"""
SQL["verdicts"] = """verdicts AS (
    SELECT *, CASE WHEN n = 0 AND regions = 0 THEN 'empty' WHEN sparse THEN 'sparse' WHEN dense THEN 'dense' END AS reason FROM (
        SELECT *, coalesce(count(*) OVER p > 1 AND n < 0.2 * max(CASE WHEN NOT dense THEN n END) OVER p AND n < 12, false) AS sparse
        FROM dense WINDOW p AS (PARTITION BY photo)))"""


def regions(spark: SparkSession, sf_dir: str, b: DataFrame | None = None) -> DataFrame:
    b = (buttons(spark, sf_dir) if b is None else b).where("pos % 4 = 0")
    conf = (F.col("pos") % 10).cast("double") / 10
    return b.select("rid", F.col("pos").alias("region"), (F.col("x") + 0.03).alias("x"), (F.col("y") + 0.02).alias("y"), (F.col("w") * 2).alias("w"), (F.col("h") / 2).alias("h"), F.col("label").alias("text"), conf.alias("conf"))


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as crops of a customer's photo; their lines as detections."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 30").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("regions"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    n, key = F.coalesce("n", F.lit(0)), F.col("o_orderkey")
    density = n / ((1 + key % 71).cast("double") / 71 * 10)
    return o.select(F.col("o_custkey").alias("photo"), key.alias("crop"), n.alias("n"), F.coalesce("regions", F.lit(0)).alias("regions"), ((key % 71).cast("double") / 71).alias("area_frac"), density.alias("density"))



@query(
    with_(SQL["buttons"].replace(" AS (", " AS MATERIALIZED (", 1))
    + """SELECT rid, pos, pos_c, round(d + CASE WHEN color <> color_c THEN 0.35 ELSE 0 END, 6) AS cost FROM (
        SELECT a.rid, a.pos, b.pos AS pos_c, a.color, b.color AS color_c, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d,
               greatest(a.w * a.h, 1e-9) AS p, greatest(b.w * b.h, 1e-9) AS q
        FROM buttons a JOIN (SELECT * REPLACE (rid - 1 AS rid) FROM buttons) b ON a.rid = b.rid) WHERE d <= 0.25 AND greatest(p / q, q / p) <= 2.2e0 * 2.2e0"""
)
def c8_pair_theta(spark, sf):
    b = buttons(spark, sf)
    met = L.candidate_pairs(b, b.withColumn("rid", F.col("rid") - 1), "rid")
    return met.select("rid", "pos", "pos_c", F.round("cost", 6).alias("cost"))


@query(
    with_("buttons", "regions")
    + """SELECT rid, pos, region, round(d, 6) AS d FROM (
        SELECT * FROM (SELECT b.rid, pos, region, r.w AS rw, sqrt((b.x - r.x) * (b.x - r.x) + (b.y - r.y) * (b.y - r.y)) AS d FROM buttons b JOIN regions r USING (rid))
        QUALIFY row_number() OVER (PARTITION BY rid, region ORDER BY d, pos) = 1) WHERE d <= 0.09 AND rw < 0.55
        QUALIFY row_number() OVER (PARTITION BY rid, pos ORDER BY d, region) = 1"""
)
def c9_nearest_label(spark, sf):
    b = buttons(spark, sf)
    return L.nearest_labels(b, regions(spark, sf, b)).withColumn("d", F.round("d", 6))


OVERLAP = "greatest(least(a.x + a.w / 2, b.x + b.w / 2) - greatest(a.x - a.w / 2, b.x - b.w / 2), 0) * greatest(least(a.y + a.h / 2, b.y + b.h / 2) - greatest(a.y - a.h / 2, b.y - b.h / 2), 0)"


@query(
    with_("buttons", "regions")
    + f"""SELECT verdict, count(*) AS n FROM (
        SELECT CASE WHEN least(part / area, 1) < 0.6 THEN 'kept' WHEN widest >= 0.55 THEN 'caption' WHEN area / largest >= 2 THEN 'kept' ELSE 'text' END AS verdict FROM (
            SELECT rid, pos, greatest(any_value(aw * ah), 1e-9) AS area, sum(part) AS part, max(bw) FILTER (WHERE part > 0) AS widest, max(bw * bh) FILTER (WHERE part > 0) AS largest
            FROM (SELECT a.rid, a.pos, a.w AS aw, a.h AS ah, b.w AS bw, b.h AS bh, coalesce({OVERLAP}, 0) AS part FROM buttons a LEFT JOIN regions b USING (rid)) GROUP BY rid, pos)) GROUP BY verdict"""
)
def c10_overlap_suppress(spark, sf):
    b = buttons(spark, sf)
    return L.suppression(L.covered_share(b, regions(spark, sf, b))).groupBy("verdict").agg(F.count("*").alias("n"))


@query(with_("buttons") + f"SELECT a.rid, a.pos, count(*) AS n_inside FROM buttons a JOIN buttons b ON a.rid = b.rid AND a.pos <> b.pos WHERE {OVERLAP} / greatest(b.w * b.h, 1e-9) > 0.85 GROUP BY a.rid, a.pos HAVING count(*) >= 3")
def c11_containers(spark, sf):
    return L.containers(buttons(spark, sf))


NEAR = "sqrt((r.x - o.x) * (r.x - o.x) + (r.y - o.y) * (r.y - o.y))"


@query(with_("buttons", "regions") + f"SELECT rid, region FROM regions r WHERE NOT EXISTS (SELECT 1 FROM regions o WHERE o.rid = r.rid AND o.region <> r.region AND {NEAR} < 0.12)")
def c12_isolated(spark, sf):
    return L.isolated(regions(spark, sf)).select("rid", "region")


@query(with_("buttons", "regions") + f"SELECT rid, region FROM regions r WHERE EXISTS (SELECT 1 FROM buttons o WHERE o.rid = r.rid AND {NEAR} < 0.05)")
def c13_near_button(spark, sf):
    b = buttons(spark, sf)
    return L.near_button(regions(spark, sf, b), b).select("rid", "region")


@query(
    with_("buttons", "regions", "o AS (SELECT rid, count(*) AS orphans FROM regions r WHERE w < 0.55 AND NOT EXISTS (SELECT 1 FROM buttons b WHERE b.rid = r.rid AND pos % 2 = 1 AND abs(b.x - r.x) < 0.09 AND abs(b.y - r.y) < 0.09) GROUP BY rid)", "n AS (SELECT rid, count(*) AS n FROM buttons WHERE pos % 2 = 1 GROUP BY rid)")
    + "SELECT rid, coalesce(orphans, 0) AS orphans, round(coalesce(orphans, 0) / greatest(1, n + coalesce(orphans, 0)), 6) AS share FROM n LEFT JOIN o USING (rid)"
)
def c14_orphans(spark, sf):
    b = buttons(spark, sf)
    odd = b.where("pos % 2 = 1")
    found = L.orphans(odd, regions(spark, sf, b)).groupBy("rid").agg(F.count("*").alias("orphans"))
    o = F.coalesce("orphans", F.lit(0))
    return odd.groupBy("rid").agg(F.count("*").alias("n")).join(found, "rid", "left").select("rid", o.alias("orphans"), F.round(o / F.greatest(F.lit(1), F.col("n") + o), 6).alias("share"))


@query(with_("crops") + "SELECT photo, crop, greatest(crop % 1000, photo % 900) >= 500 AS kept FROM crops")
def b1_size_floor(spark, sf):
    side = F.greatest(F.col("crop") % 1000, F.col("photo") % 900)
    return crops(spark, sf).select("photo", "crop", (side >= C.MIN_SOURCE_PIXELS).alias("kept"))


@query(with_("crops", "dense", "verdicts") + "SELECT photo, crop, n, sparse FROM verdicts")
def b2_sparse_sibling(spark, sf):
    return L.crop_verdicts(crops(spark, sf)).select("photo", "crop", "n", "sparse")


@query(with_("crops", "dense", "verdicts") + "SELECT photo, crop, round(density, 6) AS density, dense, reason FROM verdicts")
def b3_density(spark, sf):
    return L.crop_verdicts(crops(spark, sf)).select("photo", "crop", F.round("density", 6).alias("density"), "dense", "reason")


@query(with_("crops", "dense") + "SELECT photo, crop, n FROM (SELECT *, min(dense::INTEGER) OVER (PARTITION BY photo) AS lo FROM dense) QUALIFY row_number() OVER (PARTITION BY photo ORDER BY (dense AND lo = 0)::INTEGER, n DESC, crop) = 1")
def b4_query_body_choice(spark, sf):
    return L.query_body(L.crop_verdicts(crops(spark, sf))).select("photo", "crop", "n")


@query(with_("crops") + "SELECT photo, round(sum(area_frac), 6) AS area, count(*) AS n FROM crops GROUP BY photo HAVING sum(area_frac) < 0.95 AND NOT bool_or(crop % 13 = 0)")
def b7_fragment_selection(spark, sf):
    out = crops(spark, sf).groupBy("photo").agg(F.sum("area_frac").alias("s"), F.bool_or(F.col("crop") % 13 == 0).alias("full"), F.count("*").alias("n"))
    return out.where((F.col("s") < 0.95) & ~F.col("full")).select("photo", F.round("s", 6).alias("area"), "n")


@query(with_("crops") + "SELECT photo, round(min(density) FILTER (WHERE density > 0), 6) AS least_density, max(n) AS most, round(sum(area_frac), 6) AS area, max(crop) - min(crop) AS span FROM crops GROUP BY photo")
def d36_photo_aggregates(spark, sf):
    return crops(spark, sf).groupBy("photo").agg(
        F.round(F.min(F.when(F.col("density") > 0, F.col("density"))), 6).alias("least_density"), F.max("n").alias("most"), F.round(F.sum("area_frac"), 6).alias("area"), (F.max("crop") - F.min("crop")).alias("span")
    )


@query(with_("buttons") + "SELECT rid, pos, '0 ' || printf('%.6f', x) || ' ' || printf('%.6f', y) || ' ' || printf('%.6f', w) || ' ' || printf('%.6f', h) AS line FROM buttons WHERE x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND w > 0 AND w <= 1 AND h > 0 AND h <= 1 AND x - w / 2 >= -0.01 AND x + w / 2 <= 1.01 AND y - h / 2 >= -0.01 AND y + h / 2 <= 1.01")
def a11_yolo_lines(spark, sf):
    return buttons(spark, sf).where(in_range()).select("rid", "pos", F.format_string("0 %.6f %.6f %.6f %.6f", "x", "y", "w", "h").alias("line"))


def in_range():
    x, y, w, h = (F.col(c) for c in "xywh")
    inside = x.between(0, 1) & y.between(0, 1) & (w > 0) & (w <= 1) & (h > 0) & (h <= 1)
    return inside & (x - w / 2 >= -0.01) & (x + w / 2 <= 1.01) & (y - h / 2 >= -0.01) & (y + h / 2 <= 1.01)


@query(with_("buttons") + "SELECT x - w / 2 >= -0.01 AND x + w / 2 <= 1.01 AND y - h / 2 >= -0.01 AND y + h / 2 <= 1.01 AND w > 0 AND h > 0 AS inside, count(*) AS n FROM buttons GROUP BY 1")
def b14_box_filter(spark, sf):
    return buttons(spark, sf).groupBy(in_range().alias("inside")).agg(F.count("*").alias("n"))


@query(with_("buttons") + "SELECT rid, pos, round(1 - x, 4) AS x, round(1 - y, 4) AS y, CASE pos % 5 WHEN 0 THEN 'on' WHEN 1 THEN 'below' WHEN 2 THEN 'above' WHEN 3 THEN 'right' ELSE 'left' END AS label_pos FROM buttons")
def h5_flip(spark, sf):
    place = F.get(F.array(*[F.lit(p) for p in ("on", "above", "below", "left", "right")]), (F.col("pos") % 5).cast("int"))
    b = buttons(spark, sf).withColumn("label_pos", place)
    turned = G.flip_buttons(F.array(F.struct("x", "y", "label_pos")))
    return b.select("rid", "pos", F.get(turned, F.lit(0)).alias("b")).select("rid", "pos", "b.x", "b.y", "b.label_pos")


@query(with_("buttons") + "SELECT rid, pos, round((x - w / 2) * 100, 4) AS left_, round(greatest(x - w / 2, 0) + least(x + w / 2, 1), 6) AS twice_x, round(least(y + h / 2, 1) - greatest(y - h / 2, 0), 6) AS inner_h FROM buttons")
def h6_box_convert(spark, sf):
    ls = G.percent_box(*[F.col(c) for c in "xywh"])
    b = buttons(spark, sf).withColumn("ls", ls)
    b = b.withColumn("back", G.centre_box(*[F.col(f"ls.{c}") for c in ("left", "top", "width", "height")]))
    return b.select("rid", "pos", F.round("ls.left", 4).alias("left_"), F.round(F.col("back.x") * 2, 6).alias("twice_x"), F.round("back.h", 6).alias("inner_h"))


@query(with_("buttons") + "SELECT CASE WHEN w < 0.12 THEN 0 WHEN w < 0.25 THEN 1 ELSE 2 END AS size, CAST(floor(least(greatest(x, 0), 0.999999) * 12) AS INTEGER) AS cell, count(*) AS n FROM buttons GROUP BY ALL")
def h7_cells(spark, sf):
    return buttons(spark, sf).groupBy(G.size_bucket(F.col("w")).alias("size"), F.get(G.cells(F.col("x"), C.GRID_X), F.lit(0)).alias("cell")).agg(F.count("*").alias("n"))


@query(with_("buttons", "regions") + "SELECT rid, region, CAST(row_number() OVER (PARTITION BY rid ORDER BY round(y, 3), x, region) AS INTEGER) AS place FROM regions WHERE conf >= 0.35 AND rid % 5 <> 0 QUALIFY place <= 120")
def b16_region_filter(spark, sf):
    r = regions(spark, sf).where("conf >= 0.35 AND rid % 5 <> 0")
    place = F.row_number().over(Window.partitionBy("rid").orderBy(F.round("y", 3), "x", "region"))
    return r.withColumn("place", place).where("place <= 120").select("rid", "region", "place")


@query("WITH p AS (SELECT o_custkey AS photo, o_orderkey AS col, o_orderkey % 3 <> 0 AS valley, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) SELECT photo, min(col) AS first_col, max(col) AS last_col, count(*) AS width FROM (SELECT *, i - row_number() OVER (PARTITION BY photo ORDER BY i) AS g FROM p WHERE valley) GROUP BY photo, g")
def e7_islands(spark, sf):
    every = Window.partitionBy("photo")
    p = table(spark, sf, "orders").select(F.col("o_custkey").alias("photo"), F.col("o_orderkey").alias("col"))
    p = p.withColumn("i", F.row_number().over(every.orderBy("col"))).where("col % 3 <> 0")
    p = p.withColumn("g", F.col("i") - F.row_number().over(every.orderBy("i")))
    return p.groupBy("photo", "g").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"), F.count("*").alias("width")).drop("g")


@query("SELECT o_custkey AS photo, o_orderkey AS col, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS smooth FROM orders")
def e8_smooth(spark, sf):
    near = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 2)
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("photo"), F.col("o_orderkey").alias("col"), F.round(F.avg("o_totalprice").over(near), 4).alias("smooth"))


@query("SELECT c_custkey AS rid, i AS band, round(greatest(0, i * (1 + c_custkey % 9) / 4e0 - 0.1 * (1 + c_custkey % 9) / 4e0), 6) AS top, round(least(1 + c_custkey % 9, (i + 1) * (1 + c_custkey % 9) / 4e0 + 0.1 * (1 + c_custkey % 9) / 4e0), 6) AS bottom FROM customer, (SELECT unnest(range(0, 4)) AS i)")
def e9_bands(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("rid"), (1 + F.col("c_custkey") % 9).alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("band"))
    step = F.col("h") / 4
    top, bottom = F.greatest(F.lit(0.0), F.col("band") * step - 0.1 * step), F.least(F.col("h").cast("double"), (F.col("band") + 1) * step + 0.1 * step)
    return c.select("rid", "band", F.round(top, 6).alias("top"), F.round(bottom, 6).alias("bottom"))


FLAGS = """flags AS (SELECT rid, quality, unnest([
        CASE WHEN n_buttons = 0 THEN '3no buttons detected' WHEN n_buttons < 6 THEN '3only ' || n_buttons || ' buttons' WHEN n_buttons > 70 THEN '2' || n_buttons || ' buttons, over plausible max' END,
        CASE WHEN area_frac < 0.12 THEN '3body is small' END, CASE WHEN aspect < 1.5 OR aspect > 7.0 THEN '2implausible aspect (' || CAST(CAST(round(aspect * 10) AS INTEGER) AS VARCHAR) || ' tenths)' END,
        CASE WHEN orientation_conf < 0.35 THEN '2orientation unresolved' END, CASE WHEN brand IS NULL AND code IS NULL THEN '1no brand and no model code' END,
        CASE WHEN quality < 0.5 THEN '2quality is low' END]) AS flag FROM records)"""


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records with `flags`, an array of (severity, reason)."""
    flag = lambda when, severity, reason: F.when(when, F.struct(F.lit(severity).alias("severity"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason")))
    n, text = F.col("n_buttons"), lambda c: c.cast("string")
    made = F.array(
        flag(n == 0, 3, "no buttons detected"),
        flag((n > 0) & (n < 6), 3, F.concat(F.lit("only "), text(n), F.lit(" buttons"))),
        flag(n > 70, 2, F.concat(text(n), F.lit(" buttons, over plausible max"))),
        flag(F.col("area_frac") < 0.12, 3, "body is small"),
        flag(~F.col("aspect").between(1.5, 7.0), 2, F.concat(F.lit("implausible aspect ("), text(F.round(F.col("aspect") * 10).cast("int")), F.lit(" tenths)"))),
        flag(F.col("orientation_conf") < 0.35, 2, "orientation unresolved"),
        flag(F.col("brand").isNull() & F.col("code").isNull(), 1, "no brand and no model code"),
        flag(F.col("quality") < 0.5, 2, "quality is low"),
    )
    return records(spark, sf_dir).withColumn("flags", F.array_compact(made))


@query(with_("buttons", "records", FLAGS) + "SELECT rid, CAST(substr(flag, 1, 1) AS INTEGER) AS severity, substr(flag, 2) AS reason FROM flags WHERE flag IS NOT NULL")
def b5_audit_flags(spark, sf):
    return flags(spark, sf).select("rid", F.inline("flags"))


@query(with_("buttons", "records", FLAGS) + "SELECT rid, CAST(max(substr(flag, 1, 1)) AS INTEGER) AS worst, count(flag) AS n, round(any_value(quality), 6) AS quality FROM flags GROUP BY rid HAVING count(flag) > 0 ORDER BY worst DESC, n DESC, any_value(quality), rid LIMIT 50")
def b6_audit_queue(spark, sf):
    f = flags(spark, sf).where(F.size("flags") > 0).select("rid", F.array_max("flags.severity").alias("worst"), F.size("flags").cast("long").alias("n"), "quality")
    return f.orderBy(F.desc("worst"), F.desc("n"), "quality", "rid").limit(50).withColumn("quality", F.round("quality", 6))


@query(with_("buttons", "records", FLAGS) + "SELECT rtrim(split_part(substr(flag, 2), '(', 1)) AS reason, count(*) AS n FROM flags WHERE flag IS NOT NULL GROUP BY 1")
def d16_flag_tally(spark, sf):
    return flags(spark, sf).select(F.explode("flags.reason").alias("r")).groupBy(T.reason_prefix(F.col("r")).alias("reason")).agg(F.count("*").alias("n"))


@query(with_("buttons", "records") + "SELECT rid, CASE WHEN quality >= 0.80 AND n_buttons >= 5 THEN 'trusted' WHEN quality < 0.55 THEN 'hard' ELSE 'neither' END AS tier FROM records")
def b12_quality_tiers(spark, sf):
    tier = F.when((F.col("quality") >= C.TRUSTED_QUALITY) & (F.col("n_buttons") >= C.TRUSTED_BUTTONS), "trusted").when(F.col("quality") < C.HARD_QUALITY, "hard").otherwise("neither")
    return records(spark, sf).select("rid", tier.alias("tier"))


@query(with_("buttons", "regions") + "SELECT rid, b.n > 0 AND coalesce(t.n, 0) > b.n AS printed FROM (SELECT rid, count(*) FILTER (WHERE pos % 5 = 0) AS n FROM buttons GROUP BY rid) b LEFT JOIN (SELECT rid, count(*) AS n FROM regions GROUP BY rid) t USING (rid)")
def b13_printed_page(spark, sf):
    b = buttons(spark, sf)
    n = b.groupBy("rid").agg(F.count_if(F.col("pos") % 5 == 0).alias("n")).join(regions(spark, sf, b).groupBy("rid").agg(F.count("*").alias("t")), "rid", "left")
    return n.select("rid", ((F.col("n") > 0) & (F.coalesce("t", F.lit(0)) > F.col("n"))).alias("printed"))


QUEUE = "q AS (SELECT rid, quality, n_buttons, CAST(rid % 101 AS DOUBLE) / 101 AS share FROM records WHERE n_buttons > 0)"


@query(
    with_("buttons", "records", QUEUE)
    + """, top AS (SELECT * FROM q ORDER BY share DESC, rid LIMIT 20),
    rest AS (SELECT *, row_number() OVER (ORDER BY quality, rid) - 1 AS i, count(*) OVER () AS n FROM q WHERE rid NOT IN (SELECT rid FROM top))
    SELECT rid, 'orphans' AS part FROM top UNION ALL SELECT rid, 'stride' FROM rest WHERE i IN (SELECT CAST(floor(k * n / 20) AS BIGINT) FROM (SELECT unnest(range(0, 20)) AS k), (SELECT max(n) AS n FROM rest))"""
)
def f7_label_queue(spark, sf):
    q = records(spark, sf).where("n_buttons > 0").withColumn("share", (F.col("rid") % 101).cast("double") / 101)
    top = q.orderBy(F.desc("share"), "rid").limit(20).select("rid")
    return top.withColumn("part", F.lit("orphans")).unionByName(stride(q.join(top, "rid", "left_anti"), 20).select("rid", F.lit("stride").alias("part")))


def stride(rows: DataFrame, k: int) -> DataFrame:
    """k rows evenly spread over the order of quality: the places int(i * n / k). The places come from
    counts of coarse quality bins, so that only a bin is sorted in one task."""
    binned = rows.withColumn("bin", F.floor(F.col("quality") * 64).cast("int"))
    counts = binned.groupBy("bin").agg(F.count("*").alias("c"))
    before = counts.select("bin", F.coalesce(F.sum("c").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))
    within = F.row_number().over(Window.partitionBy("bin").orderBy("quality", "rid"))
    placed = binned.withColumn("within", within).join(F.broadcast(before), "bin").withColumn("i", F.col("before") + F.col("within") - 1)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda x: F.floor(x * F.col("n") / k))
    return placed.where(F.array_contains(wanted, F.col("i")))


@query(with_("buttons", "records", QUEUE) + "SELECT rid, i FROM (SELECT rid, row_number() OVER (ORDER BY quality, rid) - 1 AS i, count(*) OVER () AS n FROM q) WHERE i IN (SELECT CAST(floor(k * (SELECT count(*) FROM q) / 40) AS BIGINT) FROM (SELECT unnest(range(0, 40)) AS k))")
def e6_stride(spark, sf):
    return stride(records(spark, sf).where("n_buttons > 0"), 40).select("rid", "i")


@query(with_("buttons", "records", QUEUE) + "SELECT rid || '.jpg' AS image, round(quality, 6) AS quality, n_buttons AS buttons, CAST(floor(share * n_buttons) AS BIGINT) AS orphans, round(share, 6) AS share FROM q WHERE quality < 0.55")
def a12_queue_manifest(spark, sf):
    share = (F.col("rid") % 101).cast("double") / 101
    q = records(spark, sf).where((F.col("n_buttons") > 0) & (F.col("quality") < C.HARD_QUALITY))
    return q.select(F.concat(F.col("rid").cast("string"), F.lit(".jpg")).alias("image"), F.round("quality", 6).alias("quality"), F.col("n_buttons").alias("buttons"), F.floor(share * F.col("n_buttons")).alias("orphans"), F.round(share, 6).alias("share"))


@query(with_("buttons", "records", QUEUE) + "SELECT count(*) AS tasks, sum(n_buttons)::BIGINT AS boxes, count(*) FILTER (WHERE n_buttons < 10) AS small_tasks FROM q")
def d41_queue_totals(spark, sf):
    return records(spark, sf).where("n_buttons > 0").agg(F.count("*").alias("tasks"), F.sum("n_buttons").alias("boxes"), F.count_if(F.col("n_buttons") < 10).alias("small_tasks"))


@query(with_("buttons", "records") + "SELECT rid, orientation_conf < 0.75 AS record_ambiguous, orientation_conf < 0.75 OR rid % 2 = 0 AS query_ambiguous FROM records")
def b17_orientation_flags(spark, sf):
    open_ = F.col("orientation_conf") < C.ORIENTATION_TRUST
    return records(spark, sf).select("rid", open_.alias("record_ambiguous"), (open_ | (F.col("rid") % 2 == 0)).alias("query_ambiguous"))
