"""Spatial operators inside a record, and rules over the crops of a photo."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella import config as C
from tessella.functions.geometry import overlap


def candidate_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Button pairs of each key that lie near and have similar areas, with their cost.

    left, right: key, pos, x, y, w, h, color; the right columns come out with the suffix _c."""
    other = right.select(key, *[F.col(c).alias(f"{c}_c") for c in ("pos", "x", "y", "w", "h", "color")])
    dx, dy = F.col("x") - F.col("x_c"), F.col("y") - F.col("y_c")
    a, b = F.greatest(F.col("w") * F.col("h"), F.lit(1e-9)), F.greatest(F.col("w_c") * F.col("h_c"), F.lit(1e-9))
    met = left.join(other, key).withColumn("d", F.sqrt(dx * dx + dy * dy))
    met = met.where((F.col("d") <= C.MAX_PAIR_DISTANCE) & (F.greatest(a / b, b / a) <= C.MAX_SIZE_RATIO**2))
    return met.withColumn("cost", F.col("d") + F.when(F.col("color") != F.col("color_c"), C.COLOR_COST).otherwise(0.0))


def nearest_labels(buttons: DataFrame, regions: DataFrame) -> DataFrame:
    """rid, pos and region: each region's nearest button within reach; of a button's regions the nearest."""
    r = regions.select("rid", "region", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("w").alias("rw"))
    dx, dy = F.col("x") - F.col("rx"), F.col("y") - F.col("ry")
    met = buttons.join(r, "rid").withColumn("d", F.sqrt(dx * dx + dy * dy))
    first = F.row_number().over(Window.partitionBy("rid", "region").orderBy("d", "pos"))
    met = met.withColumn("n", first).where((F.col("n") == 1) & (F.col("d") <= C.LABEL_DISTANCE) & (F.col("rw") < C.LABEL_WIDTH))
    best = F.row_number().over(Window.partitionBy("rid", "pos").orderBy("d", "region"))
    return met.withColumn("b", best).where("b = 1").select("rid", "pos", "region", "d")


def covered_share(buttons: DataFrame, regions: DataFrame) -> DataFrame:
    """rid, pos, covered (share of the button under text, 1 at most), widest and largest touching region."""
    r = regions.select("rid", *[F.col(c).alias(f"r{c}") for c in ("x", "y", "w", "h")])
    b = [F.col(c) for c in ("x", "y", "w", "h")]
    met = buttons.join(r, "rid", "left").withColumn("part", F.coalesce(overlap(*b, *[F.col(f"r{c}") for c in ("x", "y", "w", "h")]), F.lit(0.0)))
    touching = F.col("part") > 0
    out = met.groupBy("rid", "pos", "w", "h").agg(
        F.sum("part").alias("part"), F.max(F.when(touching, F.col("rw"))).alias("widest"), F.max(F.when(touching, F.col("rw") * F.col("rh"))).alias("largest")
    )
    area = F.greatest(F.col("w") * F.col("h"), F.lit(1e-9))
    return out.select("rid", "pos", F.least(F.col("part") / area, F.lit(1.0)).alias("covered"), "widest", (area / F.col("largest")).alias("area_ratio"))


def suppression(shares: DataFrame, text_share: float = 0.6, keep_ratio: float = 2.0) -> DataFrame:
    """The verdict of each button: kept, caption (under a strip) or text (misread legend)."""
    verdict = F.when(F.col("covered") < text_share, "kept").when(F.col("widest") >= C.LABEL_WIDTH, "caption").when(F.col("area_ratio") >= keep_ratio, "kept").otherwise("text")
    return shares.select("rid", "pos", verdict.alias("verdict"))


def containers(buttons: DataFrame, margin: float = 0.85, least: int = 3) -> DataFrame:
    """rid, pos and n_inside of buttons that hold `least` others or more almost entirely."""
    o = buttons.select("rid", *[F.col(c).alias(f"o{c}") for c in ("pos", "x", "y", "w", "h")])
    part = overlap(*[F.col(c) for c in ("x", "y", "w", "h")], *[F.col(f"o{c}") for c in ("x", "y", "w", "h")])
    inside = part / F.greatest(F.col("ow") * F.col("oh"), F.lit(1e-9)) > margin
    met = buttons.join(o, "rid").where(F.col("pos") != F.col("opos")).where(inside)
    return met.groupBy("rid", "pos").agg(F.count("*").alias("n_inside")).where(F.col("n_inside") >= least)


def orphans(buttons: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions that are no strip and have no button in the square around them."""
    b = buttons.select(F.col("rid").alias("brid"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = (F.col("rid") == F.col("brid")) & (F.abs(F.col("x") - F.col("bx")) < C.LABEL_DISTANCE) & (F.abs(F.col("y") - F.col("by")) < C.LABEL_DISTANCE)
    return regions.where(F.col("w") < C.LABEL_WIDTH).join(b, near, "left_anti")


def isolated(regions: DataFrame, radius: float = C.ISOLATION) -> DataFrame:
    """Regions without another region of their record within the radius."""
    o = regions.select(F.col("rid").alias("orid"), F.col("region").alias("oregion"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    return regions.join(o, (F.col("rid") == F.col("orid")) & (F.col("region") != F.col("oregion")) & (F.sqrt(dx * dx + dy * dy) < radius), "left_anti")


def near_button(regions: DataFrame, buttons: DataFrame, radius: float = C.BUTTON_RADIUS) -> DataFrame:
    """Regions with a button of their record within the radius."""
    b = buttons.select(F.col("rid").alias("brid"), F.col("x").alias("bx"), F.col("y").alias("by"))
    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    return regions.join(b, (F.col("rid") == F.col("brid")) & (F.sqrt(dx * dx + dy * dy) < radius), "left_semi")


def crop_verdicts(crops: DataFrame) -> DataFrame:
    """crops (photo, crop, n, regions, density) with reason, the first rule that drops the crop, or null."""
    every = Window.partitionBy("photo")
    positive = F.when(F.col("density") > 0, F.col("density"))
    dense = (F.col("density") > C.DENSITY_MAX) | (
        (F.count("*").over(every) > 1) & (F.col("density") > C.DENSITY_SIBLING) & (F.col("density") > C.DENSITY_RATIO * F.min(positive).over(every))
    )
    out = crops.withColumn("dense", F.coalesce(dense, F.lit(False)))
    most = F.max(F.when(~F.col("dense"), F.col("n"))).over(every)
    sparse = (F.count("*").over(every) > 1) & (F.col("n") < C.SPARSE_FRACTION * most) & (F.col("n") < C.SPARSE_BUTTONS)
    out = out.withColumn("sparse", F.coalesce(sparse, F.lit(False)))
    reason = F.when((F.col("n") == 0) & (F.col("regions") == 0), "empty").when(F.col("sparse"), "sparse").when(F.col("dense"), "dense")
    return out.withColumn("reason", reason)


def query_body(crops: DataFrame) -> DataFrame:
    """The crop that a query uses: of those that are not dense (of all, if all are) the one with most buttons."""
    every = Window.partitionBy("photo")
    usable = F.col("dense") & (F.min(F.col("dense").cast("int")).over(every) == 0)
    place = F.row_number().over(every.orderBy(usable.cast("int"), F.desc("n"), "crop"))
    return crops.withColumn("place", place).where("place = 1").drop("place")
