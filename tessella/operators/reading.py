"""Rules over what was read from a crop: brands, printed codes, stamps, agreement of engines, orientation, colours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import config as C
from tessella.functions.text import acceptable_code, model_codes, norm_label, record_stem
from tessella.operators import layout as L
from tessella.operators import verify as V


def find_brand(regions: DataFrame, brands: DataFrame) -> DataFrame:
    """rid, brand, conf and ratio of the best listed brand among the words of a record's regions.

    regions: rid, region, y, text, conf; brands: brand. A word is a brand if its letters and digits are the
    brand's, or, from BRAND_FUZZY_LENGTH of them on, if the ratio of both is BRAND_RATIO or more."""
    words = regions.select("rid", "region", "y", "conf", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("place", "word"))
    words = words.withColumn("a", norm_label(F.col("word"))).where(F.length("a") >= C.BRAND_LENGTH)
    known = brands.select(norm_label(F.col("brand")).alias("b"), "brand").where("b IS NOT NULL").groupBy("b").agg(F.max("brand").alias("brand"))
    exact = words.join(known, F.col("a") == F.col("b")).withColumn("ratio", F.lit(100.0))
    long = words.where(F.length("a") >= C.BRAND_FUZZY_LENGTH).join(known.select(F.col("b").alias("a")), "a", "left_anti")
    near = V.best_ratios(long.select("a"), known.select("b"), C.BRAND_RATIO).join(known, "b")
    found = exact.unionByName(long.join(near, "a").select(*exact.columns))
    at_end = F.when((F.col("y") < C.BRAND_TOP) | (F.col("y") > C.BRAND_BOTTOM), 1 + C.BRAND_END).otherwise(1.0)
    order = F.struct(F.col("ratio") * at_end * (0.5 + 0.5 * F.col("conf")), -F.col("region"), -F.col("place"))
    best = found.groupBy("rid").agg(F.max_by(F.struct("brand", F.round("conf", 3).alias("conf"), F.round("ratio", 1).alias("ratio")), order).alias("best"))
    return best.select("rid", "best.*")


def find_model_code(regions: DataFrame, buttons: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """rid and code: the best scored token that has the shape of a printed code.

    regions: rid, region, x, y, text, conf, agree (engines that read the same); buttons: rid, x, y; brands: rid,
    brand (a brand is no code)."""
    alone = L.isolated(regions, C.ISOLATION).select("rid", "region", F.lit(1).alias("alone"))
    legend = L.near_button(regions, buttons, C.BUTTON_RADIUS).select("rid", "region", F.lit(1).alias("legend"))
    read = regions.join(alone, ["rid", "region"], "left").join(legend, ["rid", "region"], "left")
    read = read.select("rid", "region", "y", "conf", "agree", "alone", "legend", F.posexplode(model_codes(F.col("text"))).alias("place", "token"))
    read = read.where(acceptable_code(F.col("token")))
    if brands is not None:
        named = brands.select("rid", norm_label(F.col("brand")).alias("named"))
        read = read.join(named, "rid", "left").where(F.col("named").isNull() | (F.regexp_replace("token", "[- ]", "") != F.col("named")))
    bonus = lambda holds, value: F.when(holds, value).otherwise(0.0)
    score = 1.0 + F.col("conf") + bonus(F.col("y") > C.MODEL_BOTTOM, 0.5) + bonus(F.col("alone").isNotNull(), 0.5) + bonus(F.col("token").contains("-"), C.SEPARATOR)
    score = score - bonus(F.col("legend").isNotNull(), C.BUTTON_PENALTY) + bonus(F.col("agree") > 1, 0.25)
    return read.groupBy("rid").agg(F.max_by(F.translate("token", " ", "-"), F.struct(F.round(score, 9), -F.col("region"), -F.col("place"))).alias("code"))


def drop_stamps(regions: DataFrame, terms: list[str], phrases: list[str]) -> DataFrame:
    """The regions (rid, region, h, text) that are no stamp of the image's source: neither a strapline that
    partly matches a phrase, nor large text that partly matches a term."""
    order = Window.partitionBy("rid").orderBy("h")
    n = F.count("*").over(Window.partitionBy("rid"))
    heights = regions.select("rid", "h", (F.row_number().over(order) - 1).alias("k"), n.alias("n")).where("k = n div 2")
    typical = heights.groupBy("rid").agg(F.max("h").alias("middle"))
    bare = F.regexp_replace(F.upper("text"), "[^A-Z0-9]", "")
    wide = F.regexp_replace(F.upper("text"), "[^0-9A-ZА-ЯЁ]", "")
    best = lambda x, some: F.greatest(F.lit(0.0), F.lit(0.0), *[V.phrase_ratio(x, s) for s in some])
    strapline = (F.length("wide") >= C.STAMP_PHRASE_LENGTH) & (F.col("phrase") >= C.STAMP_PHRASE_RATIO)
    large = F.col("h") / F.when(F.col("middle") > 0, F.col("middle")).otherwise(1e-6) >= C.STAMP_HEIGHT
    stamp = (F.length("bare") >= C.STAMP_LENGTH) & large & (F.col("term") >= C.STAMP_RATIO)
    read = regions.join(typical, "rid").withColumns({"bare": bare, "wide": wide})
    read = read.withColumns({"phrase": best(F.col("wide"), phrases), "term": best(F.col("bare"), terms)})
    return read.where(~F.coalesce(strapline | stamp, F.lit(False))).select(*regions.columns)


def agreed_regions(regions: DataFrame, key: str = "rid", limit: float = 0.30, engines: int = 2, alone: float = 0.90) -> DataFrame:
    """Regions of several engines (key, engine, pos, x, y, w, h, text, conf), merged in order: a region joins the
    first group whose first box it overlaps beyond the limit. Of a group the most confident reading stays if
    `engines` engines read the same text, or if it is as confident as `alone`."""
    rows = regions.select(key, "engine", "pos", "x", "y", "w", "h", "text", "conf")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["engine", "pos"])
        boxes, first, members = group[["x", "y", "w", "h"]].to_numpy(), [], []
        for k, box in enumerate(boxes):
            over = np.flatnonzero(V.iou(box, boxes[first]) > limit)
            if len(over):
                members[over[0]].append(k)
            else:
                first.append(k)
                members.append([k])
        out = []
        for places in members:
            own = group.iloc[places]
            best = own.iloc[int(own["conf"].to_numpy().argmax())]
            agree = own.loc[own["text"] == best["text"], "engine"].nunique()
            if agree >= engines or best["conf"] >= alone:
                out.append((best[key], *best[["x", "y", "w", "h", "text", "conf"]], agree, sorted(own["engine"].unique().tolist())))
        return pd.DataFrame(out, columns=[key, "x", "y", "w", "h", "text", "conf", "agree", "engines"])

    kind, engine = (rows.schema[c].dataType.simpleString() for c in (key, "engine"))
    return rows.groupBy(key).applyInPandas(run, f"`{key}` {kind}, x double, y double, w double, h double, text string, conf double, agree int, engines array<{engine}>")


def orientation_from_text(up: Column, down: Column, flip: Column, ambiguous: Column, confidence: Column) -> Column:
    """flip, ambiguous, confidence and source: what the text of both ways up says, or else the geometry."""
    total = up + down
    margin = F.abs(up - down) / total
    text = (total >= C.TEXT_TOTAL) & (margin >= C.TEXT_MARGIN)
    return F.struct(
        F.when(text, down > up).otherwise(flip).alias("flip"),
        F.when(text, F.lit(False)).otherwise(ambiguous).alias("ambiguous"),
        F.when(text, F.round(F.least(0.5 + margin, F.lit(1.0)), 3)).otherwise(confidence).alias("confidence"),
        F.when(text, "text").otherwise("geometry").alias("source"),
    )


def colour_name(hue: Column, saturation: Column, value: Column) -> Column:
    """The coarse colour of a button: black and unsaturated ones first, then the hue's range."""
    pale = F.when(value > C.WHITE_VALUE, "white").otherwise("grey")
    out = F.when(value < C.BLACK_VALUE, "black").when(saturation < C.GREY_SATURATION, pale)
    for name, low, high in C.HUES:
        out = out.when(hue.between(low, high), name)
    return out.otherwise("grey")


def affected_stems(records: DataFrame, floor: float) -> DataFrame:
    """stem and n: photos none of whose crops is the full frame and whose crops' areas add up to less than the
    floor. records: record_id, area_frac, full_frame.

    The areas are added in the order of the crops (numbers in record_id by value), so that a sum near the floor does
    not hang on the order in which tasks finish."""
    crop = F.struct(F.length("record_id").alias("length"), "record_id", F.coalesce("area_frac", F.lit(0.0)).alias("area"))
    photos = records.groupBy(record_stem(F.col("record_id")).alias("stem")).agg(
        F.count("*").alias("n"), F.bool_or(F.coalesce("full_frame", F.lit(False))).alias("whole"), F.sort_array(F.collect_list(crop)).alias("crops")
    )
    total = F.aggregate("crops", F.lit(0.0), lambda sofar, c: sofar + c["area"])
    return photos.where((~F.col("whole")) & (total < floor)).select("stem", "n")
