"""Rules over read text, against plain versions."""

import random
import re

from pyspark.sql import functions as F

from tessella.operators import reading as R
from tessella.operators import verify as V


def bare(x):
    return re.sub("[^A-Z0-9]", "", (x or "").upper())


def test_find_brand(spark):
    rng = random.Random(1)
    brands = ["Samsung", "LG", "Pace", "Grundig", "Vestel TV"]
    words = ["samsung", "SAMSVNG", "space", "grundlg", "vestel", "lg", "pace", "menu", "Gr", "sony"]
    rows = [(r, k, rng.choice([0.1, 0.5, 0.9]), " ".join(rng.choice(words) for _ in range(rng.randrange(4))), rng.choice([0.2, 0.5, 0.95])) for r in range(60) for k in range(4)]
    rows.append((99, 0, 0.5, None, 0.5))
    known = {bare(b): b for b in brands}
    want = {}
    for r, k, y, text, conf in rows:
        for place, word in enumerate((text or "").split()):
            a = bare(word)
            if len(a) < 3:
                continue
            if a in known:
                name, ratio = known[a], 100.0
            elif len(a) >= 6:
                ratio, name = max((V.indel_ratio(a, b), n) for b, n in known.items())
                if ratio < 85:
                    continue
            else:
                continue
            rank = (ratio * (1.15 if y < 0.18 or y > 0.86 else 1.0) * (0.5 + 0.5 * conf), -k, -place)
            want[r] = max(want.get(r, ((-1.0,), None)), (rank, (name, round(conf, 3), round(ratio, 1))), key=lambda x: x[0])
    got = R.find_brand(spark.createDataFrame(rows, "rid int, region int, y double, text string, conf double"), spark.createDataFrame([(b,) for b in brands], "brand string")).collect()
    assert {r.rid: (r.brand, r.conf, r.ratio) for r in got} == {r: w for r, (_, w) in want.items()}
    assert len(want) > 20 and any(w[2] < 100 for _, w in want.values())


def test_drop_stamps(spark):
    rows = [
        (1, 0, 0.01, "EXIT"), (1, 1, 0.012, "menu"), (1, 2, 0.05, "SHOP.STAMP"), (1, 3, 0.011, "SHOPSTAMP"), (1, 4, 0.05, "x"), (1, 5, 0.05, "volume"),
        (1, 6, 0.01, "знатоки всех устройств для дома"), (1, 7, 0.01, None), (2, 0, 0.0, "SHOPSTAMP"), (2, 1, 0.0, "OK"),
    ]
    regions = spark.createDataFrame([(*r, "x") for r in rows], "rid int, region int, h double, text string, term string")
    got = R.drop_stamps(regions, ["SHOPSTAMP"], ["ЗНАТОКИВСЕХУСТРОЙСТВДЛЯДОМАИДАЧИ"])
    assert got.columns == regions.columns
    kept = {(r.rid, r.region) for r in got.collect()}
    # the small SHOPSTAMP stays (height), the large legend stays (similarity), the strapline goes whatever its height
    assert kept == {(1, 0), (1, 1), (1, 3), (1, 4), (1, 5), (1, 7), (2, 0), (2, 1)}


def test_agreed_regions(spark):
    box = (0.5, 0.5, 0.2, 0.1)
    near, far = (0.51, 0.5, 0.2, 0.1), (0.1, 0.1, 0.2, 0.1)
    rows = [
        (1, 0, 0, *box, "VOL", 0.5), (1, 1, 0, *near, "VOL", 0.6),  # two engines agree
        (2, 0, 0, *box, "CH", 0.5), (2, 1, 0, *near, "GH", 0.6),  # they do not
        (3, 0, 0, *box, "TV", 0.95), (3, 0, 1, *far, "AV", 0.4),  # one is sure
        (4, 0, 0, *box, "OK", 0.3), (4, 0, 1, *near, "OK", 0.4),  # one engine twice is no agreement
    ]
    got = R.agreed_regions(spark.createDataFrame(rows, "rid int, engine int, pos int, x double, y double, w double, h double, text string, conf double")).collect()
    assert sorted((r.rid, r.text, r.conf, r.agree, tuple(r.engines)) for r in got) == [(1, "VOL", 0.6, 2, (0, 1)), (3, "TV", 0.95, 1, (0,))]


def test_a_brand_is_no_code_and_agreement_counts(spark):
    regions = spark.createDataFrame([(1, 0, 0.1, 0.1, "RM-530F", 0.5, 1), (1, 1, 0.5, 0.9, "AB1234", 0.5, 2), (2, 0, 0.5, 0.5, "AB1234", 0.9, 1)], "rid int, region int, x double, y double, text string, conf double, agree int")
    buttons = spark.createDataFrame([(1, 0.1, 0.1)], "rid int, x double, y double")
    brands = spark.createDataFrame([(1, "ab-1234"), (3, "x")], "rid int, brand string")
    assert {r.rid: r.code for r in R.find_model_code(regions, buttons).collect()} == {1: "AB1234", 2: "AB1234"}
    assert {r.rid: r.code for r in R.find_model_code(regions, buttons, brands).collect()} == {1: "RM-530F", 2: "AB1234"}


def test_photos_below_the_floor(spark):
    rows = [("a_0", 0.1, False), ("a_1", 0.1, None), ("b_0", 0.05, True), ("b_1", 0.05, False), ("c_0", 0.9, False), ("d", None, None)]
    got = R.affected_stems(spark.createDataFrame(rows, "record_id string, area_frac double, full_frame boolean"), 0.3).collect()
    assert {(r.stem, r.n) for r in got} == {("a", 2), ("d", 1)}


def test_areas_are_added_in_the_order_of_the_crops(spark):
    """0.6 + 0.3 + 0.1 is 0.9999999999999999 in this order and 1.0 in the other."""
    rows = [("a_2", 0.6, False), ("a_9", 0.3, False), ("a_10", 0.1, False), ("b_2", 0.1, False), ("b_9", 0.3, False), ("b_10", 0.6, False)]
    for order in (rows, rows[::-1], rows[1:] + rows[:1], rows[4:] + rows[:4]):
        df = spark.createDataFrame(order, "record_id string, area_frac double, full_frame boolean")
        for parts in (1, 3):
            assert [r.stem for r in R.affected_stems(df.repartition(parts), 1.0).collect()] == ["a"]


def test_orientation_and_colour(spark):
    rows = [(0.2, 0.1, True, True, 0.1), (3.0, 1.0, True, True, 0.1), (1.0, 3.0, False, True, 0.1), (2.0, 2.1, True, False, 0.7), (0.0, 0.0, False, True, 0.0)]
    df = spark.createDataFrame(rows, "up double, down double, flip boolean, ambiguous boolean, confidence double")
    got = [tuple(r.s) for r in df.select(R.orientation_from_text(*[F.col(c) for c in df.columns]).alias("s")).collect()]
    assert got == [(True, True, 0.1, "geometry"), (False, False, 1.0, "text"), (True, False, 1.0, "text"), (True, False, 0.7, "geometry"), (False, True, 0.0, "geometry")]
    points = [(5, 200, 200), (175, 200, 200), (8.5, 200, 200), (60, 200, 200), (60, 10, 200), (60, 10, 100), (60, 200, 10), (165, 200, 200)]
    seen = spark.createDataFrame([tuple(map(float, p)) for p in points], "h double, s double, v double")
    assert [r.n for r in seen.select(R.colour_name(F.col("h"), F.col("s"), F.col("v")).alias("n")).collect()] == ["red", "red", "grey", "green", "white", "grey", "black", "grey"]
