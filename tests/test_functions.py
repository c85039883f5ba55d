import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions import scoring as S
from tessella.functions import text as T


def one(spark, column, **values):
    names = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "title, code",
    [
        ("6710V00046D , 6710V00046C , 6710V00046K пульт для телевизора LG", "6710V00046D"),
        ("BN59-01315B оригинальный пульт для Samsung UE65RU7172", "BN59-01315B"),
        ("Пульт для телевизора Samsung UE65RU7172", None),
        ("HDMI1 AA_59 пульт", "AA-59"),
        ("no such word BN59-01315B", None),
        (None, None),
    ],
)
def test_code_from_title(spark, title, code):
    assert one(spark, T.code_from_title(F.col("t")), t=title) == code


@pytest.mark.parametrize("text, codes", [("RM-D1110", ["RM-D1110"]), ("RM 530F", ["RM 530F"]), ("BN59-01315B x", ["BN59-01315B"]), ("VOL 12 34", ["VOL 12"]), ("none", [])])
def test_model_codes(spark, text, codes):
    assert one(spark, T.model_codes(F.col("t")), t=text) == codes


@pytest.mark.parametrize("text, fine", [("HDMI2", False), ("VGA1", False), ("RM-D1110", True), ("12345", False)])
def test_acceptable_code(spark, text, fine):
    assert one(spark, T.acceptable_code(F.col("t")), t=text) is fine


@pytest.mark.parametrize("rid, stem, crop", [("X_0", "X", 0), ("X_0_12", "X_0", 12), ("photo", "photo", 0), ("a_b", "a_b", 0)])
def test_record_id(spark, rid, stem, crop):
    assert (one(spark, T.record_stem(F.col("r")), r=rid), one(spark, T.crop_index(F.col("r")), r=rid)) == (stem, crop)


@pytest.mark.parametrize("v, cells", [(0.0, [0]), (1.0, [11]), (0.5, [6, 5]), (0.57, [6, 7]), (0.54, [6]), (-1.0, [0])])
def test_cells(spark, v, cells):
    assert one(spark, G.cells(F.col("v"), 12), v=v) == cells


@pytest.mark.parametrize(
    "top, margin, n, band",
    [(0.9, 0.2, 3, "high"), (0.9, 0.005, 2, "low"), (0.9, 0.9, 1, "high"), (0.6, 0.2, 2, "medium"), (0.47, 0.2, 2, "low"), (0.3, 0.0, 2, "none"), (0.66, 0.05, 2, "medium")],
)
def test_band(spark, top, margin, n, band):
    assert one(spark, S.band(F.col("t"), F.col("m"), F.col("n")), t=top, m=margin, n=n) == band


def test_fusion_of_a_perfect_match(spark):
    assert one(spark, S.fused(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0.4)), x=1) == pytest.approx(1.4)


@pytest.mark.parametrize("a, b, bonus", [("RM530", "RM530", 0.4), ("RM530", "RM53", 0.2), ("RM530", "XX", 0.0), (None, "RM530", 0.0)])
def test_code_bonus(spark, a, b, bonus):
    assert one(spark, S.code_bonus(F.col("a"), F.col("b")), a=a, b=b) == bonus


def test_boxes_round_trip(spark):
    box = G.percent_box(*[F.col(c) for c in "xywh"])
    back = G.centre_box(*[box[c] for c in ("left", "top", "width", "height")])
    got = one(spark, back, x=0.4, y=0.5, w=0.2, h=0.1)
    assert [got.x, got.y, got.w, got.h] == pytest.approx([0.4, 0.5, 0.2, 0.1], abs=1e-6)
    assert one(spark, G.centre_box(F.lit(150.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)), x=1) is None


@pytest.mark.parametrize("m, fine", [((1.0, 0.0, 0.0, 1.0), True), ((3.0, 0.0, 0.0, 3.0), False), ((1.0, 1.0, 0.0, 1.0), False), ((0.0, 0.0, 0.0, 0.0), False)])
def test_plausible_transform(spark, m, fine):
    assert one(spark, G.plausible_transform(*[F.lit(v) for v in m]), x=1) is fine


def test_index_quantile_is_no_interpolation(spark):
    assert one(spark, S.index_quantile(F.array(*[F.lit(float(k)) for k in (4, 1, 3, 2)]), 0.5), x=1) == 3.0
