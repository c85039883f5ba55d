import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import ranks as K


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_values_at_ranks(spark, monkeypatch, kind):
    monkeypatch.setattr(K, "FEW", 7)
    monkeypatch.setattr(K, "SPLITS", 6)
    rng = random.Random(4)
    make = {"spread": lambda: rng.gauss(0, 5), "ties": lambda: rng.choice([0.0, 0.0, 0.0, rng.random()]), "few": lambda: float(rng.randrange(3))}[kind]
    values = [make() for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    order = sorted(values)
    wanted = [0, 1, 57, 199, 200, 398, 399]
    assert K.values_at(df, "x", wanted) == {k: order[k] for k in wanted}
    at = 0.95 * 399
    assert K.percentile(df, "x", 0.95) == pytest.approx(order[int(at)] + (order[int(at) + 1] - order[int(at)]) * (at - int(at)))
    assert K.values_at(df.where(F.col("x").isNull()), "x", []) == {} and K.percentile(df.limit(0), "x", 0.5) is None
