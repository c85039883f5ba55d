import numpy as np
from pyspark.sql import functions as F

from tessella.llm import vector_search as V


def brute(rows, step, k=5):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    out = {}
    for q in ok:
        if q % step == 0:
            s = sorted((-float(unit[q] @ unit[i]), i) for i in ok if i != q)
            out[q] = [i for _, i in s[:k]]
    return out, unit


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r)
    return out


def test_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = found(V.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0))
    want, unit = brute(rows, 50)
    assert set(got) == set(want) and all([r["rank"] for r in v] == [1, 2, 3, 4, 5] for v in got.values())
    assert np.mean([len({r.vec_id for r in got[q]} & set(want[q])) / 5 for q in want]) >= 0.95
    assert all(abs(r.score - unit[q] @ unit[r.vec_id]) < 1e-12 for q in got for r in got[q])


def test_many_blocks_find_what_one_block_finds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(V, "INDEX_GROUP", (16, 32))
    monkeypatch.setattr(V, "QUERY_BLOCK", (4, 8))
    monkeypatch.setattr(V, "SCAN_QUERIES", 4)
    monkeypatch.setattr(V, "MERGE", 3)
    got = found(V.nearest(vectors, F.col("vec_id") % 10 == 0, rerank=60))
    want, _ = brute(rows, 10)
    assert {q: [r.vec_id for r in v] for q, v in got.items()} == want


def test_unfit_vectors_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0]), (50, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (100, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [1e300, 1e300]), (10, [-1.0, 0.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, v string")
    got = found(V.nearest(vectors, F.col("vec_id") % 50 == 0))
    assert [r.vec_id for r in got[0]] == [1, 2, 9, 50, 10] and set(got) == {0, 50}
    mixed = vectors.selectExpr("vec_id", "embedding").union(spark.createDataFrame([(150, [1.0, 2.0, 2.5]), (11, [1e-300, 2e-300, 3e-300])], "vec_id long, embedding array<double>"))
    longer = found(V.nearest(mixed, F.col("vec_id") % 50 == 0))
    assert set(longer) == {0, 50, 150} and {(r.vec_id, round(r.score, 9)) for r in longer[150]} == {(8, round(12.5 / (14 * 11.25) ** 0.5, 9)), (11, round(12.5 / (14 * 11.25) ** 0.5, 9))}
    assert [r.vec_id for r in longer[0]] == [r.vec_id for r in got[0]]
    assert [round(r.score, 9) for r in got[0]] == [1.0, 1.0, 0.707106781, 0.0, -1.0]
    assert V.nearest(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert V.nearest(vectors.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_recall_on_fifty_thousand_vectors_with_a_shortlist_of_under_a_hundredth(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50_000, 32)).astype(np.float32)
    x[::10] = x[rng.integers(0, 50_000, 5_000)] + 0.3 * rng.normal(size=(5_000, 32))  # some clusters
    vectors = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    assert V.RERANK < 0.01 * len(x)
    got = found(V.nearest(vectors, F.col("vec_id") % 250 == 0))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(x), 250):
        s = unit @ unit[q]
        s[q] = -2
        hits += len({r.vec_id for r in got[q]} & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 200 and hits / 1000 >= 0.9


def test_hundreds_of_equal_vectors_give_the_smallest_ids(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=16).tolist()
    rows = [(k, centre) for k in range(300)] + [(k, rng.normal(size=16).tolist()) for k in range(300, 500)]
    monkeypatch.setattr(V, "INDEX_GROUP", (32, 64))
    got = found(V.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7), F.col("vec_id") % 50 == 0, rerank=10))
    for q in range(0, 300, 50):
        assert [r.vec_id for r in got[q]] == [k for k in range(6) if k != q][:5] and all(abs(r.score - 1) < 1e-12 for r in got[q])
    assert len(got) == 10 and all(len(v) == 5 for v in got.values())


def test_ties_go_on_and_equal_vectors_do_so_a_few_times():
    ids, scores = np.arange(8), np.array([1, 3, 2, 2, 2, -np.inf, 2, 0], np.float32)
    at, tied = V.best_of(ids, scores, 3)
    assert sorted(at.tolist()) == [1, 2, 3] and tied.tolist() == [4, 6]
    at, tied = V.best_of(ids, scores, 7)
    assert len(at) == 7 and not len(tied)
    assert V.few_of_each(np.array([5, 5, 4, 5, 4]), 2).tolist() == [0, 1, 2, 4]
