import random

import pyarrow as pa
from pyspark.sql import functions as F

from tessella.operators import index as I
from tessella.operators import match as M
from tessella.plans import retrieval as R
from tessella.plans import views as V


def test_narrow_rows_hold_the_places_and_sizes_of_buttons(spark, tmp_path):
    """Also of lines without a number, a quantity or a flag, and of keys below zero."""
    rng = random.Random(3)
    some = lambda v: rng.choice([v, v, v, None])
    lines = [(rng.choice([k % 40, -7]), some(rng.randrange(1, 9)), rng.randrange(-3, 25), some(rng.randrange(-50, 90)), some(float(rng.randrange(0, 60))), 1.5 * k, some("N"), rng.choice("OF")) for k in range(400)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, k % 6) for k in range(-8, 38)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, rng.choice(["Part a", None]), "b") for k in range(-3, 23)], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    size = F.when(F.coalesce("w", F.lit(0.0)) < 0.12, 0).when(F.coalesce("w", F.lit(0.0)) < 0.25, 1).otherwise(2)
    want = V.buttons(spark, str(tmp_path)).select("rid", "x", "y", size.alias("size"), "color", "label")
    found = V.sized_buttons(spark, str(tmp_path))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and want.where("x IS NULL").count() and want.where("x < 0").count()
    keys = found._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in keys.split("Project")[-1] and "packed" in keys


def test_records_with_one_part_a_line_equal_those_of_joined_lines(spark, sf_dir):
    assert V.one_part_each(spark, sf_dir)
    assert sorted(map(str, V.records(spark, sf_dir, True).collect())) == sorted(map(str, V.records(spark, sf_dir).collect()))


def test_code_hits_are_not_shuffled(spark):
    """And the result equals that of the plain steps, also for null codes and records that are not in the catalogue."""
    rng = random.Random(2)
    rows = spark.createDataFrame([(k, rng.choice(["A", "B", None]), rng.choice(["c1", "c2", "c9", None]), 1 + k % 7 / 3) for k in range(120)], "rid long, brand string, code string, aspect double")
    queries = rows.where("rid % 3 = 0").withColumnRenamed("rid", "qid")
    hits = spark.createDataFrame([(q, r, rng.randrange(999) / 1000) for q in range(0, 130, 3) for r in rng.sample(range(150), 40)], "qid long, rid long, score double")
    plain = M.fuse(M.prefilter(M.with_code_hits(hits, M.code_hits(queries, rows))), queries, rows, F.lit(0.0))
    found = M.fuse_by_code(hits, queries, rows, F.lit(0.0))
    assert sorted(map(str, found.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert sorted(map(str, M.answers(found).collect())) == sorted(map(str, M.answers(plain).collect()))
    plan = M.answers(found)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Exchange" not in plan.split("Union")[0]


def test_blocks_are_full_also_where_few_records_are_turned():
    """Of 16 documents at most, from buttons in batches that cut records; no record is in two blocks."""
    docs = [d for k in range(40) for d in ([2 * k, 2 * k + 1] * 3 if k % 7 == 0 else [2 * k] * 3)]
    rows = pa.RecordBatch.from_pydict({"doc": docs, "c": ["red"] * len(docs), "s": pa.array([0] * len(docs), pa.int32()), "l": ["a"] * len(docs), **{f"{v}{i}": pa.array([1 - 3 * i] * len(docs), pa.int32()) for v in "xy" for i in (0, 1)}})
    for size in (1, 4, 5, 1000):
        blocks = list(I._make_blocks(16)(rows.slice(k, size) for k in range(0, len(docs), size)))
        held = [b.column("docs")[0].as_py() for b in blocks]
        assert sorted(sum(held, [])) == sorted(set(docs)) and sum(map(len, held)) == len(set(docs))
        assert all(15 <= len(h) <= 16 for h in held[:-1]), [len(h) for h in held]


def test_retrieval_is_done_once_for_several_queries(spark, sf_dir, monkeypatch):
    """Also where a query reads its result twice."""
    done = []
    real = I.TokenIndex.retrieve
    monkeypatch.setattr(I.TokenIndex, "retrieve", lambda *a: done.append(1) or real(*a))
    monkeypatch.setattr(R, "_hits", {})
    first = R.d5_retrieve_topk(spark, sf_dir)
    for query in (R.c4_candidate_lookup, R.c19_leave_group_out, R.d42_best_orientation, R.e1_best_per_key, R.b20_candidate_json):
        plan = query(spark, sf_dir)._jdf.queryExecution().toString()
        assert "MapInArrow" not in plan
    assert len(done) == 1 and first.count()


def test_masses_come_from_small_tasks_and_without_scores(spark, sf_dir, monkeypatch):
    """Where all pairs are asked, a task ends after some of them, also with more blocks of documents than of queries; masses
    equal those of scores(), and d3_mass rounds them as its SQL does."""
    rng = random.Random(5)
    rows = [(r, rng.random(), rng.random(), rng.choice([0.05, 0.2, 0.3]), rng.choice(["red", "blue", None]), rng.choice(["a", "b c", None])) for r in range(120) for _ in range(12)]
    b = spark.createDataFrame(rows, "rid long, x double, y double, w double, color string, label string")
    monkeypatch.setattr(I, "DOC_BLOCK", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several partitions of blocks of documents
    try:
        index = I.TokenIndex(b, F.col("rid") % 7 == 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    asked = I.grid_tokens(b.where("rid % 3 = 0").withColumnRenamed("rid", "qid"), "qid")
    want = {(r.qid, r.doc): r.mass for r in index.scores(asked).collect()}
    for queries, most in ((512, 2**24), (4, 60)):
        monkeypatch.setattr(I, "ALL_QUERIES", queries)
        monkeypatch.setattr(I, "ALL_ROWS", most)
        found = index.masses(asked)
        assert found.columns == ["qid", "doc", "mass"]
        sizes = found.groupBy(F.spark_partition_id()).count().toDF("task", "n").collect()
        assert {(r.qid, r.doc): r.mass for r in found.collect()} == want and len(want) == sum(r.n for r in sizes)
        if most == 60:
            assert len(sizes) >= 40 and max(r.n for r in sizes) < len(want) / 12, sizes
    mass = R.d3_mass(spark, sf_dir)
    plan = mass._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan and "score" not in plan and mass.count()
