import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.operators import layout as L
from tessella.operators import match as M
from tessella.plans import verification
from tessella.plans.retrieval import candidates
from tessella.plans.views import buttons


def ids(df, *columns):
    return {tuple(r) for r in df.select(*columns).distinct().collect()}


def test_the_candidates_of_every_query_are_verified(spark, sf_dir):
    chosen = ids(M.prefilter(candidates(spark, sf_dir)), "qid", "rid")
    pairs, asked, met = verification.chosen_buttons(spark, sf_dir)
    assert ids(pairs, "qid", "rid") == chosen and {q % 20 for q, _ in chosen} == {3, 13}
    found = entry.queries()
    assert ids(met, "qid", "cid") <= chosen and {q for q, in ids(asked, "qid")} >= {q for q, _ in chosen}
    near = ids(L.candidate_pairs(asked.join(met.select("qid", "cid").distinct(), "qid").withColumn("pair", F.struct("qid", "cid")).drop("qid", "cid"), met.withColumn("pair", F.struct("qid", "cid")), "pair"), "pair.qid", "pair.cid")
    assert ids(found["v1_greedy_pairs"](spark, sf_dir), "qid", "cid") == near and {q % 20 for q, _ in near} == {3, 13}
    assert ids(found["v2_ransac"](spark, sf_dir), "qid", "cid") == near
    assert {q for q, in ids(found["v3_match"](spark, sf_dir), "qid")} == {q for q, _ in chosen}


@pytest.mark.parametrize("name", ["v5_iou_vote", "v6_nms"])
def test_every_record_is_merged_and_suppressed(spark, sf_dir, name):
    got, want = (ids(df, "rid") for df in (entry.queries()[name](spark, sf_dir), buttons(spark, sf_dir)))
    assert got == want
