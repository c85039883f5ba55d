import math
import time
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import source_mixing as M
from tessella.llm.source_mixing import block_slots, exact_weights, in_mix_order, mix_sources


def fluid_times(blocks, weights):
    """For each source the times at which it has got 0, 1, 2, .. blocks of the fluid mix, event by event."""
    got, now = dict.fromkeys(blocks, Fraction(0)), Fraction(0)
    times = {k: [Fraction(0)] for k in blocks}
    while open_ := [k for k in blocks if got[k] < blocks[k]]:
        total = sum(Fraction(weights[k]) for k in open_)
        step = min((math.floor(got[k]) + 1 - got[k]) * total / Fraction(weights[k]) for k in open_)
        now += step
        for k in open_:
            got[k] += step * Fraction(weights[k]) / total
            if got[k].denominator == 1:
                times[k].append(now)
    return times


def plain_schedule(blocks, weights):
    times = fluid_times(blocks, weights)
    jobs = [(math.floor(a), math.ceil(z), n, k, j) for n, k in enumerate(blocks) for j, (a, z) in enumerate(zip(times[k], times[k][1:]))]
    out = {}
    for slot in range(len(jobs)):
        best = min((j for j in jobs if j[0] <= slot), key=lambda j: (j[1], j[2], j[4]))
        assert slot < best[1]
        out[best[3], best[4]] = slot
        jobs.remove(best)
    return out


@given(st.dictionaries(st.sampled_from("abcde"), st.tuples(st.fractions(Fraction(1, 9), 9, max_denominator=9), st.integers(1, 25)), min_size=1))
@settings(max_examples=60, deadline=None)
def test_slots_are_those_of_a_plain_schedule(sources):
    blocks, weights = {k: n for k, (_, n) in sources.items()}, {k: w for k, (w, _) in sources.items()}
    got = block_slots(blocks, exact_weights(weights))
    assert {(k, j): slot for k, at in got.items() for j, slot in enumerate(at)} == plain_schedule(blocks, weights)


def within_one_block(blocks, weights, slots):
    """At every prefix each source is within one block of the fluid mix, also after others have run out."""
    assert sorted(x for at in slots.values() for x in at) == list(range(sum(blocks.values())))
    mix = M.FluidMix(list(blocks.values()), [exact_weights(weights)[k] for k in blocks])
    for i, k in enumerate(blocks):
        for j, slot in enumerate(slots[k]):
            (a, b), (c, d) = mix.time(i, j), mix.time(i, j + 1)
            assert slot + 1 > Fraction(a, b) and slot < Fraction(c, d)


@pytest.mark.parametrize("weights", [{"a": Fraction(1, 3), "b": Fraction(2, 3)}, {"a": 1 / 3, "b": 2 / 3}, {"a": 1, "b": 9999}, {k: math.sqrt(n) for k, n in (("a", 2), ("b", 3001), ("c", 70_001))}])
def test_exact_targets_hold_over_many_thousands_of_slots(weights):
    total = sum(weights.values())
    blocks = {k: int(40_000 * w / total) + 1 + 500 * (k == "a") for k, w in weights.items()}
    within_one_block(blocks, weights, block_slots(blocks, exact_weights(weights)))


@pytest.mark.parametrize("sources", [1001, 2500])
def test_thousands_of_sources(sources):
    blocks = {f"s{k}": 1 + k % 4 for k in range(sources)}
    weights = {k: math.sqrt(n) for k, n in blocks.items()}
    began = time.time()
    slots = block_slots(blocks, exact_weights(weights))
    assert time.time() - began < 20
    within_one_block(blocks, weights, slots)


def rows(n):
    return [(k, f"text {k}", "hot" if k % 3 else f"s{k % 4}", k) for k in range(n)]


def test_all_rows_keep_their_columns_and_the_shares_hold(spark):
    docs = spark.createDataFrame(rows(600) + [(1, None, None, 5)], "doc_id long, text string, source string, slot int")
    weights = {"hot": 0.5, "s0": 0.2, "s1": 0.1, "s2": 0.1, "s3": 0.1}
    mixed = mix_sources(docs, weights)
    got = sorted(mixed.collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(601)) and got[-1].source is None
    assert len({r.doc_id for r in got}) == 600
    short = min(n / weights[k] for k, n in Counter(r.source for r in got if r.source).items())
    seen = Counter()
    for r in got[: int(short) - 5]:
        seen[r.source] += 1
        assert all(abs(seen[k] - (r.slot + 1) * w) < 1 for k, w in weights.items())
    ordered = in_mix_order(mixed, ["doc_id", "slot"]).collect()
    assert [r.slot for r in ordered] == list(range(601))


def test_blocks_of_rows_nulls_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "x")] * 20 + [(2, None, None)] * 11 + [(None, "b", "y")] * 3, "doc_id long, text string, source string")
    got = mix_sources(docs, block_rows=4).collect()
    assert len(got) == 34 and len({(r.slot, r.row_in_block) for r in got}) == 34
    assert sorted({r.slot for r in got}) == list(range(5 + 3 + 1))
    assert mix_sources(docs.limit(0)).count() == 0


def test_root_weights_hold_for_every_row(spark):
    docs = spark.range(12_000).selectExpr("id AS doc_id", "cast(id AS string) AS text", "CASE WHEN id < 9000 THEN 'a' WHEN id < 11500 THEN 'b' ELSE 'c' END AS source")
    got = mix_sources(docs).collect()
    sizes = dict(sorted(Counter(r.source for r in got).items()))
    weights = {k: float(n) ** 0.5 for k, n in sizes.items()}
    assert {r.source: r.weight for r in got} == weights
    within_one_block(sizes, weights, {k: sorted(r.slot for r in got if r.source == k) for k in sizes})


def test_more_sources_than_two_thousand_and_sources_that_are_numbers(spark, monkeypatch):
    many = spark.range(3000).selectExpr("id AS doc_id", "'x' AS text", "id % 2500 AS source")
    assert sorted(r.slot for r in mix_sources(many).collect()) == list(range(3000))
    monkeypatch.setattr(M, "BROADCAST_BLOCKS", 10)
    assert sorted(r.slot for r in mix_sources(many).collect()) == list(range(3000))


def test_large_tables_get_blocks_of_more_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_BLOCKS", 100)
    docs = spark.range(1000).selectExpr("id AS doc_id", "'x' AS text", "if(id < 700, 'a', 'b') AS source")
    got = mix_sources(docs).collect()
    assert {r.slot for r in got} == set(range(100)) and {r.row_in_block for r in got} == set(range(10))
    assert len({(r.slot, r.row_in_block) for r in got}) == 1000


def test_the_plan_has_no_python(spark, sf_dir):
    from tessella.llm.queries import op10_source_mixing

    plan = op10_source_mixing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
