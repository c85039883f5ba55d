import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import lm_scoring as L
from tessella.llm.lm_scoring import score_texts
from tessella.llm.queries import op8_lm_scoring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")] + ["</s>"]


def brute(rows, trained, order, k):
    counts = Counter()
    for d, t in rows:
        if d in trained:
            seq = ["<s>", *tokens(t)]
            for n in range(1, order + 1):
                counts.update(tuple(seq[i : i + n]) for i in range(len(seq) - n + 1))
    total = sum(n for g, n in counts.items() if len(g) == 1 and g != ("<s>",))
    distinct = sum(1 for g in counts if len(g) == 1 and g != ("<s>",))
    out = {}
    for d, t in rows:
        seq = ["<s>", *tokens(t)]
        score = base = known = 0
        for i in range(1, len(seq)):
            p = (counts[seq[i],] + 1) / (total + distinct + 1)
            base += math.log10(p)
            known += counts[seq[i],] > 0
            for n in range(2, order + 1):
                if i - n + 1 >= 0:
                    context = tuple(seq[i - n + 1 : i])
                    p = (counts[(*context, seq[i])] + k * p) / (counts[context] + k)
            score += math.log10(p)
        out[d] = (len(seq) - 1, known, total, base, score)
    return out


def texts():
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["a", "B", "b", "cd", "Éa", "x\ty"]) for _ in range(rng.randrange(30)))) for k in range(80)]
    return [*rows, (80, None), (81, ""), (82, "unseen words only"), (83, "a " * 400)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_brute_force(spark, order):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trained = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 != 2 and d != 82}
    got = score_texts(docs, (F.crc32(F.col("doc_id").cast("string")) % 7 != 2) & (F.col("doc_id") != 82), order, 10.0).collect()
    want = brute(rows, trained, order, 10.0)
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_the_model_beats_single_words_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2).where("NOT train").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_repeats_nulls_and_no_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, "c", 1), (2, None, 1)], "doc_id long, text string, batch int")
    got = score_texts(docs, F.lit(False)).collect()
    assert len(got) == 4 and {(r.train_tokens, r.n_known, r.score, r.base_score) for r in got} == {(0, 0, 0.0, 0.0)}
    assert score_texts(docs.limit(0), F.lit(True)).count() == 0


def test_the_registered_query_takes_two_words_of_context(spark, tmp_path):
    rows = [(k, "a b c . b c d . c d a") for k in range(40)]
    mixed = [(k, "a b c d") for k in range(100, 140)] + [(k, "d a b . c d") for k in range(140, 180)]
    spark.createDataFrame(rows + mixed, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    trained = {d for d, _ in rows + mixed if zlib.crc32(str(d).encode()) % 7 != 2}
    want = brute(rows + mixed, trained, 3, 200.0)
    pairs = brute(rows + mixed, trained, 2, 200.0)
    for r in op8_lm_scoring(spark, str(tmp_path)).collect():
        assert r.score == pytest.approx(want[r.doc_id][-1], abs=2e-6) and abs(r.score - pairs[r.doc_id][-1]) > 0.01


def plain_automaton(rows, order, k):
    """States, arcs and failure arcs as dictionaries keyed by tuples of tokens."""
    counts = Counter()
    for t in rows:
        seq = ["<s>", *tokens(t)]
        for n in range(1, order + 1):
            counts.update(tuple(seq[i : i + n]) for i in range(len(seq) - n + 1))
    total = sum(n for g, n in counts.items() if len(g) == 1 and g != ("<s>",))
    distinct = sum(1 for g in counts if len(g) == 1 and g != ("<s>",))

    def p(gram):
        if len(gram) == 1:
            return (counts[gram] + 1) / (total + distinct + 1)
        return (counts[gram] + k * p(gram[1:])) / (counts[gram[:-1]] + k)

    states = {g for g in counts if len(g) < order} | {()}
    arcs = {}
    for g in counts:
        to = g if len(g) < order else g[1:]
        arcs[g[:-1], g[-1]] = (math.log10(p(g)), to)
    failures = {h: math.log10(k / (counts[h] + k)) for h in states if h}
    return states, arcs, failures, -math.log10(total + distinct + 1), total, distinct


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_the_traversal_goes_through_the_states_of_a_plain_automaton(order):
    rng = random.Random(order)
    train = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(12))) for _ in range(30)]
    asked = [" ".join(rng.choice("abcdefz") for _ in range(n)) for n in (0, 1, 2, 40, 300)]
    states, arcs, failures, unseen, total, distinct = plain_automaton(train, order, 5.0)
    with np.errstate(over="ignore"):
        column, buckets = pa.array([*train, *asked]), L.Buckets(4)
        marks = np.arange(len(column)) < len(train)
        _, counts = L.question(column, marks, order, buckets)
        grams = L.Grams(column, order, buckets)
        found = L.BackoffAutomaton(grams, grams.dealt(counts), total, distinct, 5.0)
        weights = found.traverse(grams.ptr)
        assert len(found.depth) == len(states) and len(found.arc_weights) == len(arcs)
        assert np.allclose(found.traverse(grams.ptr, 7), weights, atol=1e-12)  # segments
    number = {}  # of the states: met on the way, always for the same tuple
    for text, a in zip(asked, grams.ptr[len(train) : -1].tolist(), strict=True):
        state = ("<s>",) if ("<s>",) in states else ()
        at = found.starts[marks.sum() + asked.index(text)]
        for i, w in enumerate(tokens(text), a + 1):
            weight, h = 0.0, state
            while (h, w) not in arcs and h:
                weight, h = weight + failures[h], h[1:]
            step, state = arcs.get((h, w), (unseen, ()))
            assert weights[i] == pytest.approx(weight + step, abs=1e-9)
            at, _ = found.step(np.atleast_1d(at), np.array([i]))
            assert number.setdefault(state, int(at[0])) == int(at[0]) and found.depth[at[0]] == len(state)
    assert len(set(number.values())) == len(number)


def test_a_very_long_text_scores_as_its_tokens_do(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["a", "b", "c", "dd"]) for _ in range(60_000)) + " " + "y" * (2 << 20)
    rows = [(k, "a b c dd a b") for k in range(20)] + [(100, long)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, bucket int, hashes string")
    got = {r.doc_id: r for r in score_texts(docs, F.col("doc_id") != 100).collect()}
    want = brute(rows, set(range(20)), 3, 200.0)[100]
    assert (got[100].n_tokens, got[100].n_known) == want[:2] and math.isclose(got[100].score, want[-1], rel_tol=1e-9)


def scored_batch(rows, trained, order, k):
    """key -> n_known, base_score and score, by the functions of the workers, one after the other."""
    with np.errstate(over="ignore"):
        buckets = L.Buckets(4)
        keys, texts_ = zip(*rows, strict=True)
        marks = np.array([d in trained for d in keys])
        table = pa.table({"batch": np.zeros(len(rows), np.int64), "key": pa.array(keys), "train": marks, "text": pa.array(texts_, pa.string())})
        learnt = [w for d, t in rows if d in trained for w in tokens(t)]
        total, distinct = len(learnt), len(set(learnt))
        answers = L._ask(order, buckets)(table)
        out = L._score(order, buckets, total, distinct, k, ["key", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])(table, answers.take(list(reversed(range(len(answers))))))
    return {r["key"]: (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out.to_pylist()}


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize(("run", "together"), [(1, 1), (40, 150), (1 << 16, 1 << 19)])
def test_runs_of_texts_score_as_the_whole_batch(monkeypatch, order, run, together):
    monkeypatch.setattr(L, "RUN", run)
    monkeypatch.setattr(L, "TOGETHER", together)
    rows = texts()
    trained = {d for d, _ in rows if d % 7 != 2 and d != 82}
    want, got = brute(rows, trained, order, 10.0), scored_batch(rows, trained, order, 10.0)
    assert got.keys() == want.keys()
    for d, row in got.items():
        assert row[:3] == want[d][:3] and row[3:] == pytest.approx(want[d][3:], rel=1e-9)


def test_memory_of_a_batch(monkeypatch):
    """Bytes for each token at most, beside the texts: two workers of an executor hold a batch of 16 MB each."""
    monkeypatch.setattr(L, "RUN", 1 << 12, raising=False)
    monkeypatch.setattr(L, "TOGETHER", 1 << 15, raising=False)
    monkeypatch.setattr(L, "PIECE_BYTES", 1 << 16)
    rng = random.Random(6)
    words = [f"{rng.randrange(10**6):x}" for _ in range(20_000)]
    rows = [(k, " ".join(rng.choices(words, k=200))) for k in range(2000)]
    n, peaks = 402_000, []
    table = pa.table({"batch": np.zeros(len(rows), np.int64), "key": [d for d, _ in rows], "train": [d % 7 != 2 for d, _ in rows], "text": [t for _, t in rows]})
    buckets, names = L.Buckets(32), ["key", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    ask, score = L._ask(3, buckets), L._score(3, buckets, n, 20_000, 200.0, names)
    with np.errstate(over="ignore"):
        answers = ask(table)
        score(table, answers)  # tables of powers, kept
        for run in (lambda: ask(table), lambda: score(table, answers)):
            tracemalloc.start()
            try:
                run()
                peaks.append(tracemalloc.get_traced_memory()[1] / n)
            finally:
                tracemalloc.stop()
    assert max(peaks) < 100, peaks
