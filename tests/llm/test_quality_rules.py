import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    under = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(under), n < 10 or 100 * len(under) > 20 * n)


def texts():
    import random

    rng = random.Random(7)
    out = [None, "", " \n\t", "a b c d e a b c d e", "x " * 40, "é# |\n\né# |\nö <>", "one two three four five six seven eight nine ten", "a\x0bb\x0cc\rd"]
    return out + ["".join(rng.choice(["a ", "b ", "c\n", "dd ", "#", "\n", "é "]) for _ in range(rng.randrange(80))) for _ in range(150)]


def test_counts_against_brute_force(spark):
    rows = [(k, x, "en", "s") for k, x in enumerate(texts())]
    got = Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(rows[r.doc_id][1]), rows[r.doc_id]
        assert r.kept is False or not r.base_failed


def test_chi_square():
    assert Q.chi_square_quantile(0.95, 4) == pytest.approx(9.487729)
    assert Q.chi_square_quantile(0.5, 6) == pytest.approx(5.348121)


def test_estimate_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.multivariate_normal([0, 1, 2, 3], np.diag([1, 2, 1, 3]) + 0.5, 400), rng.normal(9, 0.3, (80, 4))])
    rows = spark.createDataFrame([(1, *map(float, v)) for v in x], "gid long, x0 double, x1 double, x2 double, x3 double")
    got = Q.robust_groups(rows).first()
    lower = np.quantile(x, 0.5, axis=0, method="inverted_cdf")
    scatter = np.diag((1.4826 * np.quantile(abs(x - lower), 0.5, axis=0, method="inverted_cdf")) ** 2 + Q.RIDGE)
    centre = lower

    def squared():
        return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)

    for _ in range(Q.STEPS):
        d, before = squared(), np.linalg.slogdet(scatter)[1]
        near = x[d <= np.quantile(d, Q.ALPHA, method="inverted_cdf")]
        factor = Q.ALPHA / Q.chi_square_cdf(Q.chi_square_quantile(Q.ALPHA, 4), 6)
        centre, scatter = near.mean(0), np.cov(near.T, bias=True) * factor + Q.RIDGE * np.eye(4)
        if abs(np.linalg.slogdet(scatter)[1] - before) <= Q.SETTLED:
            break
    limit = Q.chi_square_quantile(0.975, 4)
    near = x[squared() <= limit]
    scatter = np.cov(near.T, bias=True) * 0.975 / Q.chi_square_cdf(limit, 6) + Q.RIDGE * np.eye(4)
    assert np.allclose([got[f"m{i}"] for i in range(4)], near.mean(0))
    factor = np.array([[got[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    assert np.allclose(factor, np.linalg.cholesky(scatter))
    assert np.all(abs(near.mean(0) - [0, 1, 2, 3]) < 0.3)  # the outliers do not move it


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = Q.quality_rules(docs).where("NOT base_failed").join(labels, "doc_id")
    rates = {r.quality: r.kept for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rates[1] > 0.97 and rates[0] < 0.5


def test_no_python_in_the_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = Q.quality_rules(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_nulls_small_groups_and_clashing_columns(spark):
    rows = [(k, "this text has some ten words or more in it " + "w" * (k % 7), "en" if k % 2 else None, None if k % 3 else "s", 1) for k in range(30)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, source string, kept int")
    got = Q.quality_rules(docs).collect()
    assert len(got) == 31 and all(r.kept is True for r in got)
    assert Q.quality_rules(docs.limit(0)).count() == 0


def test_verdicts_follow_from_distances_and_long_texts_are_judged(spark):
    import random

    rng = random.Random(11)
    words = [f"word{k}" for k in range(400)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(40, 200))), "en", "s") for k in range(300)]
    rows += [(1000, " ".join(rng.choice(words) for _ in range(200_000)), "en", "s"), (1001, " ".join("#$%&" + rng.choice(words) for _ in range(150)), "en", "s")]
    rows += [rows[0], rows[1001 - 700]]
    got = Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows)
    limit = Q.chi_square_quantile(Q.CUT, 4) ** 0.5
    for r in got:
        assert r.kept == (not r.base_failed and (r.distance is None or r.distance <= limit))
    assert {r.kept for r in got if r.doc_id == 1001} == {False} and sum(r.kept for r in got) >= 298
    assert len({(r.distance, r.kept) for r in got if r.doc_id == 0}) == 1
