import zlib

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import quality_classifier as Q


def stats(*texts):
    raw = [x.encode() for x in texts]
    with np.errstate(over="ignore"):
        return Q.text_statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_statistics_by_hand():
    got = dict(zip(Q.FEATURES, stats("Ab ab ab #1|\nx y.\n\nx y.\n")[0], strict=True))

    def rate(name, part, whole):
        r, w = Q.PRIORS[name]
        share = (part + r * w) / (whole + w)
        return np.log(share / (1 - share))

    size = len("Ab ab ab #1|\nx y.\n\nx y.\n")
    assert np.isclose(got["symbols"], rate("symbols", 1, size)) and np.isclose(got["bars"], rate("bars", 1, size))
    assert np.isclose(got["marks"], rate("marks", 2, size)) and np.isclose(got["capitals"], rate("capitals", 1, 10))
    assert np.isclose(got["dup_lines"], rate("dup_lines", 1, 3)) and np.isclose(got["distinct"], rate("distinct", 5, 8))
    assert np.isclose(got["top_word"], rate("top_word", 2, 8)) and np.isclose(got["line_words"], np.log((8 + 120) / 9))


def test_statistics_do_not_depend_on_the_batch():
    texts = ["", "a b c " * 50, "x", "l\nl\nl\n" * 9, "é # 12"]
    assert np.allclose(stats(*texts), np.vstack([stats(x) for x in texts]))


def test_scores_are_those_of_the_plain_formula():
    rng = np.random.default_rng(1)
    p = len(Q.FEATURES)
    x = {k: rng.normal(k, 1 + k, (80, p)) for k in (0, 1)}
    model = Q.Discriminant({k: (80.0, v.sum(0), v.T @ v) for k, v in x.items()}, strength=20)
    pooled = sum(np.cov(v.T, bias=True) for v in x.values()) / 2
    density = []
    for k in (0, 1):
        a = 20 / 100
        cov = (1 - a) * np.cov(x[k].T, bias=True) + a * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled))) + Q.RIDGE * np.eye(p)
        d = x[0] - x[k].mean(0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.scores(x[0]), 1 / (1 + np.exp(density[0] - density[1])), atol=1e-9)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in Q.quality_scores(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0).collect()}
    rows = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) == 1000
    assert sum(got[r.doc_id].predicted == r.quality for r in rows) / len(rows) > 0.95


def test_nulls_repeats_and_missing_classes(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "some words here", 9), (3, "some words here", 9), (None, "x", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (3, None), (7, 0)], "doc_id long, quality int")
    got = Q.quality_scores(docs, labels, F.lit(True)).collect()
    assert len(got) == 5 and {r.score for r in got} == {1.0}
    got = Q.quality_scores(docs, labels.limit(0), F.lit(True)).collect()
    assert {(r.score, r.predicted) for r in got} == {(0.5, 1)}
    assert Q.quality_scores(docs.limit(0), labels, F.lit(True)).count() == 0


def test_the_fit_from_documents_repeats_and_long_texts(spark):
    """The registered path against moments taken by numpy from the same statistics, with a label that counts twice."""
    rng = np.random.default_rng(3)
    words = [f"word{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(words, rng.integers(5, 80))) + ("!" * 30 + "|" if k % 3 == 0 else "."), k % 2) for k in range(120)]
    rows.append((500, " ".join(rng.choice(words, 300_000)), 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, stats int")
    marks = [(k, int(k % 3 != 0)) for k in range(0, 120, 2)]
    labels = spark.createDataFrame([*marks, marks[4], (9999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in Q.quality_scores(docs, labels, F.lit(True)).collect()}
    text = {d: t for d, t, _ in rows}
    stats = lambda ids: np.vstack([Q.text_statistics(np.frombuffer(text[d].encode(), np.uint8), np.array([0, len(text[d].encode())])) for d in ids])
    moments = {}
    for k in (0, 1):
        x = stats([d for d, y in [*marks, marks[4]] if y == k])
        moments[k] = (float(len(x)), x.sum(0), x.T @ x)
    with np.errstate(over="ignore"):
        want = dict(zip(text, Q.Discriminant(moments).scores(stats(text)), strict=True))
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in got)
