import json
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import catalog as K
from tessella.operators import index as I
from tessella.operators import layout as L
from tessella.operators import match as M
from tessella.operators import verify as V
from tessella.sources import documents as D
from tessella.streaming import lifecycle


def boxes(rng, n):
    return [(k, rng.random(), rng.random(), rng.uniform(0.01, 0.3), rng.uniform(0.01, 0.3), rng.choice(["red", "grey"]), rng.choice(["A", None])) for k in range(n)]


BOX = "pos int, x double, y double, w double, h double, color string, label string"


def test_pairs_and_assignment_match_the_readable_rule(spark):
    rng, some = random.Random(1), 0
    for _ in range(4):
        a, b = boxes(rng, 12), boxes(rng, 10) + [(10, 0.5, 0.5, 0.1, 0.1, "red", None), (11, 0.5, 0.5, 0.1, 0.1, "red", None)]
        want = []
        for i, x, y, w, h, c, _ in a:
            for j, x2, y2, w2, h2, c2, _ in b:
                d, p, q = ((x - x2) ** 2 + (y - y2) ** 2) ** 0.5, max(w * h, 1e-9), max(w2 * h2, 1e-9)
                if d <= 0.25 and max(p / q, q / p) <= 2.2**2:
                    want.append((d + (0.35 if c != c2 else 0), i, j))
        used_i, used_j, greedy = set(), set(), []
        for cost, i, j in sorted(want):
            if i not in used_i and j not in used_j:
                used_i.add(i), used_j.add(j), greedy.append((i, j))
        some += len(greedy)
        left, right = (spark.createDataFrame(r, BOX).withColumn("k", F.lit(1)) for r in (a, b))
        asked, met = left.withColumnRenamed("k", "qid"), right.withColumn("qid", F.lit(1)).withColumnRenamed("k", "cid")
        got = V.assign_candidates(asked, met).collect()
        assert sorted((r.pos, r.pos_c) for r in got) == sorted(greedy)
        cost = {(r.pos, r.pos_c): r.cost for r in L.candidate_pairs(left, right, "k").collect()}
        assert all(abs(cost[r.pos, r.pos_c] - r.cost) < 1e-12 for r in got)
    assert some


def test_ransac_finds_the_transform_among_outliers():
    rng = np.random.default_rng(2)
    src = rng.random((30, 2))
    dst = src @ np.array([[1.05, 0.02], [-0.03, 0.98]]).T + [0.01, -0.02]
    dst[:8] = rng.random((8, 2))
    transform, inlier = V.ransac_affine(src, dst)
    assert inlier[8:].all() and np.allclose(transform[:, 2], [0.01, -0.02], atol=0.02) and V.plausible(transform)
    assert V.ransac_affine(src[:2], dst[:2])[0] is None
    again, _ = V.ransac_affine(src, dst)
    assert (again == transform).all()


def test_a_record_verifies_itself(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame(boxes(rng, 20), BOX).withColumn("k", F.lit(1))
    many = rows.withColumn("qid", F.lit(1)).drop("k").crossJoin(spark.range(150).withColumnRenamed("id", "cid"))
    found = V.verify_candidates(rows.withColumnRenamed("k", "qid"), many).collect()
    assert len(found) == 150  # more than one part of candidates
    got = found[0]
    assert got.inliers == 20 and got.coverage == 1.0 and got.geometric == 1.0


def test_fewer_than_three_inliers_tell_no_transform():
    src = np.array([[0.1, 0.1], [0.9, 0.15], [0.2, 0.8], [0.7, 0.75], [0.5, 0.3]])
    dst = np.array([[0.9, 0.2], [0.1, 0.9], [0.5, 0.5], [0.95, 0.05], [0.3, 0.6]])
    transform, inlier = V.ransac_affine(src, dst, limit=-1.0)
    assert transform is None and not inlier.any()
    line = np.column_stack([np.linspace(0, 1, 6), np.linspace(0, 1, 6)])
    assert V.ransac_affine(line, line)[1].all()  # no solid corner: all points are fitted


def test_labels_agree_as_they_are_normalised(spark):
    rng = random.Random(4)
    a = [(k, rng.random(), rng.random(), 0.1, 0.1, "red", "vol +" if k % 2 else "--") for k in range(12)]
    b = [(*r[:6], "VOL" if r[0] % 2 else "ok") for r in a]
    asked = spark.createDataFrame(a, BOX).withColumn("qid", F.lit(1))
    met = spark.createDataFrame(b, BOX).withColumns({"qid": F.lit(1), "cid": F.lit(2)})
    got = V.verify_candidates(asked, met).first()
    assert got.inliers == 12 and got.bonus == pytest.approx(0.30)


def test_ratios():
    assert V.indel_ratio("abc", "abc") == 100 and V.indel_ratio("", "") == 100 and V.indel_ratio("ab", "cd") == 0
    assert V.indel_ratio("kitten", "sitting") == pytest.approx(100 * (1 - 5 / 13))
    assert V.partial_ratio("mark", "the watermark here") == 100 and V.partial_ratio("", "x") == 0


def test_ratios_of_many_texts_equal_those_of_each():
    rng, phrase = random.Random(3), "licensed under the apache license"
    texts = ["".join(rng.choice("licensed unrthapo é") for _ in range(rng.randrange(0, 90))) for _ in range(150)]
    texts += [phrase, f"x{phrase}y", phrase[:20], phrase[5:], "a", "", "😀licensed under the apachelicense"]
    want = [V.partial_ratio(x, phrase) for x in texts]
    assert np.allclose(V.partial_ratios(texts, phrase), want) and np.allclose(V.partial_ratios(texts, phrase, 100), want)
    for other in ("abc licensed", "x", phrase * 2):
        assert np.allclose(V.full_ratios(texts, other), [V.indel_ratio(x, other) for x in texts])


def test_best_ratios_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "KNOWN_BLOCK", 4)
    rng = random.Random(6)
    words, known = (["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8))) for _ in range(n)] for n in (40, 15))
    got = V.best_ratios(spark.createDataFrame([(w,) for w in [*words, words[0], None]], "a string"), spark.createDataFrame([(w,) for w in known], "b string")).collect()
    want = {w: max((V.indel_ratio(w, b), [-ord(c) for c in b] + [1], b) for b in known) for w in words}
    assert len(got) == len(want) and all(r.ratio == pytest.approx(want[r.a][0]) and V.indel_ratio(r.a, r.b) == pytest.approx(r.ratio) for r in got)
    ties = {w: min(b for b in known if V.indel_ratio(w, b) > want[w][0] - 1e-9) for w in words}
    assert {r.a: r.b for r in got} == ties


SEEN = "rid int, pass int, polarity string, pos int, x double, y double, w double, h double, conf double"


def test_votes_and_suppression(spark):
    rows = [(1, 0, "dark", 0, 0.5, 0.5, 0.2, 0.2, 0.9), (1, 1, "dark", 0, 0.51, 0.5, 0.22, 0.2, 0.5), (1, 1, "dark", 1, 0.1, 0.1, 0.05, 0.05, 0.4)]
    df = spark.createDataFrame(rows, SEEN)
    got = V.merge_votes(df, "rid", fewest=1).collect()
    assert [(r.votes, r.w) for r in got] == [(2, 0.22)]
    assert sorted((r.votes, r.w) for r in V.merge_votes(df, "rid").collect()) == [(1, 0.05), (1, 0.22)]  # the fullest pass alone
    assert V.suppress_overlaps(df, "rid").count() == 2


def test_votes_count_within_a_polarity_and_nested_boxes_go(spark):
    at = [(k, 0.1 + 0.2 * k, 0.3, 0.1, 0.1) for k in range(4)]
    rows = [(1, p, "dark", *b, 0.5) for p in (0, 1) for b in at]
    rows += [(1, 2, "light", k, x, y, 0.04, 0.04, 0.5) for k, x, y, _, _ in at]  # glyphs inside: too small to merge
    rows += [(1, 3, "light", *b, 0.5) for b in at[:2]]  # a pass of too few boxes does not count
    rows += [(1, 0, "dark", 9, 0.4, 0.3, 0.9, 0.3, 0.5), (1, 1, "dark", 9, 0.4, 0.3, 0.9, 0.3, 0.5)]  # a panel around all
    got = V.merge_votes(spark.createDataFrame(rows, SEEN), "rid").collect()
    assert [(r.place, round(r.x, 6), r.w, r.votes) for r in got] == [(k, round(0.1 + 0.2 * k, 6), 0.1, 2) for k in range(4)]


def test_self_retrieval_and_exclusions(spark):
    rng = random.Random(5)
    rows = [(r, *b) for r in range(30) for b in boxes(rng, 15)]
    b = spark.createDataFrame(rows, "rid long, " + BOX)
    index = I.TokenIndex(b, F.col("rid") % 7 == 0)
    hits = index.retrieve(I.grid_tokens(b.withColumnRenamed("rid", "qid"), "qid"))
    top = {r.qid: r.rid for r in hits.where("rk = 1").collect()}
    assert all(q == r for q, r in top.items()) and len(top) == 30
    assert hits.where("score > 1").count() == 0


def test_scores_by_blocks_equal_a_plain_sum(spark, monkeypatch):
    """Also for a token that a third of all documents have, and for one that all have."""
    rng = random.Random(8)
    rows = [(r, *b) for r in range(300) for b in boxes(rng, rng.randrange(1, 12))]
    b = spark.createDataFrame(rows, "rid long, " + BOX).withColumn("label", F.when(F.col("rid") % 3 == 0, "hot").otherwise(F.col("label")))
    monkeypatch.setattr(I, "DOC_BLOCK", 40)
    monkeypatch.setattr(I, "QUERY_BLOCK", 30)
    index = I.TokenIndex(b, F.col("rid") % 7 == 0)
    asked = I.grid_tokens(b.where("rid % 4 = 1 OR rid % 9 = 0").withColumnRenamed("rid", "qid"), "qid")
    idf = {r.token: r.idf for r in index.usable().collect()}
    norm = {r.doc: r.norm for r in index.norms.collect()}
    docs, queries = {}, {}
    for to, df in ((docs, index.tokens), (queries, asked)):
        for key, token in df.collect():
            to.setdefault(key, set()).add(token)
    assert set(docs) == {r.doc for r in index.docs.collect()} and len(docs) == index.n_docs
    want = {}
    for q, tokens in queries.items():
        q_mass = sum(idf[t] for t in tokens if t in idf)
        for d, held in docs.items():
            if shared := [idf[t] for t in tokens & held if t in idf]:
                want[q, d] = round(min(sum(shared) / (norm[d] ** 0.5 * q_mass**0.5), 1.0), 9)
    got = {(r.qid, r.doc): r.score for r in index.scores(asked).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-9 for k in want)
    for r in index.scores(asked, 5).collect():
        assert got.pop((r.qid, r.doc)) == r.score
    for q in queries:
        rest = [s for (a, _), s in got.items() if a == q]
        kept = sorted((s for (a, _), s in want.items() if a == q), reverse=True)[:5]
        assert not rest or len(kept) < 5 or max(rest) <= kept[-1] + 2e-9
    assert index.scores(asked.limit(0)).count() == 0


def test_an_index_takes_few_bytes_a_posting_and_queries_shuffle_none(spark):
    rng = random.Random(4)
    b = spark.createDataFrame([(r, *b) for r in range(400) for b in boxes(rng, 30)], "rid long, " + BOX)
    held = lambda: {f: f.stat().st_size for f in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("part-*")}
    I.durable(spark.range(1))
    before = held()
    index = I.TokenIndex(b, F.col("rid") % 7 == 0)
    new = sum(n for f, n in held().items() if f not in before)
    assert new < 12 * index.stats.agg(F.sum("df")).first()[0]
    plan = index.scores(I.grid_tokens(b.withColumnRenamed("rid", "qid"), "qid"), 5)._jdf.queryExecution().executedPlan().toString()
    assert " Exchange" not in plan and "-Exchange" not in plan


def test_tokens_of_blocks_equal_those_of_rows(spark, monkeypatch):
    """Also of null places, labels and colours, and where other parts make the same text."""
    rng = random.Random(6)
    monkeypatch.setattr(I, "DOC_BLOCK", 14)
    rows = [(r, rng.choice([None, rng.random(), rng.random(), 0.0, 1.0]), rng.choice([None, rng.random(), 0.5]), rng.choice([None, 0.05, 0.2, 0.9]), rng.choice([None, "red", "b|1", "1", ""]), rng.choice([None, "Ok", "o k", "--", "7"])) for r in range(60) for _ in range(rng.randrange(1, 9))]
    b = spark.createDataFrame(rows, "rid long, x double, y double, w double, color string, label string")
    index = I.TokenIndex(b, F.col("rid") % 7 == 0)
    want = sorted(tuple(r) for r in I.grid_tokens(I.index_documents(b, F.col("rid") % 7 == 0), "doc").collect())
    assert sorted(tuple(r) for r in index.tokens.collect()) == want and index.blocks.count() > 4
    assert {r.token: r.df for r in index.stats.collect()} == Counter(t for _, t in want)
    assert {(r.doc, r.rid, r.flipped) for r in index.docs.collect()} == {(d, d // 2, d % 2 == 1) for d, _ in want}


def test_scores_round_as_sql_does(spark):
    import duckdb

    from tessella.functions import scoring as S

    values = [k / 1e7 + 0.064 for k in range(5, 5000, 10)] + [-0.0649915, 0.0, None]
    want = [duckdb.execute(f"SELECT round({v}::DOUBLE, 6)").fetchone()[0] if v is not None else None for v in values]
    assert [r.r for r in spark.createDataFrame([(v,) for v in values], "v double").select(S.rounded(F.col("v")).alias("r")).collect()] == want


def test_an_index_whose_files_are_gone_is_built_again(spark, sf_dir):
    import shutil

    from tessella.plans import retrieval

    first = retrieval.index(spark, sf_dir)
    assert retrieval.index(spark, sf_dir) is first
    shutil.rmtree(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    again = retrieval.index(spark, sf_dir)
    assert again is not first and again.readable()


def test_fuzzy_codes_find_every_pair_within_two_edits(spark):
    rng = random.Random(9)
    codes = sorted({"".join(rng.choice("AB12") for _ in range(rng.randrange(1, 6))) for _ in range(80)} | {"RM150", "RM250", "150", ""})
    df = spark.createDataFrame([(c,) for c in codes] + [(None,), ("RM150",)], "code string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = sorted((a, b, edits(a, b)) for a in codes for b in codes if edits(a, b) <= 2)
    assert sorted(tuple(r) for r in M.fuzzy_codes(df, df).collect()) == want


def test_prefilter_keeps_code_hits_and_m(spark):
    rows = [(1, k, 1.0 - k / 100, k == 39) for k in range(40)]
    c = spark.createDataFrame(rows, "qid int, rid int, score double, by_code boolean")
    assert sorted(r.rid for r in M.prefilter(c, 25).collect()) == [*range(24), 39]
    assert M.prefilter(c, 0).count() == 40 and M.prefilter(c, 40).count() == 40


def test_merge_keeps_what_people_wrote(spark):
    old = spark.createDataFrame([("a", True, 1), ("b", None, 2)], "id string, reviewed boolean, n int")
    new = spark.createDataFrame([("a", False, 5), ("c", False, 6)], "id string, reviewed boolean, n int")
    got = {r.id: (r.reviewed, r.n, r.action) for r in K.upsert(old, new, "id", ["reviewed"], prune=True).collect()}
    assert got == {"a": (True, 5, "updated"), "b": (None, 2, "pruned"), "c": (False, 6, "created")}
    again = K.upsert(new, new, "id", ["reviewed"]).collect()
    assert {r.action for r in again} == {"updated"} and len(again) == 2


def test_dedupe_keeps_unreadable_files(spark):
    rows = [("b", b"x"), ("a", b"x"), ("c", None), ("d", None)]
    got = {r.path: r.canonical for r in K.content_dedupe(spark.createDataFrame(rows, "path string, content binary"), "path", F.col("content")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_documents_round_trip(spark, tmp_path):
    good = {"v": 2, "body": {"aspect": 4.2}, "buttons": [{"x": 0.5, "y": 0.5, "w": 0.1, "h": 0.05, "color": "black"}], "stats": {"n_buttons": 12}, "brand": "B"}
    (tmp_path / "X_0.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "Y_1.json").write_text("{broken")
    (tmp_path / "Z_0.json").write_text('{"v": 2}')
    kept, rejects = D.split_rejects(D.read_documents(spark, str(tmp_path)).cache())
    assert [(r.record_id, r.n_buttons) for r in D.catalogue_rows(kept).collect()] == [("X_0", 12)]
    assert sorted(tuple(r) for r in rejects.collect()) == [("Y_1", "unreadable"), ("Z_0", "no body")]


def test_index_of_another_version_is_refused(spark, tmp_path, monkeypatch):
    D.save_index(str(tmp_path), docs=spark.range(3))
    assert D.load_index(spark, str(tmp_path), "docs")["docs"].count() == 3
    monkeypatch.setattr(D.C, "TOKEN_VERSION", 9)
    with pytest.raises(ValueError):
        D.load_index(spark, str(tmp_path), "docs")


def test_flat_files(spark, tmp_path):
    (tmp_path / "truth.tsv").write_text("# note\na_0\tX\nb_0\tBAD\nbroken\nc\td\te\n")
    assert sorted(tuple(r) for r in D.read_truth(spark, str(tmp_path / "truth.tsv")).collect()) == [("a_0", "X"), ("b_0", "BAD")]
    (tmp_path / "brands.txt").write_text("Sony # x\n\n# only\nLG\n")
    assert sorted(r.brand for r in D.read_brands(spark, str(tmp_path / "brands.txt")).collect()) == ["LG", "Sony"]
    for name, raw in (("a.jpg", b"\xff\xd8\x01\xff\xd9\x00\n"), ("b.jpg", b"\xff\xd8\x01"), ("c.png", b"\x89P")):
        (tmp_path / name).write_bytes(raw)
    got = {r.path[-5:]: r.t for r in D.photos(spark, str(tmp_path)).select("path", D.truncated_jpeg(F.col("content")).alias("t")).collect()}
    assert got == {"a.jpg": False, "b.jpg": True, "c.png": False}


def test_rate_windows_on_a_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{k:02d}", "u") for k in range(30)] + [("2024-01-01 00:00:01", "v"), ("2024-01-01 02:00:00", "w")]
    events = spark.createDataFrame(rows, "t string, user string").select(F.to_timestamp("t").alias("ts"), "user")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = lifecycle.rate_windows(stream, "user").writeStream.outputMode("append").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = lifecycle.rate_windows(events, "user").collect()
    assert [(r.user, r.n) for r in batch] == [("u", 30)]
    assert [(r.user, r.n) for r in spark.table("rates").collect()] == [("u", 30)]


def test_rows_of_bytes_find_the_best_of_all_scores(spark, monkeypatch):
    """Also where a byte holds one row only, where tokens have no row, and where a query asks a part of a triple."""
    rng = random.Random(9)
    b = spark.createDataFrame([(r, *b) for r in range(500) for b in boxes(rng, rng.randrange(3, 30))], "rid long, " + BOX)
    asked = I.grid_tokens(b.where("rid % 3 = 1").withColumnRenamed("rid", "qid"), "qid").where("NOT (token LIKE 'Gs|%' AND qid % 5 = 0)")
    monkeypatch.setattr(I, "DOC_BLOCK", 120)
    monkeypatch.setattr(I, "SENT_TOKENS", 0)
    index = I.TokenIndex(b, F.col("rid") % 7 == 0)
    every = {}
    for r in index.scores(asked).collect():
        every.setdefault(r.qid, []).append((-r.score, r.doc, r.mass))
    for steps, rows, least in ((24, 8192, 2), (200, 300, 1), (3, 8192, 1000)):
        for name, value in (("STEPS", steps), ("ROWS", rows), ("LEAST_ASKED", least)):
            monkeypatch.setattr(I, name, value)
        found = {}
        for r in index.scores(asked, 9).collect():
            found.setdefault(r.qid, []).append((-r.score, r.doc, r.mass))
        assert len(found) == len(every) > 150
        for q, rows_of in found.items():
            want, best = sorted(every[q])[:9], sorted(rows_of)[:9]
            assert [x[:2] for x in best] == [x[:2] for x in want] and np.allclose([x[2] for x in best], [x[2] for x in want])
