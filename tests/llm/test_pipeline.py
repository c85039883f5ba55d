import hashlib

import tiktoken

import corpus_pipeline
from tessella.llm.queries import bpe_vocabulary, remainder
from tessella.llm.quality_classifier import quality_scores
from tessella.llm.source_mixing import mix_sources
from test_ngram_join import brute as near
from test_substring_dedup import brute as repeats


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    raw, quality, single, cut, mixed, tokens = kept
    scores = {r.doc_id: r.predicted for r in quality_scores(spark.createDataFrame(raw), spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(5) != 0).collect()}
    assert sorted(r.doc_id for r in quality) == sorted(d for d, p in scores.items() if p)
    heads = {c for _, _, c, _, _ in near([(r.doc_id, r.text) for r in quality])}
    assert {r.doc_id for r in single} == heads and len(single) == len(heads)
    lost = repeats([(r.doc_id, r.text) for r in single], 20)
    text = {r.doc_id: r.text for r in single}
    for r in cut:
        n, removed, digest = lost[r.doc_id, text[r.doc_id]]
        assert hashlib.sha256(" ".join(r.text.split()).encode()).hexdigest() == digest and r.n_chars == len(r.text)
        assert removed or r.text == text[r.doc_id]
    assert sorted(r.doc_id for r in mixed) == sorted(r.doc_id for r in cut) and mixed != cut
    path, pattern = bpe_vocabulary()
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in mixed}
    assert len(tokens) == len(mixed)
    for r in tokens:
        assert r.ids == library.encode_ordinary(text[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_gives_the_rows_of_the_last_stage(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(rows.columns) and rows.count() > 100


def test_run_over_many_files_returns_the_schedule(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wanted = {r.doc_id: r.slot for r in mix_sources(docs).collect()}
    files = []

    def tokens(session, laid, folder):
        files.extend(laid.inputFiles())
        return corpus_pipeline.byte_bpe(session, laid, folder)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[3], ("byte_bpe", tokens)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = corpus_pipeline.run(spark, sf_dir).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) > 3 and len(got) == len(wanted) == docs.count()
    assert {r.doc_id: r.slot for r in got} == wanted


def with_odd_rows(spark, sf_dir, folder):
    """The documents with nulls, repeats, a very long text and extra columns of clashing names."""
    import random

    import pyspark.sql.functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(1)
    long = " ".join(f"word{rng.randrange(5000)} is here" for _ in range(40_000))
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, None, "en", "s", 0), (900_002, "", None, None, 0), (900_003, long, "en", None, len(long)), (900_004, long, "en", "s", len(long)), (900_004, long, "en", "s", len(long))], docs.schema)
    named = {"slot": F.lit(-1), "sid": F.lit("x"), "th": F.lit(2), "row": F.lit(3), "rest": F.lit(4), "head_id": F.lit(5), "src": F.lit(6), "block": F.lit(7), "ids": F.lit(8)}
    docs.unionByName(odd).withColumns(named).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{folder}/labels.parquet")


def test_nulls_repeats_long_texts_and_clashing_names(spark, sf_dir, tmp_path):
    with_odd_rows(spark, sf_dir, tmp_path)
    rows = corpus_pipeline.run(spark, str(tmp_path))
    got = rows.collect()
    plain = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {"sid", "th", "row", "rest", "head_id", "src", "ids", "slot"} <= set(rows.columns) and len(set(rows.columns)) == len(rows.columns)
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert {r.sid for r in got} == {"x"} and {r.head_id for r in got} == {5} and {r.src for r in got} == {6}
    assert {d: r.ids_sha256 for d, r in plain.items()} == {r.doc_id: r.ids_sha256 for r in got if r.doc_id is not None and r.doc_id < 900_000}
    assert sum(r.doc_id in (900_003, 900_004) for r in got) <= 1


def test_an_empty_table(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
