"""From raw documents to mixed, tokenised training data.

Five stages, each one of the operators, over all that the stage before it kept:

1. quality_classifier: rows that the discriminant rejects go.
2. ngram_join: of each class of near copies the row with the least doc_id stays.
3. substring_dedup: words under a 20-word window that also starts earlier are cut out of the text
   (n_chars follows); rows stay, also those that lose all their words.
4. source_mixing: the rows are laid out in the order of the mix (sources weighted by the root of
   their rows), range-partitioned and sorted by slot.
5. byte_bpe: each text becomes its token ids, with digests of the ids and of the decoded bytes; the
   column slot is the row's place in the mix, restored from the part files of stage 4.

The stages but the last return the columns of documents. Each stage's rows are written as
Parquet under the session's shared checkpoint folder and read again by the next. A stage's rows are deleted when the next stage's are written, the last ones' when the session ends.

Edge cases are those of the operators: null and empty texts pass as empty ones (where the discriminant
keeps them), an empty table gives an empty result, repeated rows of one doc_id and text become one in
stage 2, very long texts are rows like any other, and other columns of documents pass through, but
for those named like the last stage's results (ids, n_tokens, ids_sha256, decoded_sha256, slot), which
that stage replaces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.byte_bpe import bpe_tokens
from tessella.llm.ngram_join import drop_near_copies
from tessella.llm.packing import checkpoint_folder, delete
from tessella.llm.quality_classifier import keep_quality
from tessella.llm.queries import bpe_vocabulary, remainder
from tessella.llm.source_mixing import in_mix_order, mix_sources, places_in_mix
from tessella.llm.substring_dedup import cut_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_quality(docs, labels, remainder(5) != 0)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = cut_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in cut.columns else cut


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_mix_order(mix_sources(docs), docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_tokens(places_in_mix(docs), *bpe_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_join", ngram_join),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: The stages fit a model, follow paths drawn by hashes and merge bytes by rank; SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; every stage but the last is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    delete(spark, folder, at_exit=True)
    read = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            if read:
                delete(spark, read)
            read = f"{folder}/{k}-{name}"
            docs = spark.read.parquet(read)
    return docs
