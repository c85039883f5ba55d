"""From retrieved records to a fused, ranked and banded answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import config as C
from tessella.functions import scoring as S


def code_hits(queries: DataFrame, records: DataFrame) -> DataFrame:
    """qid and rid with the same normalised code. Both tables have a column `code`."""
    return queries.where("code IS NOT NULL").select("qid", "code").join(records.where("code IS NOT NULL").select("rid", "code"), "code").select("qid", "rid")


def _deletions(code: Column, most: int) -> Column:
    """The texts that up to `most` deletions make of code, code among them."""
    out = level = F.array(code)
    for _ in range(most):
        cut = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        level = F.array_distinct(F.flatten(F.transform(level, cut)))
        out = F.array_union(out, level)
    return out


def fuzzy_codes(left: DataFrame, right: DataFrame, most: int = C.CODE_DISTANCE) -> DataFrame:
    """code, near and edits of all pairs of distinct codes within `most` edits.

    Two such codes have a text in common that `most` deletions at most make of each, so an equi-join on these
    finds every pair; both tables have a column `code`."""
    a = left.where("code IS NOT NULL").select("code").distinct().withColumn("cut", F.explode(_deletions(F.col("code"), most)))
    b = right.where("code IS NOT NULL").select(F.col("code").alias("near")).distinct().withColumn("cut", F.explode(_deletions(F.col("near"), most)))
    met = a.join(b, "cut").select("code", "near").distinct()
    return met.withColumn("edits", F.levenshtein("code", "near", most)).where("edits >= 0")


def with_code_hits(hits: DataFrame, coded: DataFrame) -> DataFrame:
    """Retrieved records and code hits: qid, rid, score (0 if only the code was found) and by_code."""
    both = hits.select("qid", "rid", "score", F.lit(False).alias("by_code")).unionByName(coded.select("qid", "rid", F.lit(0.0).alias("score"), F.lit(True).alias("by_code")))
    return both.groupBy("qid", "rid").agg(F.max("score").alias("score"), F.bool_or("by_code").alias("by_code"))


def prefilter(candidates: DataFrame, m: int = C.VERIFY_TOP_M) -> DataFrame:
    """All code hits, and of the order (-score, rid) the first m less the number of code hits; all if m <= 0."""
    if m <= 0:
        return candidates
    every = _by_query(candidates)
    place = F.row_number().over(every.orderBy(F.desc("score"), "rid"))
    kept = F.sum(F.col("by_code").cast("int")).over(every)
    out = candidates.withColumns({"place": place, "kept": kept, "n": F.count("*").over(every)})
    return out.where((F.col("n") <= m) | F.col("by_code") | (F.col("place") <= F.greatest(F.lit(0), m - F.col("kept")))).drop("place", "kept", "n")


def fuse(candidates: DataFrame, queries: DataFrame, records: DataFrame, geometric: Column) -> DataFrame:
    """qid, rid, score (tier 1), by_code and fused, the weighted sum with the terms of both records."""
    q = queries.select("qid", *[F.col(c).alias(f"q_{c}") for c in ("brand", "code", "aspect")])
    c = records.select("rid", "brand", "code", "aspect")
    met = candidates.join(c, "rid").join(q, "qid")
    total = S.fused(geometric, F.col("score"), S.brand_agreement(F.col("q_brand"), F.col("brand")), S.aspect_agreement(F.col("q_aspect"), F.col("aspect")), S.code_bonus(F.col("q_code"), F.col("code")))
    return met.withColumn("fused", S.rounded(total)).drop("brand", "code", "aspect", "q_brand", "q_code", "q_aspect")


def fuse_by_code(hits: DataFrame, queries: DataFrame, records: DataFrame, geometric: Column, m: int = C.VERIFY_TOP_M) -> DataFrame:
    """fuse() of the prefiltered hits and code hits, where no qid of queries and no rid of records occurs twice.

    Rows are dealt by the code of their query (its id, if it has none). Code hits, which may be hundreds for a query, so
    arise where they are ranked, and only retrieved records are shuffled. The column dealt tells ranked() and answers()."""
    q = queries.select(F.coalesce("code", F.concat(F.lit("id:"), F.col("qid").cast("string"))).alias("dealt"), "qid", *[F.col(c).alias(f"q_{c}") for c in ("brand", "code", "aspect")])
    c = records.select("rid", "brand", "code", "aspect", F.lit(True).alias("known"))
    terms = {
        "t_brand": S.brand_agreement(F.col("q_brand"), F.col("brand")),
        "t_aspect": S.aspect_agreement(F.col("q_aspect"), F.col("aspect")),
        "t_code": S.code_bonus(F.col("q_code"), F.col("code")),
    }
    kept = ("dealt", "qid", "rid", "score", "by_code", "known", *terms)
    found = hits.select("qid", "rid", "score", F.lit(False).alias("by_code")).join(c, "rid", "left").join(q, "qid").withColumn("known", F.coalesce("known", F.lit(False)))
    coded = q.where("q_code IS NOT NULL").join(c.where("code IS NOT NULL"), F.col("dealt") == F.col("code")).withColumns({"score": F.lit(0.0), "by_code": F.lit(True)})
    both = found.withColumns(terms).select(*kept).repartition("dealt").unionByName(coded.withColumns(terms).select(*kept))
    rows = both.groupBy("dealt", "qid", "rid").agg(F.max("score").alias("score"), F.bool_or("by_code").alias("by_code"), F.bool_or("known").alias("known"), *[F.max(t).alias(t) for t in terms])
    total = S.fused(geometric, F.col("score"), *[F.col(t) for t in terms])
    return prefilter(rows, m).where("known").withColumn("fused", S.rounded(total)).drop("known", *terms)


def _by_query(rows: DataFrame) -> Window:
    return Window.partitionBy(*[c for c in ("dealt", "qid") if c in rows.columns])


def ranked(fused: DataFrame) -> DataFrame:
    return fused.withColumn("rank", F.row_number().over(_by_query(fused).orderBy(F.desc("fused"), "rid")))


def answers(fused: DataFrame) -> DataFrame:
    """One row for each query: top record, top score, margin to the next (0 if alone) and n."""
    every = _by_query(fused)
    order = every.orderBy(F.desc("fused"), "rid")
    out = fused.withColumns({"rank": F.row_number().over(order), "second": F.lead("fused", 1, 0.0).over(order), "n": F.count("*").over(every)})
    return out.where("rank = 1").select("qid", F.col("rid").alias("top_rid"), F.col("fused").alias("top"), F.round(F.col("fused") - F.col("second"), 6).alias("margin"), "n")
