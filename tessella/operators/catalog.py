"""Catalogue ETL: merge, prune, dedupe, lookups, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, kept: list[str], prune: bool = False) -> DataFrame:
    """The merged table with `action` (created, updated, stale or pruned).

    Columns in `kept` belong to people: an old value stays. With prune, rows that the source no
    longer has are marked pruned (the caller drops them), else stale."""
    columns = [c for c in old.columns if c != key]
    o = old.select(F.col(key).alias("o_key"), *[F.col(c).alias(f"o_{c}") for c in columns])
    n = new.select(F.col(key).alias("n_key"), *[F.col(c).alias(f"n_{c}") for c in columns])
    met = o.join(n, F.col("o_key") == F.col("n_key"), "full_outer")
    is_old, is_new = F.col("o_key").isNotNull(), F.col("n_key").isNotNull()
    action = F.when(is_old & is_new, "updated").when(is_new, "created").otherwise("pruned" if prune else "stale")
    value = lambda c: F.coalesce(F.col(f"o_{c}"), F.col(f"n_{c}")) if c in kept else F.when(is_new, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
    return met.select(F.coalesce("o_key", "n_key").alias(key), *[value(c).alias(c) for c in columns], action.alias("action"))


def content_dedupe(files: DataFrame, path: str, content: Column) -> DataFrame:
    """files with `canonical`, the alphabetically first path of the same content; unreadable files (null
    content) stand for themselves. A hot content is one group of a partial aggregate."""
    digest = F.md5(content)
    first = files.select(digest.alias("digest"), F.col(path).alias("p")).where("digest IS NOT NULL").groupBy("digest").agg(F.min("p").alias("canonical"), F.count("*").alias("copies"))
    out = files.withColumn("digest", digest).join(first, "digest", "left")
    return out.withColumns({"canonical": F.coalesce("canonical", F.col(path)), "copies": F.coalesce("copies", F.lit(1).cast("long"))})


def unambiguous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key and value of keys that name one distinct value."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")


def first_hit(names: DataFrame, places: DataFrame, name: str, directory: str, priority: str) -> DataFrame:
    """For each name the first directory, by priority, that holds it."""
    return names.join(places, name, "left").groupBy(name).agg(F.min_by(directory, priority).alias(directory))


def completeness(wanted: DataFrame, done: DataFrame, skipped: DataFrame, key: str) -> DataFrame:
    """wanted with status: done, skipped or missing."""
    d, s = done.select(F.col(key)).distinct().withColumn("d", F.lit(True)), skipped.select(F.col(key)).distinct().withColumn("s", F.lit(True))
    met = wanted.join(d, key, "left").join(s, key, "left")
    return met.select(key, F.when(F.col("d"), "done").when(F.col("s"), "skipped").otherwise("missing").alias("status"))


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return events.withColumn("place", place).where("place = 1").drop("place")


def truth_classes(photos: DataFrame, products: DataFrame) -> DataFrame:
    """photo and rid: records of the photo's own products, and all records with one of those products.

    photos: photo, rid; products: rid, product."""
    own = photos.join(products, "rid").select("photo", "product").distinct()
    return own.join(products, "product").select("photo", "rid").distinct()
