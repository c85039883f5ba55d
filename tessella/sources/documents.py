"""Readers and writers of fingerprint documents, indexes, manifests and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import config as C

BUTTON = "struct<x:double,y:double,w:double,h:double,shape:string,color:string,label:string,label_pos:string,conf:double>"
REGION = "struct<x:double,y:double,w:double,h:double,size:double,text:string,conf:double>"
SCHEMA = (
    "v int, body struct<aspect:double,shape:string,area_frac:double,full_frame:boolean,split:boolean>, "
    f"buttons array<{BUTTON}>, text_regions array<{REGION}>, brand string, brand_source string, brand_conf double, "
    "model_code string, model_code_source string, model_code_ocr string, "
    "stats struct<n_buttons:int,n_chromatic:int,n_labelled:int,n_captions:int,label_recall:double,orientation_flipped:boolean,orientation_conf:double>, "
    "extract_quality double, _corrupt string"
)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each JSON file, with record_id from the file name; _corrupt is set where it does not parse."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "")
    return rows.withColumn("record_id", name)


def split_rejects(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good documents, and rejects (record_id, reason): unreadable ones and those without a body."""
    reason = F.when(F.col("_corrupt").isNotNull(), "unreadable").when(F.col("body").isNull(), "no body")
    marked = documents.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason", "_corrupt"), marked.where("reason IS NOT NULL").select("record_id", "reason")


def catalogue_rows(documents: DataFrame) -> DataFrame:
    """Flat rows; the count of stats wins over the length of the list."""
    return documents.select(
        "record_id", F.col("body.aspect").alias("aspect"), F.coalesce("stats.n_buttons", F.size("buttons")).alias("n_buttons"),
        "brand", "model_code", F.col("extract_quality").alias("quality"), F.col("stats.orientation_conf").alias("orientation_conf"),
    )


def save_index(folder: str, **tables: DataFrame) -> None:
    """The tables of an index, with the versions they were made under."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    meta = spark.range(1).select(F.lit(C.TOKEN_VERSION).alias("token_version"), F.lit(C.FINGERPRINT_VERSION).alias("fingerprint_version"))
    meta.write.mode("overwrite").parquet(f"{folder}/meta")


def load_index(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """The tables of a saved index; one of another token version is refused."""
    meta = spark.read.parquet(f"{folder}/meta").first()
    if meta["token_version"] != C.TOKEN_VERSION:
        raise ValueError(f"the index has token version {meta['token_version']}, not {C.TOKEN_VERSION}: build it again")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a manifest that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    """Names of a list file; what follows # is a comment."""
    return spark.read.text(path).select(F.trim(F.get(F.split("value", "#"), F.lit(0))).alias("brand")).where("brand <> ''")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """record_id and identity of lines with exactly two tab-separated fields; # starts a comment line."""
    parts = spark.read.text(path).where("value NOT LIKE '#%'").select(F.split("value", "\t").alias("p")).where(F.size("p") == 2)
    return parts.select(F.trim(F.get("p", F.lit(0))).alias("record_id"), F.trim(F.get("p", F.lit(1))).alias("identity"))


def write_tsv(rows: DataFrame, folder: str, order: str) -> None:
    rows.orderBy(order).write.mode("overwrite").option("sep", "\t").option("quote", "").csv(folder)


def photos(spark: SparkSession, folder: str, glob: str = "*.{jpg,jpeg,png,webp}") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)


def truncated_jpeg(content: Column) -> Column:
    """Whether JPEG bytes lack their end mark; zero bytes and white space after it are fine."""
    text = F.hex(content)
    return text.startswith("FFD8") & ~text.rlike("FFD9(00|0D|0A|09|20)*$")
