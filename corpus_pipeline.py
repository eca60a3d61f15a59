"""A corpus prepared for training: toxic texts out, repeated lines out, one of each group of near copies, mixed, encoded."""

from collections.abc import Callable
from itertools import accumulate
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm import bpe_codec, line_windows, pfair, simhash, toxicity
from lineloom.llm.saved import saved, shared_folder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later places of passages of three sentences or lines go from the texts; ``n_chars`` follows."""
    return line_windows.without_repeats(docs, sentences=True).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the first by id (null ids last), fingerprint and text."""
    key = ["doc_id", "__copy_print"]
    groups = simhash.near_duplicates(docs, group_col="__copy_group").withColumnRenamed("fingerprint", "__copy_print")
    groups = saved(groups.select(*key, "component_id", "__copy_group"))
    copies = groups.filter("doc_id != component_id").select("doc_id").distinct()
    kept = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    repeated = saved(groups.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select("doc_id"))
    if repeated.isEmpty():
        return kept
    # Where an id doesn't tell which row it is, id and fingerprint do, and then the text.
    first = F.min(F.struct(F.col("doc_id").isNull(), *key)).alias("first")
    first = groups.groupBy("__copy_group").agg(first).select(F.col("first.doc_id").alias("__copy_id"), F.col("first.__copy_print").alias("__copy_first"))
    unsure = docs.join(repeated.withColumnRenamed("doc_id", "__copy_of"), F.col("doc_id").eqNullSafe(F.col("__copy_of")), "left_semi")
    unsure = unsure.withColumn("__copy_print", simhash.fingerprints(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("__copy_id")) & (F.col("__copy_print") == F.col("__copy_first"))
    rest = [c for c in docs.columns if c != "text"]
    least = unsure.join(first, same, "left_semi").groupBy(*key).agg(F.min(F.struct("text", *rest)).alias("__copy_row"))
    once = least.select("__copy_row.*").select(*docs.columns)
    return kept.filter("doc_id IS NOT NULL").join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come in the order of the mix, so that any first part of them has the target weights to within a block a source.

    That holds until the first source runs out.
    """
    return pfair.in_order(docs, exact=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again, in the order in which ``docs`` was written.

    ``position`` counts from 0 in that order. ``docs`` is a folder read from files: Spark reads them packed by
    size, so the order is taken from their numbers and the rows' places in them.
    """
    place = F.struct("doc_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    encoded = bpe_codec.digests(docs.select(place.alias("place"), "text"), public_tokenizers.path("byte_bpe_50k.json"), "place")
    encoded = saved(encoded.select("place.*", *[c for c in encoded.columns if c != "place"]))
    number = F.regexp_extract("file", r"^part-(\d+)", 1).try_cast("long")
    files = encoded.groupBy("file").count().orderBy(number, "file").collect()  # as many as the driver lists anyway
    before = accumulate((r["count"] for r in files), initial=0)
    starts = spark.createDataFrame([(r.file, n) for r, n in zip(files, before)], "file string, start long")
    placed = encoded.join(F.broadcast(starts), "file").withColumn("position", F.col("start") + F.col("row"))
    return placed.drop("file", "row", "start").orderBy("position")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: A classifier and a tokenizer are no SQL; tests/llm checks the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read again; rows in the order of the mix."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
