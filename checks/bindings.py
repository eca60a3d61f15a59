"""The given tables, read as corpora, link edges, projects, runs and a change feed."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.operators.corpus import index_files
from lineloom.plans.index import Index, index_of_files
from lineloom.sources.table import corpus_from_table

# A rendered file takes the keys of one block, so no file grows with its owner.
BLOCK = 1 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores; a table with more splits than cores stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of their source, the extension by language."""
    extension = (
        F.when(F.col("lang") == "en", "py")
        .when(F.col("lang") == "fr", "js")
        .when(F.col("lang") == "de", "php")
        .when(F.col("lang") == "es", "ts")
        .otherwise("md")
    )
    return corpus_from_table(
        spread(table(spark, sf, "documents")),
        path=text(F.col("source"), "/doc_", F.col("doc_id"), ".", extension),
        content=F.col("text"),
        project=F.col("source"),
        last_modified=F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60),
    )


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    return index_files(documents(spark, sf))


def document_index(spark: SparkSession, sf: str) -> Index:
    return index_of_files(document_files(spark, sf), fold_accents=False, projects=projects(spark, sf))


def projects(spark: SparkSession, sf: str) -> DataFrame:
    """One registered project per source of the documents."""
    newest = F.max(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60))
    return (
        table(spark, sf, "documents")
        .groupBy(F.col("source").alias("name"))
        .agg(F.count("*").alias("file_count"), newest.alias("last_indexed"))
        .select(
            "name",
            text("/corpus/", F.col("name")).alias("folder_path"),
            F.lit("indexed").alias("status"),
            "file_count",
            F.lit(0).cast("bigint").alias("symbol_count"),
            "last_indexed",
            F.lit(None).cast("timestamp").alias("created_at"),
            F.lit(None).cast("timestamp").alias("updated_at"),
        )
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """One finished run per project."""
    return projects(spark, sf).select(F.col("last_indexed").alias("finished_at"))


def _blocks(rows: DataFrame, owner: str, key: str, *carried: str) -> DataFrame:
    """Keys of each owner in order, one row per owner and block of keys."""
    return (
        rows.groupBy(F.col(owner).alias("owner"), F.floor(F.col(key) / BLOCK).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), *carried))).alias("items"))
    )


def dealt(rows: DataFrame) -> DataFrame:
    """Owners' blocks over several tasks per core: the files written out from them are far larger than their keys."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "owner", "block")


def code(spark: SparkSession, sf: str) -> DataFrame:
    """Source files written out from the tables: a Python and a script file per customer
    with its orders, a PHP file per supplier with its parts."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = _blocks(table(spark, sf, "orders"), "o_custkey", "o_orderkey").join(
        customer, F.col("owner") == F.col("c_custkey")
    )
    supplier = table(spark, sf, "supplier")
    count = supplier.agg(F.count("*")).scalar()
    part = table(spark, sf, "part").withColumn("owner_key", F.col("p_partkey") % count)
    parts = _blocks(part, "owner_key", "p_partkey", "p_size").join(
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), F.col("owner") == F.col("s_suppkey")
    )
    orders, parts = dealt(orders), dealt(parts)
    owner, nk = F.col("owner"), F.col("n_nationkey")
    keys = lambda line: F.flatten(F.transform("items", line))

    python = F.concat(
        F.array(F.lit("import os"), text("from nation_", nk, " import base"), text("class C", owner, "(Base):")),
        keys(
            lambda i: F.array(
                text("    def order_", i["key"], "(self):"), text("ORDER_", i["key"], " = ", owner)
            )
        ),
    )
    script = F.concat(
        F.array(
            text("import { base } from './nation_", nk, "';"),
            text("const config_", owner, " = require('config/", owner, "');"),
            text("export class C", owner, " extends Base {"),
        ),
        keys(
            lambda i: F.array(
                text("  order_", i["key"], "(self) {"), text("    const hidden = ", i["key"], ";"), text("  }")
            )
        ),
        F.array(F.lit("}"), text("function total_", owner, "() {"), F.lit("  const sum = 0;"), F.lit("}")),
        # Statements that go on in the next line, a list, and functions by default and by assignment.
        F.array(
            F.lit("const"),
            text("  late_", owner, " = ", owner, ";"),
            F.lit("function"),
            text("  run_", owner, "() { const inner = 1; }"),
            text("const far_", owner, " = require("),
            text("  'far/", owner, "'"),
            text("), near_", owner, " = [1, 2],"),
            text("  last_", owner, " = { k: 1 };"),
            text("export default function main_", owner, "() {"),
            F.lit("  let own;"),
            F.lit("}"),
            text("handler_", owner, " = function () { var no = 1; };"),
        ),
    )
    php = F.concat(
        F.array(
            F.lit("<?php"),
            text("require_once 'nation_", nk, ".php';"),
            text("use Nation\\N", nk, "\\Base;"),
            text("class S", owner, " extends Base {"),
            text("public function find_", owner, "($id) {"),
        ),
        keys(lambda i: F.array(text("const PART_", i["key"], " = ", i["p_size"], ";"))),
    )

    def files(rows: DataFrame, kind: str, extension: str, body: Column) -> DataFrame:
        return corpus_from_table(
            rows,
            path=text(kind, "_", owner, "_", F.col("block"), ".", extension),
            content=F.array_join(body, "\n"),
            project=F.col("n_name"),
            last_modified=F.timestamp_seconds(F.lit(1704067200) + owner * 60),
        )

    return (
        files(orders, "customer", "py", python)
        .unionByName(files(orders, "customer", "js", script))
        .unionByName(files(parts, "supplier", "php", php))
    )


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    return index_files(code(spark, sf))


def code_index(spark: SparkSession, sf: str) -> Index:
    return index_of_files(code_files(spark, sf), fold_accents=False)


LINK = r'<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)'


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages as files named by their address, without a project."""
    return corpus_from_table(
        spread(table(spark, sf, "pages")),
        path=F.col("url"),
        content=F.col("html"),
        last_modified=F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60),
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of the web pages as import edges."""
    files = index_files(pages(spark, sf))
    return files.select(
        "file_id",
        "project",
        "path",
        "language",
        F.explode(F.regexp_extract_all("content", F.lit(LINK), F.lit(0))).alias("tag"),
    ).select(
        "file_id",
        "project",
        "path",
        "language",
        F.regexp_extract("tag", LINK, 1).alias("import_path"),
        F.nullif(F.regexp_extract("tag", LINK, 2), F.lit("")).alias("import_name"),
        F.lit("import").alias("import_type"),
    )


def scan(spark: SparkSession, sf: str) -> DataFrame:
    """A later scan: documents labelled toxic were touched, those of low quality are
    gone, and the pages are new."""
    doc_id = F.regexp_extract("path", r"doc_(\d+)", 1).cast("bigint")
    labels = table(spark, sf, "labels")
    found = documents(spark, sf).withColumn("doc_id", doc_id).join(labels, "doc_id", "left")
    known = found.filter(F.coalesce(F.col("quality"), F.lit(1)) != 0).withColumn(
        "last_modified",
        F.when(F.col("toxic") == 1, F.col("last_modified") - F.expr("interval 1 hour")).otherwise(
            F.col("last_modified")
        ),
    )
    return known.drop("doc_id", "quality", "toxic").unionByName(pages(spark, sf))


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a change feed of eight projects."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        text("p", F.col("user_id") % 8).alias("project"),
        text("f", F.col("user_id"), ".py").alias("path"),
        F.when(kind == "signup", "add").when(kind == "error", "unlink").otherwise("change").alias("action"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("props").alias("content"),
    )


def bulk_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of every benchmark passage, as one query per passage."""
    from lineloom.functions import tokens

    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.explode(tokens(F.col("text"), fold_accents=False)).alias("term")
    )


def needles(spark: SparkSession, sf: str) -> DataFrame:
    """Symbol needles of several lengths, from the nation keys."""
    key = F.col("n_nationkey")
    both = F.array(text("order_", key), text(key))
    return table(spark, sf, "nation").select(F.explode(both).alias("needle"))
