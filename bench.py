"""Headline timings, as one JSON line.

Builds and stores an index over the documents and one over the rendered source files,
then times reads, bulk queries and an incremental run on the stored tables. Reads run
once to warm up and are then timed as the best of three.
"""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from checks import bindings as b
from lineloom.operators import bulk, maintain, match
from lineloom.plans import lookup, search, stats
from lineloom.sources import store
from lineloom.sources.table import corpus_from_table
from lineloom.streaming import sessions

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("lineloom bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="bench-")
    times = {}

    def once(name, action):
        started = time.perf_counter()
        result = action()
        times[name] = round(time.perf_counter() - started, 3)
        return result

    def read(name, frame):
        frame().collect()
        runs = []
        for _ in range(3):
            once(name, lambda: frame().collect())
            runs.append(times[name])
        times[name] = min(runs)

    def sink(name, frame):
        once(name, lambda: frame().write.format("noop").mode("overwrite").save())

    documents, code = f"{work}/documents", f"{work}/code"
    warm_up = time.perf_counter()
    item = F.col("item_id").cast("string")
    few = b.table(spark, SF, "benchmark").select(F.explode(F.array(*map(F.lit, (".py", ".js")))).alias("e"), "*")
    store.index_corpus(
        corpus_from_table(few, F.concat(item, "e"), F.col("text"), F.lit("p"), F.current_timestamp()), f"{work}/few"
    )
    warm_up = time.perf_counter() - warm_up
    pieces = 2 * int(CPUS)
    once(
        "write_document_index",
        lambda: store.index_corpus(b.documents(spark, SF), documents, b.projects(spark, SF), partitions=pieces),
    )
    once("write_code_index", lambda: store.index_corpus(b.code(spark, SF), code, partitions=pieces))
    docs, source = store.read_index(spark, documents), store.read_index(spark, code)

    read("search_code", lambda: search.search_code(docs, "for that this"))
    read("search_code_project", lambda: search.search_code(docs, "of the", project="src3"))
    read("search_files", lambda: search.search_files(docs, "that src4"))
    read("match_phrase", lambda: match.match_phrase(docs.postings, ["of", "the"]))
    read("match_near", lambda: match.match_near(docs.postings, ["with", "that"], 3))
    read("match_prefix", lambda: match.match_prefix(docs.postings, "whst"))
    read("get_context", lambda: search.get_context(source, "sum"))
    read("find_symbol", lambda: lookup.find_symbol(source.symbols, "Order_1"))
    read("get_file", lambda: lookup.get_file(source.files, "supplier_7_0.php"))
    read("get_imports", lambda: lookup.get_imports(source.imports, "customer_7_0.js"))
    read("get_dependents", lambda: lookup.get_dependents(source.imports, "nation_2"))
    read("list_files", lambda: lookup.list_files(docs.files, language="php"))
    read("index_stats", lambda: stats.index_stats(source))
    read("language_breakdown", lambda: stats.language_breakdown(source.files, source.symbols))
    read("recent_files", lambda: stats.recent_files(docs.files))

    sink("bulk_match_all", lambda: bulk.bulk_match_all(docs.postings, b.bulk_terms(spark, SF)))
    words = b.table(spark, SF, "part").select(F.concat(F.lit("t_"), F.col("p_partkey").cast("string")).alias("needle"))
    sink("bulk_find_symbol", lambda: bulk.bulk_find_symbol(source.symbols, words, limit=50))
    links = b.links(spark, SF)
    targets = links.select(F.col("import_path").alias("target"))
    sink("bulk_dependents", lambda: bulk.bulk_dependents(links, targets, limit=None))
    sink("last_action", lambda: sessions.last_action(b.feed(spark, SF), "30 minutes"))
    sink("diff_files", lambda: maintain.diff_files(b.scan(spark, SF), docs.files))

    # Part of one source of twenty, about one percent of the files.
    changed = docs.files.filter((F.col("project") == "src3") & F.col("language").isin("php", "typescript")).select(
        "project",
        "path",
        F.lit("change").alias("action"),
        (F.col("last_modified") + F.expr("interval 1 day")).alias("ts"),
        F.lit(0).cast("bigint").alias("seq"),
        "content",
    )
    once("commit_one_percent", lambda: store.commit_changes(spark, documents, changed))
    read("search_code_after_commit", lambda: search.search_code(store.read_index(spark, documents), "for that this"))

    counts = {
        "documents": b.table(spark, SF, "documents").count(),
        "code_files": source.files.count(),
        "symbols": source.symbols.count(),
    }
    print(
        json.dumps(
            {
                "metric": "total of all headline timings",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF.rstrip("/").rsplit("sf", 1)[-1],
                "counts": counts,
                "warm_up": round(warm_up, 3),
                "documents_per_second": round(counts["documents"] / times["write_document_index"]),
                "code_files_per_second": round(counts["code_files"] / times["write_code_index"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
