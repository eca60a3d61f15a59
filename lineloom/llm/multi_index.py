"""Nearest neighbours by inner product with an inverted multi-index.

Vectors are cut into two halves, each with its own codebook; a cell is a pair of centroids. A query
takes cells in the order of the summed scores of its halves, found with a heap, until the cells hold a
share of all entries; what they hold is scored exactly. The share is set on the fitting sample, as the
least that finds the wanted part of its true neighbours. Cells are packed into blocks of entries of
bounded size (a full cell fills several), and a query goes to the blocks of its cells.
"""

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lineloom.llm.saved import saved

#: Vectors the codebooks and the share are fitted on: those with the least hash of their id.
SAMPLE = 8_000
CENTROIDS = 32
#: Entries of a block and queries that meet it at once.
BLOCK, QUERIES = 8_192, 8_192
RECALL = 0.97


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of at most ``k`` clusters, begun at evenly spaced vectors of the sample."""
    centers = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, centers)
        for j in range(len(centers)):
            if (near == j).any():
                centers[j] = x[near == j].mean(axis=0)
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x @ centers.T - (centers**2).sum(axis=1) / 2).argmax(axis=1)


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


@dataclass
class Index:
    """Codebooks of the two halves, entries per cell, and the share of entries that a query looks at."""

    first: np.ndarray
    second: np.ndarray
    share: float = 1.0
    counts: np.ndarray | None = None

    def cells(self, x: np.ndarray) -> np.ndarray:
        cut = self.first.shape[1]
        return nearest(x[:, :cut], self.first) * len(self.second) + nearest(x[:, cut:], self.second)

    def probed(self, query: np.ndarray, most: float) -> list[int]:
        """Cells by summed score, until they hold ``most`` entries; empty ones are passed over."""
        cut = self.first.shape[1]
        a, b = self.first @ query[:cut], self.second @ query[cut:]
        p, q = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b, p, q = (-a[p]).tolist(), (-b[q]).tolist(), p.tolist(), q.tolist()
        counts, wide, out, held = self.counts, len(q), [], 0
        heap = [(a[0] + b[0], 0, 0)]
        while heap and held < most:
            _, i, j = heapq.heappop(heap)
            cell = p[i] * wide + q[j]
            if counts[cell]:
                out.append(cell)
                held += int(counts[cell])
            # (i, j) is reached from (i, j - 1), and the first of a row from the row before.
            if j + 1 < wide:
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(p):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return out


def fit(sample: np.ndarray, k: int, centroids: int = CENTROIDS, recall: float = RECALL) -> Index:
    """Codebooks, and the least share of entries that holds the wanted part of the sample's true neighbours."""
    cut = sample.shape[1] // 2
    index = Index(k_means(sample[:, :cut], centroids), k_means(sample[:, cut:], centroids))
    cells = index.cells(sample)
    index.counts = np.bincount(cells, minlength=len(index.first) * len(index.second))
    asked = np.linspace(0, len(sample) - 1, min(200, len(sample))).astype(int)
    needed: list[float] = []
    for i in asked.tolist():
        scores = sample @ sample[i]
        scores[i] = -np.inf
        order = index.probed(sample[i], np.inf)
        held = np.cumsum(index.counts[order]) - index.counts[order]
        place = {cell: h for cell, h in zip(order, held.tolist())}
        needed += [place[cells[t]] / len(sample) for t in np.argsort(-scores)[: min(k, len(sample) - 1)].tolist()]
    index.share = min(1.0, float(np.quantile(needed, recall)) + 0.01) if needed else 1.0
    return index


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector)``, one row per id: without null, zero, not finite vectors and those of another length than most.

    Of several vectors of one id the least is taken.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter("id IS NOT NULL AND size(vector) > 0")
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.filter(~bad & F.exists("vector", lambda v: v != 0))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    rows = rows.filter(F.size("vector") == (size.n if size else 0))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def neighbours(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    centroids: int = CENTROIDS,
    sample: int = SAMPLE,
    recall: float = RECALL,
) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` best by inner product of every row whose id is divisible by ``every``.

    A query is no candidate of its own. Scores are exact, in double precision; ties go to the smaller id.
    Vectors that are null, zero, or hold nulls or values that are not finite take no part, nor those of
    another length than most. Of candidates with one and the same vector only the first k + 1 ids can
    ever be returned; the rest are set aside before the search. With fewer candidates than ``k`` all are
    returned; an empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = saved(usable(vectors, id_col, vector_col))
    # The ids of the sample are found first, so that no more vectors than these come to the driver.
    chosen = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(sample)
    fitted = rows.join(F.broadcast(chosen), "id", "left_semi").orderBy(F.xxhash64("id"), "id").select("vector").toArrow()
    schema = "query_id long, rank int, id long, score double"
    if not fitted.num_rows:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    size = len(fitted.column(0)[0])
    index = fit(matrix(fitted.column(0), size), k, centroids, recall)

    def cells(column: pa.Array) -> pa.Array:
        return pa.array(index.cells(matrix(column, size)), pa.int64())

    same = Window.partitionBy("vector").orderBy("id")
    kept = rows.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1)
    entries = saved(kept.select("id", "vector", F.arrow_udf(cells, T.LongType())("vector").alias("cell")))
    index.counts = np.zeros(len(index.first) * len(index.second), np.int64)
    for row in entries.groupBy("cell").count().collect():  # at most centroids ** 2 rows
        index.counts[row.cell] = row["count"]
    most = max(index.share * index.counts.sum(), min(k + 1, index.counts.sum()))

    # Cells next to each other share a block until it is full; a cell beyond the size of a block has blocks of its own.
    first, pieces, block, filled = np.zeros(len(index.counts), np.int64), np.ones(len(index.counts), np.int64), 0, 0
    for cell, count in enumerate(index.counts.tolist()):
        if filled and filled + count > BLOCK:
            block, filled = block + 1, 0
        first[cell], pieces[cell] = block, max(1, -(-count // BLOCK))
        block, filled = (block + int(pieces[cell]), 0) if count > BLOCK else (block, filled + count)

    def place(cell: pa.Array, key: pa.Array) -> pa.Array:
        cell, key = cell.to_numpy(), key.to_numpy()
        return pa.array(first[cell] + np.abs(key) % pieces[cell], pa.int64())

    queries = rows.filter(F.col("id") % every == 0)
    parts = max(1, -(-queries.count() // QUERIES))
    entries = entries.select(
        "id", "vector", "cell", F.arrow_udf(place, T.LongType())("cell", F.xxhash64("id")).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
    )

    def probes(batches):
        for batch in batches:
            out = {n: [] for n in ("id", "row", "block", "probed")}
            for row, (key, vector) in enumerate(zip(batch.column(0).to_pylist(), matrix(batch.column(1), size))):
                by_block: dict[int, list[int]] = {}
                for cell in index.probed(vector, most):
                    for piece in range(int(pieces[cell])):
                        by_block.setdefault(int(first[cell]) + piece, []).append(cell)
                for where, wanted in by_block.items():
                    for name, value in zip(out, (key, row, where, wanted)):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["id"], pa.int64()), batch.column(1).take(pa.array(out["row"], pa.int64())),
                 pa.array(out["block"], pa.int64()), pa.array(out["probed"], pa.list_(pa.int64()))],
                ["id", "vector", "block", "probed"],
            )

    kind = rows.schema["vector"].dataType.simpleString()
    asked = queries.mapInArrow(probes, f"id long, vector {kind}, block long, probed array<long>")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return best(
            *(t.column("id").to_numpy() for t in (left, right)), *(matrix(t.column("vector"), size) for t in (left, right)),
            left.column("cell").to_numpy(), right.column("probed").to_pylist(), k,
        )

    found = entries.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(search, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def best(
    ids: np.ndarray, query_ids: np.ndarray, entries: np.ndarray, queries: np.ndarray, cells: np.ndarray, probed: list[list[int]], k: int
) -> pa.Table:
    """The ``k`` best entries of a block for each query, among the cells it probes."""
    order = np.argsort(cells, kind="stable")
    ids, entries, cells = ids[order], entries[order], cells[order]
    found, starts, sizes = np.unique(cells, return_index=True, return_counts=True)
    bounds = {c: (s, s + n) for c, s, n in zip(found.tolist(), starts.tolist(), sizes.tolist())}
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), 256):
        some, wanted = queries[at : at + 256], {}
        for i, own in enumerate(probed[at : at + 256]):
            for cell in own:
                wanted.setdefault(cell, []).append(i)
        scores = np.full((len(some), len(entries)), -np.inf)
        for cell, asking in wanted.items():
            if cell in bounds:
                low, high = bounds[cell]
                scores[asking, low:high] = some[asking] @ entries[low:high].T
        for i, row in enumerate(scores):
            row[ids == query_ids[at + i]] = -np.inf
            # All that rounding could bring among the k best are scored again, each in the same way.
            least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
            close = np.flatnonzero((row > -np.inf) & (row >= least - 1e-9 * max(1.0, abs(least) if np.isfinite(least) else 1.0)))
            exact = (entries[close] * some[i]).sum(axis=1)
            top = np.lexsort((ids[close], -exact))[:k]
            out.append((np.full(len(top), query_ids[at + i]), ids[close][top], exact[top]))
    columns = [np.concatenate(c) for c in zip(*out)]
    return pa.table(dict(zip(("query_id", "id", "score"), map(pa.array, columns))))
