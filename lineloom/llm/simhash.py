"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has 64 bits. It is cut into ``BLOCKS`` runs of bits; fingerprints that differ in
at most ``RADIUS`` bits agree in at least ``BLOCKS - RADIUS`` of the runs, so every choice of that
many runs is a table, and only fingerprints with one key of one table are compared. Inside a
task the fingerprints of a key lie next to each other. Bit planes are stored vertically, one bit
of 64 fingerprints in one word; shifting the planes by ``d`` places lines up every fingerprint with
the one ``d`` places on, and carry-save counters add the differing bits of 64 pairs at a time. Words
in which every pair is beyond the radius are given up before all planes are read.
"""

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineloom.llm.components import components
from lineloom.llm.saved import saved

SEED = 42
SHINGLE = 3
RADIUS = 3
BLOCKS = 5
#: Fingerprints of one key in one piece; a fuller key is cut into pieces and all pairs of pieces are compared.
PIECE = 4096
#: Lanes handled at once in a task.
LANES = 1 << 17


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits as a signed number: bit set if set in over half of the shingles' hashes.

    ``text`` is UTF-8; A-Z are lower-cased, words end at ASCII white space, repeats count. A text
    of fewer than ``shingle`` words is one shingle, a null text or one without words gives 0.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
        ends = [*gaps[shingle - 1 :].tolist(), len(line)]
        hashes = list(map(xxhash.xxh64_intdigest, [line[s:e] for s, e in zip(starts, ends)], repeat(SEED)))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.array(hashes[at : at + 4096], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t) for t in texts.to_pylist()], pa.int64())


def hex_digits(column: Column) -> Column:
    """The sixteen lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def fingerprints(text: Column) -> Column:
    """The fingerprints of texts as ``near_duplicates`` returns them."""
    return hex_digits(_fingerprints(text.cast("binary")))


class _Planes:
    """Bit planes of fingerprints that lie group by group."""

    def __init__(self, values: np.ndarray, reach: np.ndarray):
        """reach: how many later lanes belong to the group of a lane."""
        words = -(-len(values) // 64)
        spare = int(reach.max(initial=0)) // 64 + 2
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows = np.zeros((64, (words + spare) * 8), np.uint8)
        packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        rows[:, : packed.shape[1]] = packed
        self.planes = rows.view(np.uint64)
        self.reach = np.zeros((words, 64), np.int64)
        self.reach.reshape(-1)[: len(values)] = reach
        self.furthest = self.reach.max(axis=1)

    def pairs(self, shift: int, radius: int) -> np.ndarray:
        """The lanes whose fingerprint is within the radius of the one ``shift`` places on in the same group."""
        at = np.flatnonzero(self.furthest >= shift)
        live = np.packbits(self.reach[at] >= shift, axis=1, bitorder="little").view(np.uint64)[:, 0]
        counters = np.zeros(((radius + 1).bit_length() - 1, len(at)), np.uint64)
        whole, rest = divmod(shift, 64)
        for first in range(0, 64, 8):
            planes = self.planes[first : first + 8]
            later = planes[:, at + whole]
            if rest:
                later = (later >> np.uint64(rest)) | (planes[:, at + whole + 1] << np.uint64(64 - rest))
            for carry in planes[:, at] ^ later:
                for counter in counters:
                    counter ^= carry
                    carry = carry & ~counter
                live &= ~carry
            kept = np.flatnonzero(live)
            if len(kept) < len(at):
                at, live, counters = at[kept], live[kept], np.ascontiguousarray(counters[:, kept])
            if not len(at):
                return np.empty(0, np.int64)
        lanes = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        word, bit = np.nonzero(lanes)
        return at[word] * 64 + bit


def local_links(values: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within the radius inside groups: ``(lane, earlier lane)``.

    ``values`` holds the groups one after another, ``sizes`` their sizes. Not every pair within the
    radius is returned, but pairs are connected by the result exactly if they are by all such pairs.
    ``radius`` is one less than a power of two.
    """
    if radius & (radius + 1) or not radius:
        raise ValueError("radius must be 1, 3, 7, ...")
    ends = np.repeat(np.cumsum(sizes), sizes)
    reach = ends - np.arange(len(values)) - 1
    planes, root = _Planes(values, reach), np.arange(len(values))
    for shift in range(1, int(reach.max(initial=0)) + 1):
        left = planes.pairs(shift, radius)
        right = left + shift
        while True:
            a, b = root[left], root[right]
            apart = a != b
            if not apart.any():
                break
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(root, further := root[root]):
                root = further
    lanes = np.flatnonzero(root != np.arange(len(root)))
    return lanes, root[lanes]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by ``(part, key, low, high)`` to links; the last group waits for the next batch."""
    held: list[tuple] = []

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        columns = [np.concatenate(c) for c in zip(*held)]
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)
        starts = np.flatnonzero(new)
        stop = len(new) if last else starts[-1]
        held = [tuple(c[stop:] for c in columns)]
        values = columns[4][:stop]
        sizes = np.diff(np.append(starts[starts < stop], stop))
        full = np.repeat(sizes > 1, sizes)
        values, sizes = values[full], sizes[sizes > 1]
        if len(values):
            lanes, earlier = local_links(values, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(values[lanes]), pa.array(values[earlier])], ["a", "b"])

    lanes = 0
    for batch in batches:
        if batch.num_rows:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)))
            lanes += batch.num_rows
        if lanes >= LANES:
            yield from flush(False)
            lanes = 0
    if held:
        yield from flush(True)


def _masks(radius: int, blocks: int) -> list[int]:
    """For each choice of runs that must agree, their bits as a signed mask."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    runs = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]
    masks = [sum(runs[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, piece: int = PIECE) -> DataFrame:
    """Links ``(a, b)`` that connect distinct fingerprints (column ``print``) within the radius.

    A key that more than ``piece`` fingerprints share is cut into pieces by hash, and each pair of
    pieces is a group of its own, so no task holds more than about two pieces of one key at once and
    no link is lost.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(radius, blocks)])
    keyed = prints.select("print", F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col("print")))).alias("part", "key"))
    full = keyed.groupBy("part", "key").count().filter(F.col("count") > piece)
    full = saved(full.select("part", "key", F.ceil(F.col("count") / piece).cast("int").alias("pieces")))
    own = F.pmod(F.xxhash64("print", "part"), F.col("pieces")).cast("int")
    rows = (
        keyed.join(full, ["part", "key"], "left")
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn(
            "other",
            F.explode(
                F.when(F.col("pieces").isNull(), F.array(F.lit(0))).otherwise(
                    F.array_remove(F.sequence(F.lit(0), F.col("pieces") - 1), F.col("own"))
                )
            ),
        )
        .select("part", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "print")
    )
    group = ["part", "key", "low", "high"]
    sorted_rows = rows.repartition(*group).sortWithinPartitions(*group, "print")
    return sorted_rows.mapInArrow(_linked, "a long, b long")


def near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    blocks: int = BLOCKS,
    group_col: str | None = None,
) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row of ``documents``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the
    smallest id reachable over links, the row's own id included. Null and empty texts have
    fingerprint 0 and are linked like any other. Repeated rows are returned as often as they come;
    rows of one id but different texts are linked by their texts only. A null id stands for no id:
    its row takes the smallest id of its component, or null if there is none. Other columns are
    ignored; an empty table gives an empty result. ``group_col`` names one more column, which tells apart
    components of one smallest id or of none.
    """
    rows = saved(
        documents.select(F.col(id_col).alias("id"), _fingerprints(F.col(text_col).cast("binary")).alias("print"))
    )
    prints = saved(rows.groupBy("print").agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    roots = components(links(prints.select("print"), radius, blocks))
    placed = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "first", "copies", F.coalesce("root", "print").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("first").alias("component"), F.sum("copies").alias("rows"))
    least = saved(least.filter("rows > 1"))
    # Fingerprints of one row only are their own component and need no second look.
    more = ["root"] if group_col else []
    groups = saved(placed.join(least.hint("merge"), "root").select("print", "component", *more))
    return rows.join(groups.hint("merge"), "print", "left").select(
        F.col("id").alias(id_col),
        hex_digits("print").alias("fingerprint"),
        F.coalesce("component", "id").alias("component_id"),
        *[F.coalesce(root, "print").alias(group_col) for root in more],
    )
