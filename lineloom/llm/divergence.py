r"""How the sources of a language differ in their words.

Terms that stand in enough documents of a language are kept. Sorted, they are built into minimal acyclic transducers, which
give each term its lexicographic ordinal; the texts are then streamed through them for the counts by language, source and
ordinal, so that no term is shuffled a second time. From the counts come smoothed shares in parts per thousand million, their
differences between sources, and each source's most typical terms; ordinals decide ties.

A transducer holds at most ``BLOCK_TERMS`` terms; a longer vocabulary has several, by ranges of its order. Tasks
get at most ``ROUND_BYTES`` of them at a time: what exceeds that is counted in a further pass over the texts.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineloom.llm.places import placed
from lineloom.llm.saved import saved
from lineloom.llm.transducer import Transducer

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS = 30
TOP = 50
BLOCK_TERMS = 100_000
ROUND_BYTES = 64 << 20
#: Sources and terms that are compared by one task at a time.
TILE, TILE_TERMS = 64, 512
#: Bytes of text that are streamed at once, and counts a task keeps before it hands them on.
STREAM_BYTES, HELD = 4 << 20, 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _named(documents: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    names = {"lang": lang_col, "source": source_col, "text": text_col}
    return documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in names.items()])


def vocabulary(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, term, ordinal, size)``: terms in at least ``min_docs`` documents of a language in their order."""
    low = lambda term: F.when(term.rlike("[A-Z]"), F.translate(term, UPPER, LOWER)).otherwise(term)
    # Lower-cased term by term: changing single letters of a whole text costs more than finding its terms.
    terms = F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))), low))
    found = rows.select("lang", F.explode(terms).alias("term")).groupBy("lang", "term").count()
    return placed(found.filter(F.col("count") >= min_docs).select("lang", "term"), "lang", ["term"], "ordinal")


def transducers(terms: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """One row per language and block of its order: the first term and ordinal, the last term, and the transducer."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("ordinal")
        words = [w.encode() for w in table.column("term").to_pylist()]
        parts = Transducer.of_sorted(words).to_bytes()
        row = [key[0].as_py(), table.column("ordinal")[0].as_py(), words[0], words[-1], *parts]
        return pa.Table.from_arrays([pa.array([v]) for v in row], ["lang", "first", "low", "high", *_PARTS])

    schema = "lang string, first long, low binary, high binary, " + ", ".join(f"{p} binary" for p in _PARTS)
    block = F.floor(F.col("ordinal") / block_terms).alias("block")
    return terms.select("lang", block, "term", "ordinal").groupBy("lang", "block").applyInArrow(build, schema)


_PARTS = ("keys", "targets", "adds", "finals")


def _head(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word as a number that sorts like them."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(8):
        has = lengths > i
        out[has] |= data[starts[has] + i].astype(np.uint64) << np.uint64(56 - 8 * i)
    return out


def _head_of(term: bytes) -> np.uint64:
    return np.uint64(int.from_bytes(term[:8].ljust(8, b"\0"), "big"))


class Counter:
    """Occurrences by language, source and ordinal, for the transducers of one round."""

    def __init__(self, blocks: list[tuple]):
        self.blocks: dict[str, list[tuple]] = {}
        for lang, first, low, high, *parts in blocks:
            self.blocks.setdefault(lang, []).append((first, _head_of(low), _head_of(high), Transducer.from_bytes(*parts)))

    def words(self, lang: str, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ordinals of words of a language, -1 for others: each word goes to the blocks whose range it may be in."""
        blocks = self.blocks.get(lang, [])
        out = np.full(len(starts), -1, np.int64)
        heads = _head(data, starts, lengths) if len(blocks) > 1 else None
        for first, low, high, transducer in blocks:
            mine = np.arange(len(starts)) if heads is None else np.flatnonzero((heads >= low) & (heads <= high))
            found = transducer.ordinals(data, starts[mine], lengths[mine])
            out[mine[found >= 0]] = found[found >= 0] + first
        return out

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        held: list[tuple] = []
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2)
            wide = pa.types.is_large_string(texts.type)
            ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            row = 0
            while row < len(texts):
                last = max(row + 1, int(np.searchsorted(ends, ends[row] + STREAM_BYTES, "right")) - 1)
                held += self.slice(raw[ends[row] : ends[last]], ends[row : last + 1] - ends[row], langs[row:last], sources[row:last], groups)
                row = last
                if sum(len(k) for k, _ in held) > HELD:
                    held = [_merged(held)]
                    if len(held[0][0]) > HELD:
                        yield _rows(held[0], groups)
                        held, groups = [], {}
        if held:
            yield _rows(_merged(held), groups)

    def slice(self, raw: np.ndarray, ends: np.ndarray, langs: list[str], sources: list[str], groups: dict[tuple, int]) -> list[tuple]:
        """``(group << 40 | ordinal, count)`` of a slice of texts."""
        if not len(raw):
            return []
        data, letter = _FOLD[raw], _LETTER[raw]
        opens = np.zeros(len(raw) + 1, bool)
        opens[ends] = True
        inner = letter[1:] & letter[:-1] & ~opens[1:-1]
        starts = np.flatnonzero(letter & ~np.concatenate(([False], inner)))
        lengths = np.flatnonzero(letter & ~np.concatenate((inner, [False]))) + 1 - starts
        text = np.searchsorted(ends, starts, "right") - 1
        of_text = np.array([groups.setdefault(g, len(groups)) for g in zip(langs, sources)], np.int64)
        lang_names = sorted(set(langs))
        lang_of = np.searchsorted(lang_names, langs) if len(lang_names) > 1 else np.zeros(len(langs), np.int64)
        out = []
        for i, lang in enumerate(lang_names):
            mine = np.flatnonzero(lang_of[text] == i) if len(lang_names) > 1 else np.arange(len(starts))
            for at in range(0, len(mine), 1 << 20):
                part = mine[at : at + (1 << 20)]
                found = self.words(lang, data, starts[part], lengths[part])
                kept = found >= 0
                out.append(np.unique(of_text[text[part[kept]]] << 40 | found[kept], return_counts=True))
        return out


def _merged(held: list[tuple]) -> tuple:
    keys, counts = (np.concatenate(parts) for parts in zip(*held))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _rows(merged: tuple, groups: dict[tuple, int]) -> pa.RecordBatch:
    keys, counts = merged
    names = list(groups)
    group = keys >> 40
    langs, sources = (pa.array([g[i] for g in names], pa.string()).take(pa.array(group)) for i in (0, 1))
    ordinals = keys & ((1 << 40) - 1)
    return pa.RecordBatch.from_arrays([langs, sources, pa.array(ordinals, pa.int64()), pa.array(counts, pa.int64())], ["lang", "source", "ordinal", "n"])


def recount(rows: DataFrame, blocks: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``(lang, source, ordinal, n)`` of all occurrences of the blocks' terms, by streaming the texts through them."""
    spark = rows.sparkSession
    size = sum((F.octet_length(p) for p in _PARTS), F.lit(0)).cast("long")
    listed = blocks.select("lang", "first", size.alias("bytes")).orderBy("lang", "first").collect()  # a row per 100,000 terms
    rounds: list[list] = []
    room = 0
    for block in listed:
        if block.bytes > room:
            rounds.append([])
            room = round_bytes
        rounds[-1].append((block.lang, block.first))
        room -= block.bytes
    schema = "lang string, source string, ordinal long, n long"
    counts = spark.createDataFrame([], schema)
    for chosen in rounds:
        lows = spark.createDataFrame(chosen, "lang string, first long")
        sent = spark.sparkContext.broadcast([tuple(r) for r in blocks.join(lows, ["lang", "first"], "left_semi").collect()])
        made = rows.mapInArrow(lambda batches, sent=sent: Counter(sent.value).run(batches), schema)
        counts = counts.unionByName(made)
    return counts.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def share(count: Column | str, total: Column | str, size: Column | str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 size)), exactly."""
    count, total, size = (F.col(c) if isinstance(c, str) else c for c in (count, total, size))
    wide = lambda c: c.cast("decimal(20,0)")
    over = wide(count + 5) * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", over, wide(total + 5 * size)) + 1


def _pairs(groups: DataFrame, counts: DataFrame, tile: int, tile_terms: int) -> DataFrame:
    """``(lang, source, item, value)`` for every two sources of a language: block by block of terms, tile by tile of sources.

    ``groups``: lang, source, i (number in the language), of (how many), size (of the vocabulary), p0 (share of a term that does not occur).
    ``counts``: lang, source, ordinal, p.
    """
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / tile_terms) - 1, F.lit(0)))
    base = groups.select("lang", "i", "of", "size", F.explode(blocks).alias("block"), F.lit(None).cast("long").alias("ordinal"), F.col("p0").alias("p"))
    block = F.floor(F.col("ordinal") / tile_terms).alias("block")
    some = counts.join(groups.select("lang", "source", "i", "of", "size"), ["lang", "source"]).select("lang", "i", "of", "size", block, "ordinal", "p")
    mine = F.floor(F.col("i") / tile)
    tiles = F.sequence(F.lit(0).cast("long"), F.floor((F.col("of") - 1) / tile))
    rows = base.unionByName(some).withColumn("other", F.explode(tiles))
    rows = rows.select("lang", "block", "size", "i", "ordinal", "p", F.least(mine, "other").alias("low"), F.greatest(mine, "other").alias("high"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        lang, block, low, high = (k.as_py() for k in key)
        i, p, size = (table.column(c).to_numpy() for c in ("i", "p", "size"))
        ordinal = table.column("ordinal").to_numpy(zero_copy_only=False)
        is_base = np.isnan(ordinal.astype(float)) if ordinal.dtype != np.int64 else np.zeros(len(ordinal), bool)
        width = max(min(tile_terms, int(size[0]) - block * tile_terms), 0)
        sources, row = np.unique(i, return_inverse=True)
        shares = np.zeros((len(sources), width), np.int64)
        shares[row[is_base]] = p[is_base][:, None]
        shares[row[~is_base], ordinal[~is_base].astype(np.int64) - block * tile_terms] = p[~is_base]
        a, b, value = [], [], []
        for s in np.flatnonzero(sources // tile == low):
            others = np.flatnonzero((sources // tile == high) & (sources > sources[s]))
            a.append(np.full(len(others), sources[s]))
            b.append(sources[others])
            value.append(np.abs(shares[others] - shares[s]).sum(axis=1))
        a, b, value = (np.concatenate(x).astype(np.int64) for x in (a, b, value))
        return pa.Table.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(value)], ["lang", "a", "b", "value"])

    sums = rows.groupBy("lang", "block", "low", "high").applyInArrow(compare, "lang string, a long, b long, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(*[F.struct(F.col(x).alias("i"), F.col(y).alias("j")) for x, y in (("a", "b"), ("b", "a"))])
    found = sums.select("lang", "value", F.inline(both))
    names = groups.select("lang", "i", "source")
    found = found.join(names, ["lang", "i"]).join(names.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"])
    return found.select("lang", "source", "item", "value")


def audit(
    documents: DataFrame,
    min_docs: int = MIN_DOCS,
    top: int = TOP,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    block_terms: int = BLOCK_TERMS,
    round_bytes: int = ROUND_BYTES,
    tile: int = TILE,
    tile_terms: int = TILE_TERMS,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: differences between the sources of a language, and typical terms.

    A null text, language or source is read as the empty text. Every occurring language and source is a group, also without any kept
    term; repeated rows count each time. Part ``pair`` has all other sources of the language, part ``term`` the first ``top``
    terms that are more frequent in the source than in the language. Ties go by the item's bytes: a term's ordinal, a
    source's name. Other columns are ignored, whatever their names. An empty table gives no rows. A very long text is
    streamed in pieces.
    """
    rows = _named(documents, text_col, lang_col, source_col)
    terms = saved(vocabulary(rows, min_docs))
    blocks = saved(transducers(terms, block_terms))
    counts = saved(recount(rows, blocks, round_bytes))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("size"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    in_lang = Window.partitionBy("lang")
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select(
        "lang",
        "source",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("size", F.lit(0)).alias("size"),
        (F.row_number().over(in_lang.orderBy("source")) - 1).cast("long").alias("i"),
        F.count("*").over(in_lang).alias("of"),
    )
    p0 = F.when(F.col("size") > 0, share(F.lit(0), "total", "size")).otherwise(0)
    groups = saved(groups.withColumn("p0", p0.cast("long")))

    shares = counts.join(groups.select("lang", "source", "total", "size"), ["lang", "source"])
    shares = saved(shares.select("lang", "source", "ordinal", "size", share("n", "total", "size").alias("p"), "n"))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    in_all = shares.groupBy("lang", "ordinal").agg(F.sum("n").alias("n"), F.first("size").alias("size"))
    in_all = in_all.join(whole, "lang").select("lang", "ordinal", share("n", "lang_total", "size").alias("q"))
    more = shares.select("lang", "source", "ordinal", "p").join(in_all, ["lang", "ordinal"]).filter("p > q")
    more = more.select("lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    typical = more.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    typical = typical.join(terms.select("lang", "ordinal", F.col("term").alias("item")), ["lang", "ordinal"])

    pairs = _pairs(groups, shares.select("lang", "source", "ordinal", "p"), tile, tile_terms)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(typical.withColumn("part", F.lit("term")).select(*columns))


#: The same in DuckDB's SQL.
SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM t),
o AS (SELECT r, lang, source, unnest(w) AS term FROM t),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM c),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term
  AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
WHERE part = 'pair' OR rank <= {TOP}
"""
