r"""Passages of benchmark items inside documents, by a prefix-filtered set join.

Every run of ``window`` item words (a whole item, if shorter) is looked for. A window is a set of placed shingles
of three words; it can only stand in a document that has all of them, so the rarest is a sufficient prefix:

1. Documents are cut into shingles where they are read; a bit filter of fixed size over the items' shingles
   keeps those that may matter. Only these leave the task, with their place.
2. Shingles are ordered by how often they stand in all documents; each window is looked up by its rarest.
3. A candidate's start follows from the shingle's place; it must lie inside the document (positional bound) with
   room for the window (length bound).
4. The words around are compared with the window, word by word.

DataFrame functions only: no Python runs in tasks.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.llm.places import SENT
from lineloom.llm.saved import saved
from lineloom.operators.hot import split_join

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
#: Bits of the filter that is sent to every task: half a megabyte. It decides what is kept for the join, never a result.
FILTER_BITS = 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words in order, A-Z in lower case; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct ``(item, passage, n)``: the windows of every item as text, and their number of words.

    Items without an id or without words have none. Rows of one id are one item.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    parts = F.transform(starts, lambda i: F.slice("w", i, window))
    found = items.filter("item IS NOT NULL AND size(w) > 0").select("item", F.explode(parts).alias("w"))
    return found.select("item", F.array_join("w", " ").alias("passage"), F.size("w").alias("n")).distinct()


def _shingles(passages: DataFrame) -> DataFrame:
    """``(passage, n, shingle, offset)`` for all shingles of distinct passages."""
    w = F.split("passage", " ")
    size = F.least("n", F.lit(SHINGLE))
    each = F.transform(
        F.sequence(F.lit(0), F.col("n") - size), lambda o: F.struct(F.array_join(F.slice(w, o + 1, size), " ").alias("shingle"), o.alias("offset"))
    )
    return passages.select("passage", "n", F.inline(each))


def _filter(shingles: DataFrame, bits: int) -> Column:
    """The bit filter of the shingles, as one value of ``bits`` bits: an array of longs."""
    bit = _bit(*[F.get(F.split("shingle", " "), F.lit(i)) for i in range(SHINGLE)], bits=bits)
    masks = shingles.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at"))
    masks = masks.agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("mask"))
    dense = shingles.sparkSession.range(bits >> 6).join(masks, F.col("id") == F.col("at"), "left")
    ordered = F.sort_array(F.collect_list(F.struct("id", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))))
    return dense.agg(ordered["mask"].alias("masks")).scalar()


def _bit(*shingle: Column, bits: int) -> Column:
    return F.xxhash64(*shingle).bitwiseAND(bits - 1)


def _marked(documents: DataFrame, masks: Column, sizes: list[int], bits: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, key, n_words, pos, a, b, c, hit)``: places whose shingle may be an item's, and the first place of each row.

    ``key`` stands for id and text, so that rows of one id stay apart; a row without words has no ``pos``.
    """
    text = F.col(text_col)
    key = F.md5(F.concat_ws("\u0001", F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")), F.coalesce(text, F.lit(""))))
    cut = documents.select(F.col(id_col).alias("id"), key.alias("key"), words(text).alias("w"))
    n = F.size("w")
    run = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, n).alias("b"), F.slice("w", 3, n).alias("c"))
    placed = cut.select("id", "key", n.cast("long").alias("n_words"), F.posexplode_outer(run).alias("pos", "shingle"))
    placed = placed.select("id", "key", "n_words", "pos", "shingle.*")
    hit = F.lit(False)
    for size in sizes:
        parts = [F.col(c) for c in "abc"[:size]]
        bit = _bit(*parts, bits=bits)
        at = F.get(masks, F.shiftright(bit, 6).cast("int"))
        hit |= parts[-1].isNotNull() & (F.getbit(at, bit.bitwiseAND(63).cast("int")) == 1)
    return placed.withColumn("hit", F.coalesce(hit, F.lit(False))).filter("hit OR pos IS NULL OR pos = 0")


def passages(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    filter_bits: int = FILTER_BITS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, places, items)``: every document row, every place of a window, and the windows' items.

    * rows ``(id, key, n_words)``, one per row of the documents; ``key`` stands for id and text
    * places ``(key, start, end, passage)``: words ``start`` to ``end`` (excluded), from 0, are the passage
    * items ``(item, passage, n)`` as of ``item_windows``
    """
    items = saved(item_windows(benchmark, window, item_col, text_col))
    shingles = saved(_shingles(items.select("passage", "n").distinct()))
    sizes = shingles.agg(F.sort_array(F.collect_set(F.least("n", F.lit(SHINGLE)))).alias("sizes"), F.min("n").alias("least")).first()
    masks = _filter(shingles.select("shingle").distinct(), filter_bits)
    marked = saved(_marked(documents, masks, sizes.sizes, filter_bits, id_col, text_col))
    rows = marked.filter("pos IS NULL OR pos = 0").select("id", "key", "n_words")
    # A document's shingles in a row, once however often it is repeated; fewer than the shortest window has are no match.
    least = max((sizes.least or 1) - SHINGLE + 1, 1)
    runs = marked.filter("hit").groupBy("key").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set(F.struct("pos", "a", "b", "c"))).alias("run"))
    runs = saved(runs.filter(F.size("run") >= least))

    def each(x: Column) -> Column:
        """The shingles that begin at a place, one of each size that windows have."""
        of = lambda size: F.when(x["abc"[size - 1]].isNotNull(), F.concat_ws(" ", *[x[c] for c in "abc"[:size]]))
        return F.array_compact(F.array(*map(of, sizes.sizes), F.lit(None).cast("string")))

    rarity = runs.select(F.explode("run").alias("x")).select(F.explode(each(F.col("x"))).alias("shingle")).groupBy("shingle").count()
    order = F.struct("count", "shingle", "offset")
    prefix = shingles.join(rarity, "shingle", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    # A window whose rarest shingle stands nowhere stands nowhere.
    prefix = prefix.groupBy("passage", "n").agg(F.min(order).alias("rarest")).filter("rarest.count > 0")
    prefix = saved(prefix.select("passage", "n", "rarest.shingle", "rarest.offset"))

    reach = window - SHINGLE if window > SHINGLE else 0
    around = F.transform(
        "run",
        lambda x, i: F.struct(x["pos"].alias("pos"), each(x).alias("shingles"), F.slice("run", F.greatest(i - reach + 1, F.lit(1)), 2 * reach + 1).alias("around")),
    )
    tokens = runs.select("key", "n_words", F.inline(around)).select("key", "n_words", "pos", "around", F.explode("shingles").alias("shingle"))
    if prefix.count() <= SENT:
        met = tokens.join(F.broadcast(prefix), "shingle")
    else:
        met = split_join(prefix, tokens, "shingle", F.struct("key", "pos"))
    start = F.col("pos") - F.col("offset")
    inside = met.withColumn("start", start).filter("start >= 0 AND start + n <= n_words")
    last = F.col("start") + F.col("n") - F.least("n", F.lit(SHINGLE))
    inside = inside.withColumn("run", F.filter("around", lambda x: x["pos"].between(F.col("start"), last)))
    tail = F.element_at("run", -1)
    whole = F.concat_ws(
        " ", F.transform("run", lambda x: x["a"]), F.when(F.col("n") > 1, tail["b"]), F.when(F.col("n") > 2, tail["c"])
    )
    full = F.size("run") == last - F.col("start") + 1
    places = inside.filter(full & (whole == F.col("passage"))).select("key", "start", (F.col("start") + F.col("n")).alias("end"), "passage")
    return rows, places, items


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, **columns: str) -> DataFrame:
    """``(id, n_words, n_hit, n_items, items_sha256, contaminated)`` for every document row.

    ``n_hit`` counts words inside any place of a window, ``n_items`` items with a window in the document. A null text has
    no words; items without id or words are ignored; rows of one item id are one item. Rows of one
    document id are told apart by their text, repeated rows stay repeated. Further columns of either table are
    ignored, whatever their names. Empty documents give no rows; an empty benchmark, clean documents. A very long text is one
    row's array of words while it is read.
    """
    id_col = columns.get("id_col", "doc_id")
    rows, places, items = passages(documents, benchmark, window, **columns)
    spans = F.sort_array(F.collect_set(F.struct("start", "end")))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reach")),
        lambda so_far, s: F.struct(
            (so_far["hit"] + F.greatest(s["end"] - F.greatest(s["start"], so_far["reach"]), F.lit(0))).cast("long").alias("hit"),
            F.greatest(so_far["reach"], s["end"]).cast("long").alias("reach"),
        ),
        lambda so_far: so_far["hit"],
    )
    found = saved(places.groupBy("key").agg(covered.alias("n_hit"), F.sort_array(F.collect_set("passage")).alias("passages")))
    # Copies have the same passages: their items are looked up once.
    sign = F.md5(F.array_join("passages", "\n"))
    found = found.withColumn("sign", sign)
    kinds = found.select("sign", "passages").dropDuplicates(["sign"]).select("sign", F.explode("passages").alias("passage"))
    listed = F.sort_array(F.collect_set("item"))
    kinds = kinds.join(items.select("passage", "item"), "passage").groupBy("sign").agg(listed.alias("ids"))
    kinds = kinds.select("sign", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    joined = rows.join(found.select("key", "sign", "n_hit").join(kinds, "sign"), "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: The same in DuckDB's SQL, by all windows of the documents of every size that items have.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[s:s + {WINDOW} - 1], ' ') AS passage
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0 AND item IS NOT NULL)),
v AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS passage FROM (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
p AS (SELECT r, v.n, s, item FROM v JOIN i ON v.passage = i.passage AND v.n = i.n),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM p) GROUP BY r),
l AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN l USING (r)
"""
