"""A manifest of a table as Merkle trees, one per source, and one tree over the sources' roots.

A row's leaf is the digest of its fields. Nodes are grouped by ``FANOUT``: the children of a parent are
spread into as many columns by conditional aggregates, the concatenated columns are hashed to the parent,
and the same columns without a child's own are its siblings. Levels are built upwards until each tree has one
node left; the siblings are then handed down, so that each leaf gets its whole path to the root. Only
digests and keys are shuffled, never texts.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.llm.places import counted_broadcast, placed
from lineloom.llm.saved import saved

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Hex SHA-256 of the parts in a row; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row's fields, each as ``bytes:value`` or ``-`` for null, so that no two rows are written alike."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _spread(nodes: DataFrame, carried: list[str], fanout: int) -> DataFrame:
    """One row per parent: its digest and its children as the columns ``c0``, ``c1``, ..."""
    child = f"struct({', '.join(['digest', *carried])})"
    wide = nodes.groupBy("tree", F.floor(F.col("place") / fanout).alias("place")).agg(
        F.max("size").alias("below"), *[F.expr(f"max(CASE WHEN place % {fanout} = {k} THEN {child} END) AS c{k}") for k in range(fanout)]
    )
    columns = [f"c{k}" for k in range(fanout)]
    parent = f"sha2(concat_ws('', {', '.join(f'{c}.digest' for c in columns)}), 256) AS digest"
    return wide.selectExpr("tree", "place", f"ceil(below / {fanout}) AS size", parent, *columns)


def _climb(nodes: DataFrame, carried: list[str], fanout: int) -> tuple[list[DataFrame], DataFrame | None]:
    """The spread levels from the leaves up, and ``(tree, height, digest)`` of the last node of each tree.

    ``nodes``: tree, place, size (of the tree at this level), digest and carried columns.
    """
    largest = nodes.agg(F.max("size")).first()[0]
    levels: list[DataFrame] = []
    tops = None
    while largest is not None:
        last = nodes.filter("size = 1").select("tree", F.lit(len(levels)).alias("height"), "digest")
        tops = last if tops is None else tops.unionByName(last)
        if largest == 1:
            break
        levels.append(saved(_spread(nodes.filter("size > 1"), [] if levels else carried, fanout)))
        nodes = levels[-1].select("tree", "place", "size", "digest")
        largest = -(-largest // fanout)
    return levels, None if tops is None else saved(tops)


def _slots(fanout: int) -> str:
    """Every child of a spread row with its place and the columns but its own, left and right."""
    own = [f"c{k}.digest" for k in range(fanout)]
    joined = lambda columns: f"concat_ws('', {', '.join(columns)})" if columns else "''"
    step = lambda k: f"struct({joined(own[:k])} AS left, {joined(own[k + 1:])} AS right)"
    return ", ".join(f"struct(place * {fanout} + {k} AS child_place, c{k} AS child, {step(k)} AS step)" for k in range(fanout))


def _descend(levels: list[DataFrame], over: DataFrame, carried: list[str], fanout: int) -> DataFrame:
    """``(tree, place, digest, carried, path, more of over)`` of every leaf below the levels.

    ``over`` has ``(tree, height, path, ...)`` of each tree's last node. A path is an array of
    ``(left, right)``: the siblings on either side, level by level upwards.
    """
    kept = [c for c in over.columns if c not in ("tree", "height", "path")]
    above = None
    for height in range(len(levels) - 1, -1, -1):
        last = over.filter(F.col("height") == height + 1).select("tree", F.lit(0).cast("long").alias("place"), "path", *kept)
        above = last if above is None else above.unionByName(last)
        found = levels[height].join(above, ["tree", "place"])
        found = found.selectExpr("tree", "path", *kept, f"inline(filter(array({_slots(fanout)}), x -> x.child IS NOT NULL))")
        above = found.select(
            "tree",
            F.col("child_place").alias("place"),
            *(["child.digest", *[f"child.{c}" for c in carried]] if height == 0 else []),
            F.concat(F.array("step"), F.col("path")).alias("path"),
            *kept,
        )
    return above


def manifest(
    documents: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    tree_col: str = "source",
    carried: dict[str, Column] | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """``(id, leaf, path, subroot, root)`` and the ``carried`` columns for every row.

    ``path`` lists the siblings ``(left, right)`` on the way up through the tree of the row's ``tree_col`` and the tree of
    the trees. Rows of a tree ascend by id (null first), rows of one id by leaf and then by the carried columns; a null
    tree is a tree of its own, before all others. Repeated rows are a leaf each. Other columns of the
    documents are ignored, whatever their names. An empty table gives no rows. A text is hashed
    where it is read, whatever its length. ``carried`` columns may use every column of the documents.
    """
    carried = carried or {}
    names = ["id", *[f"__carried_{i}" for i in range(len(carried))]]
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit(""))
    rows = documents.select(
        tree.alias("tree"),
        F.col(id_col).alias("id"),
        leaf_digest([F.col(f) for f in fields]).alias("digest"),
        *[c.alias(n) for n, c in zip(names[1:], carried.values())],
    )
    nodes = saved(placed(rows, "tree", ["id", "digest", *names[1:]]))
    levels, tops = _climb(nodes, names, fanout)
    if tops is None:
        nothing = F.array().cast("array<struct<left:string,right:string>>")
        found = nodes.select(*names, "digest", nothing.alias("path"), F.lit("").alias("subroot"), F.lit("").alias("root"))
    else:
        # The trees' last nodes are the leaves of one more tree.
        heads = tops.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "height", "digest")
        over_levels, root = _climb(saved(placed(heads, "tree", ["of"])), ["of", "height"], fanout)
        none = F.array().cast("array<struct<left:string,right:string>>")
        root = root.select("tree", "height", none.alias("path"), F.col("digest").alias("root"))
        if over_levels:
            over = _descend(over_levels, root, ["of", "height"], fanout)
        else:
            over = heads.join(root.drop("height"), "tree")
        over = saved(over.select(F.col("of").alias("tree"), "height", "path", F.col("digest").alias("subroot"), "root"))
        alone = nodes.filter("size = 1").join(counted_broadcast(over.drop("height")), "tree")
        found = alone.select(*names, "digest", "path", "subroot", "root")
        if levels:
            found = found.unionByName(_descend(levels, over, names, fanout).select(*names, "digest", "path", "subroot", "root"))
    return found.select(
        F.col("id").alias(id_col), F.col("digest").alias("leaf"), "path", "subroot", "root", *[F.col(n).alias(c) for n, c in zip(names[1:], carried)]
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def tampered_leaf(fields: Sequence[str] = FIELDS, id_col: str = "doc_id", text_col: str = "text", every: int = 5) -> Column:
    """The leaf after the text's A-Z are lower-cased where ``every`` divides the CRC-32 of the id, else null."""
    changed = [F.translate(text_col, UPPER, LOWER) if f == text_col else F.col(f) for f in fields]
    return F.when(F.crc32(F.col(id_col).cast("string")) % every == 0, leaf_digest(changed))


def audit(documents: DataFrame) -> DataFrame:
    """Every row's leaf, roots and proof, and whether it still leads to the root after the tampering."""
    rows = manifest(documents, carried={"tampered": tampered_leaf()})
    rows = rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 7, fanout: int = FANOUT) -> str:
    """The same in DuckDB's SQL, the levels written out one by one: up to ``fanout ** levels`` rows of a source, and sources."""
    field = lambda f: f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(f).replace("text", text) if f == "text" else field(f) for f in FIELDS) + ")"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    step = "[0, 1, 2, 3, 4, 5, 6, 7]"
    crc = f"""xor(4294967295::UBIGINT, list_reduce(
      list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), list_transform({step}, lambda i: i::UBIGINT)),
        lambda a, i: xor(a >> 1, (a & 1) * 3988292384::UBIGINT))))"""
    parts = [
        f"""f AS (SELECT *, coalesce('=' || source, '') AS tree, {leaf("text")} AS leaf, {crc} % 5 = 0 AS hit FROM documents),
a0 AS (SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
  count(*) OVER (PARTITION BY tree) AS size, leaf AS digest, CASE WHEN hit THEN {leaf(lower)} ELSE leaf END AS claimed FROM f)"""
    ]

    def tree(name: str) -> None:
        for i in range(levels):
            parts.append(
                f"""{name}{i + 1} AS (SELECT tree, place // {fanout} AS place, (any_value(size) + {fanout - 1}) // {fanout} AS size,
  sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM {name}{i} WHERE size > 1 GROUP BY tree, place // {fanout})"""
            )
            over = f"OVER (PARTITION BY tree, place // {fanout} ORDER BY place ROWS BETWEEN"
            parts.append(
                f"""{name}s{i} AS (SELECT tree, place, coalesce(string_agg(digest, '') {over} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(digest, '') {over} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{i} WHERE size > 1)"""
            )
        tops = " UNION ALL ".join(f"SELECT tree, digest FROM {name}{i} WHERE size = 1" for i in range(levels + 1))
        parts.append(f"{name}top AS ({tops})")

    def fold(name: str, start: str) -> None:
        parts.append(f"{name}f0 AS ({start})")
        for i in range(levels):
            parts.append(
                f"""{name}f{i + 1} AS (SELECT f.* REPLACE (f.place // {fanout} AS place, CASE WHEN s.l IS NULL THEN f.h ELSE sha256(s.l || f.h || s.r) END AS h,
  f.proof || coalesce(s.l || s.r, '') AS proof) FROM {name}f{i} f LEFT JOIN {name}s{i} s ON f.tree = s.tree AND f.place = s.place)"""
            )

    tree("a")
    parts.append("b0 AS (SELECT '' AS tree, tree AS of, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size, digest FROM atop)")
    tree("b")
    fold("a", "SELECT doc_id, tree, place, digest AS leaf, claimed AS h, '' AS proof FROM a0")
    start = f"SELECT doc_id, leaf, b0.digest AS subroot, '' AS tree, b0.place, h, proof FROM af{levels} AS x JOIN b0 ON x.tree = b0.of"
    fold("b", start)
    return f"""WITH {', '.join(parts)}
SELECT doc_id, leaf, subroot, btop.digest AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = btop.digest AS verified
FROM bf{levels}, btop"""


SQL = _sql()
