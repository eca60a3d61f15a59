"""Match forms on the text index. Each gives the distinct ``file_id`` that match.

Query terms are literals, so they reach the scan as pushed filters; with postings
written sorted by term that skips nearly all row groups. The shuffles are keyed by
file, never by term, so frequent terms do not make hot partitions.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineloom.functions.text import WORD, WORD_CHARACTER, normalized

CONTENT = ("content",)
ALL_FIELDS = ("content", "path")


def _hits(postings: DataFrame, terms: Sequence[str], fields: Sequence[str]) -> DataFrame:
    return postings.filter(F.col("field").isin(*fields) & F.col("term").isin(*terms))


def match_any(postings: DataFrame, terms: Sequence[str], fields: Sequence[str] = CONTENT) -> DataFrame:
    """Files with at least one of the terms."""
    return _hits(postings, terms, fields).select("file_id").distinct()


def match_all(postings: DataFrame, terms: Sequence[str], fields: Sequence[str] = CONTENT) -> DataFrame:
    """Files with every term, each in any of the fields; no terms match no file.

    One boolean per term is combined before the shuffle, so at most one row per
    file and task crosses the network.
    """
    terms = list(dict.fromkeys(terms))
    seen = [F.bool_or(F.col("term") == t).alias(f"t{i}") for i, t in enumerate(terms)]
    found = _hits(postings, terms, fields).groupBy("file_id").agg(*(seen or [F.lit(False).alias("t0")]))
    every = reduce(lambda a, b: a & b, [F.col(c) for c in found.columns[1:]])
    return found.filter(every).select("file_id")


def match_texts(
    files: DataFrame, terms: Sequence[str], fields: Sequence[str] = CONTENT, fold_accents: bool = True
) -> DataFrame:
    """``match_all`` on the texts of the files themselves, for an index whose postings are not stored.

    Only a text in which a term stands alone is cut into tokens, and no token becomes a row.
    """
    terms = list(dict.fromkeys(terms))

    def has(term: str):
        alone = rf"(?<!{WORD_CHARACTER}){term}(?!{WORD_CHARACTER})"
        # Nested, as what several conditions share is otherwise computed before any of them.
        token = lambda text: F.array_contains(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), term)
        found = [F.when(F.contains(text, F.lit(term)), F.when(text.rlike(alone), token(text))) for text in map(F.col, fields)]
        return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in found])

    texts = files.select("file_id", *[normalized(F.col(field), fold_accents).alias(field) for field in fields])
    seen = [F.bool_or(has(t)).alias(f"t{i}") for i, t in enumerate(terms)]
    found = texts.groupBy("file_id").agg(*(seen or [F.lit(False).alias("t0")]))
    every = reduce(lambda a, b: a & b, [F.col(c) for c in found.columns[1:]])
    return found.filter(every).select("file_id")


def match_not(
    postings: DataFrame,
    terms: Sequence[str],
    without: Sequence[str],
    fields: Sequence[str] = CONTENT,
) -> DataFrame:
    """Files with every one of ``terms`` and none of ``without``."""
    return match_all(postings, terms, fields).join(
        match_any(postings, without, fields), "file_id", "left_anti"
    )


def match_phrase(postings: DataFrame, phrase: Sequence[str], fields: Sequence[str] = CONTENT) -> DataFrame:
    """Files where the terms stand side by side in this order within one field.

    Every hit votes for the position where its phrase would start; a start with a vote
    from each offset is a match. That takes one shuffle and no self-join, also for
    phrases that repeat a term.
    """
    phrase = list(phrase)
    offsets = {}
    for i, term in enumerate(phrase):
        offsets.setdefault(term, []).append(i)
    table = F.create_map(
        *[x for t, at in offsets.items() for x in (F.lit(t), F.array(*[F.lit(i) for i in at]))]
    )
    votes = _hits(postings, list(offsets), fields).select(
        "file_id", "field", "pos", F.explode(F.element_at(table, F.col("term"))).alias("offset")
    )
    # Partitioned by file, both groupings below run without another exchange.
    return (
        votes.select("file_id", "field", (F.col("pos") - F.col("offset")).alias("start"))
        .repartition("file_id")
        .groupBy("file_id", "field", "start")
        .count()
        .filter(F.col("count") == len(phrase))
        .select("file_id")
        .distinct()
    )


def match_prefix(postings: DataFrame, prefix: str, fields: Sequence[str] = CONTENT) -> DataFrame:
    """Files with a term that starts with ``prefix``."""
    return (
        postings.filter(F.col("field").isin(*fields) & F.col("term").startswith(prefix))
        .select("file_id")
        .distinct()
    )


def match_near(
    postings: DataFrame, terms: Sequence[str], within: int = 10, fields: Sequence[str] = CONTENT
) -> DataFrame:
    """Files where all terms stand in one field with at most ``within`` tokens between
    the first and the last of them.

    Hits are walked in order of position; at each, the latest place of every term is
    known, which is enough to see the tightest group that ends there. Linear in the
    hits of a file, where a join of term pairs would be quadratic.
    """
    terms = list(dict.fromkeys(terms))
    walk = W.partitionBy("file_id", "field").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    latest = [F.last(F.when(F.col("term") == t, F.col("pos")), ignorenulls=True).over(walk) for t in terms]
    first = F.array_min(F.array(*latest))
    seen_all = reduce(lambda a, b: a & b, [c.isNotNull() for c in latest])
    return (
        _hits(postings, terms, fields)
        .select("file_id", F.when(seen_all, F.col("pos") - first - 1).alias("between"))
        .filter(F.col("between") <= within)
        .select("file_id")
        .distinct()
    )
