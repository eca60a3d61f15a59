"""Quality rules as a short-circuit cascade.

Base counts are taken for every text. The rules beyond the base verdict are tried one after another
and the first that rejects ends the work on a text. Their order comes from a bounded sample: the next
rule is the one with the most rejections, among what earlier ones leave, per unit of cost. A text is
kept exactly if no rule rejects it, so the order never changes the verdict.
"""

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
#: Rows of the sample that orders the rules: those with the least hash of their id. Of each, 20,000 bytes are timed.
SAMPLE = 400


class Text:
    """One text and the counts of the base; rules read from it."""

    def __init__(self, text: bytes | None):
        self.text = text or b""
        self.words = self.text.split()
        self.n_words = len(self.words)
        letters = np.frombuffer(b"".join(self.words), np.uint8)
        self.word_chars = int(np.count_nonzero(letters & 0xC0 != 0x80))
        self.n_symbols = len(self.text) - len(self.text.translate(None, SYMBOLS))
        self.lines = [line for line in self.text.split(b"\n") if line.strip(SPACES)]
        self.n_dup_lines = len(self.lines) - len(set(self.lines))
        self.n_repeat_words = self._repeated()
        self.base_failed = self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words

    def _repeated(self) -> int:
        """Words in windows of ``WINDOW`` words that come twice or more."""
        windows = self.n_words - WINDOW + 1
        if windows < 2:
            return 0
        hashes = np.fromiter(map(hash, self.words), np.int64, self.n_words).view(np.uint64)
        mixed = np.zeros(windows, np.uint64)
        for i in range(WINDOW):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + windows]
        order = np.argsort(mixed)
        same = mixed[order][1:] == mixed[order][:-1]
        likely = np.sort(order[np.append(same, False) | np.append(False, same)])
        seen: dict[tuple, list[int]] = {}
        for at in likely.tolist():
            seen.setdefault(tuple(self.words[at : at + WINDOW]), []).append(at)
        edge = np.zeros(self.n_words + 1, np.int64)
        for places in seen.values():
            if len(places) > 1:
                np.add.at(edge, places, 1)
                np.add.at(edge, np.array(places) + WINDOW, -1)
        return int(np.count_nonzero(np.cumsum(edge)))


#: Each rule says whether a text is rejected. Parts are compared as whole numbers, so that no rounding enters.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: 100 * t.n_symbols > 10 * t.word_chars,
    "long_words": lambda t: t.word_chars > 15 * t.n_words,
    "short_words": lambda t: t.word_chars < 2 * t.n_words,
    "dup_lines": lambda t: 100 * t.n_dup_lines > 50 * len(t.lines),
    "shouting": lambda t: 100 * sum(w.endswith(b"!!") for w in t.words) > 20 * t.n_words,
    "few_letters": lambda t: 100 * sum(w.isdigit() for w in t.words) > 50 * t.n_words,
    "first_word": lambda t: 100 * t.words.count(t.words[0]) > 50 * t.n_words,
}


def cascade(texts: list[bytes | None], rules: dict[str, Callable[[Text], bool]] = RULES) -> list[str]:
    """The order of the rules: at each step the most rejections, of what is left, per second spent."""
    left = [t for t in map(Text, texts) if not t.base_failed]
    rest, order = dict(rules), []
    cost, rejects = {}, {}
    for name, rule in rest.items():
        began = time.perf_counter()
        rejects[name] = {i for i, t in enumerate(left) if rule(t)}
        cost[name] = time.perf_counter() - began + 1e-9
    gone: set[int] = set()
    while rest:
        best = max(rest, key=lambda n: (len(rejects[n] - gone) / cost[n], -cost[n]))
        order.append(best)
        gone |= rejects[best]
        del rest[best]
    return order


def verdict(text: Text, order: list[str], rules: dict[str, Callable[[Text], bool]] = RULES) -> str | None:
    """The first rule of the order that rejects the text."""
    return next((name for name in order if rules[name](text)), None)


def quality(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` for every row.

    An empty table gives no rows; a very long text is one task's row and read whole. A null text has no words, so it fails the base rule. Repeated rows stay repeated, other
    columns are ignored. Only the order of the rules depends on the sample, never a result.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    # The ids of the sample are found first, so that no more texts than these come to the driver.
    ids = rows.filter("id IS NOT NULL").select("id").orderBy(F.xxhash64("id"), "id").limit(sample).distinct()
    some = rows.join(F.broadcast(ids), "id", "left_semi").select(F.expr("substring(text, 1, 20000)").alias("text"))
    order = cascade([bytes(r.text or b"") for r in some.limit(sample).collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Text(t) for t in batch.column(1).to_pylist()]
            counts = [[getattr(t, n) for t in texts] for n in names[:5]]
            failed = [t.base_failed for t in texts]
            kept = [not t.base_failed and verdict(t, order) is None for t in texts]
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", *names])

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{n} {'boolean' if i > 4 else 'long'}" for i, n in enumerate(names))
    return rows.mapInArrow(run, schema).withColumnsRenamed({"id": id_col})


#: The same in DuckDB's SQL.
SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id
), c AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, words, len(lines) AS n_lines
  FROM w LEFT JOIN cov USING (doc_id)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR word_chars > 15 * n_words OR word_chars < 2 * n_words
            OR 100 * n_dup_lines > 50 * n_lines
            OR 100 * len(list_filter(words, lambda x: x LIKE '%!!')) > 20 * n_words
            OR 100 * len(list_filter(words, lambda x: regexp_matches(x, '^[0-9]+$'))) > 50 * n_words
            OR 100 * len(list_filter(words, lambda x: x = words[1])) > 50 * n_words) AS kept
FROM b
"""
