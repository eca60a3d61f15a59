"""Exact token counts of every prefix, by dynamic programming over prefixes.

The encoding of a prefix of a word is the encoding of a shorter prefix and one more token that may
stand after it; exactly one choice is valid. So one pass over a word gives the last token and the
count of each of its prefixes, and a text's counts follow by adding up its words. Questions about
truncation and budgets are answered from the stored counts, without encoding again.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.llm.bpe_codec import groups
from lineloom.llm.bpe_model import BpeModel, model

#: Words remembered in a worker; beyond, the store starts anew. Longer words are not kept.
REMEMBERED = 300_000
KEPT = 40


def prefix_counts(bpe: BpeModel, word: bytes) -> list[int]:
    """Tokens of ``word[:i]`` for i = 0 .. len(word), each prefix taken as a whole word.

    For i inside a character the count is that of the bytes so far.
    """
    count, reach, plain, fits = len(word), bpe.longest, bpe.plain, bpe.fits
    last, open_counts, counts = [-1] * (count + 1), [0] * (count + 1), [0] * (count + 1)
    for stop in range(1, count + 1):
        for start in range(max(0, stop - reach), stop):
            token = plain.get(word[start:stop])
            if token is not None and (start == 0 or fits(last[start], token)):
                last[stop], open_counts[stop] = token, open_counts[start] + 1
                break
        if bpe.end:
            ended = bpe.ended
            for start in range(max(0, stop - reach), stop):
                token = ended.get(word[start:stop])
                if token is not None and (start == 0 or fits(last[start], token)):
                    counts[stop] = open_counts[start] + 1
                    break
    return counts if bpe.end else open_counts


class Counter:
    """Counts with one vocabulary. Words' counts are remembered, up to a bound."""

    def __init__(self, path: str):
        self.bpe = model(path)
        self.known: dict[str, int] = {}

    def totals(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text; a null text has none."""
        bpe, known = self.bpe, self.known
        if len(known) > REMEMBERED:
            known.clear()
        known |= dict.fromkeys(bpe.special, 1)
        cut = [[w for part in bpe.segments(text) for w in bpe.words(part)] if text else [] for text in texts]
        new = list(set().union(*cut) - known.keys())
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            counts, wholes = bpe.open_counts([w.encode() for w in part])
            known.update(zip(part, counts[wholes].tolist()))
        out = [sum(map(known.__getitem__, words)) for words in cut]
        for word in new:
            if len(word) > KEPT:
                del known[word]
        return out

    def total(self, text: str | None) -> int:
        return self.totals([text])[0]

    def prefixes(self, text: str | None) -> list[int]:
        """Tokens of each prefix, by characters of the normalised text, the empty one first.

        Where a prefix ends inside a word that is split otherwise when cut ('re), or a special
        string, the prefix's own split counts.
        """
        bpe, out = self.bpe, [0]
        for part in bpe.segments(text) if text else ():
            before = out[-1]
            if part in bpe.special:
                out += [before + self.total(part[:i]) for i in range(1, len(part))] + [before + 1]
                continue
            plain, at = bpe.normalise(part), 0
            for word in bpe.words(part):
                start = plain.index(word, at)
                out += [before] * (start - at)
                whole = word.encode()
                counts, ends = prefix_counts(bpe, whole), np.cumsum([len(c.encode()) for c in word])
                if word[0] == "'" and len(word) > 1 and word[1].isalpha():
                    out += [before + self.total(word[: i + 1]) for i in range(len(word))]
                else:
                    out += [before + counts[e] for e in ends]
                before, at = out[-1], start + len(word)
            out += [before] * (len(plain) - at)
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(
    documents: DataFrame, path: str, limit: int = 2048, prefixes: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for every row, and ``prefix_tokens`` if asked for.

    An empty table gives no rows; a very long text is one task's row and counted whole.
    ``prefix_tokens[i]`` is the exact count of the first i characters of the normalised text. A null
    text counts as empty. Repeated rows stay repeated; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            arrays = [batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64())]
            if prefixes:
                kept = [own.prefixes(t) for t in texts]
                arrays += [pa.array([k[-1] for k in kept], pa.int64()), pa.array(kept, pa.list_(pa.int32()))]
            else:
                arrays.append(pa.array([n for group in groups(texts) for n in own.totals(group)], pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_bytes", "n_tokens", "prefix_tokens"][: len(arrays)])

    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_tokens long" + ", prefix_tokens array<int>" * prefixes
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return rows.withColumn("over_limit", F.col("n_tokens") > limit).withColumnsRenamed({"id": id_col})


def tokens_at(prefix_tokens: Column | str, characters: Column | int) -> Column:
    """The count of the first ``characters`` characters; of the whole text beyond its end."""
    column = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    characters = characters if isinstance(characters, Column) else F.lit(characters)
    return F.element_at(column, F.least(characters, F.size(column) - 1) + 1)


def fitting_prefix(prefix_tokens: Column | str, budget: Column | int) -> Column:
    """The most characters whose tokens stay within the budget."""
    column = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    return F.array_max(F.transform(column, lambda count, i: F.when(count <= budget, i)))
