"""BPE encoding by speculation and checking, and decoding.

New words of a batch are first cut greedily into the longest tokens. All adjacent pairs of all
these words are then checked at once. A word whose pairs all hold is encoded; only the others go
through exact merging. Words are remembered per worker, up to a bound.
"""

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.llm.bpe_model import BpeModel, model

#: Words remembered in a worker; beyond, the store starts anew. Longer words are not kept.
REMEMBERED = 300_000
KEPT = 40


def encode_words(bpe: BpeModel, words: list[bytes]) -> list[list[int]]:
    """The tokens of each word: greedy proposals, one check over all pairs, exact merging for what fails."""
    flat, counts = bpe.greedy(words)
    owner = np.repeat(np.arange(len(words)), counts)
    inner = owner[1:] == owner[:-1]
    left, right, first = flat[:-1][inner], flat[1:][inner], owner[:-1][inner]
    pairs, back = np.unique(left * bpe.size + right, return_inverse=True)
    holds = bpe.stable(pairs // bpe.size, pairs % bpe.size)[back]
    failed = np.unique(first[~holds]).tolist()
    tokens, ends = flat.tolist(), np.cumsum(counts).tolist()
    out = [tokens[end - count : end] for end, count in zip(ends, counts.tolist())]
    for word, ids in zip(failed, bpe.merged([words[i] for i in failed])):
        out[word] = ids
    return out


class Codec:
    """Encodes and decodes texts with one vocabulary, remembering words."""

    def __init__(self, path: str):
        self.bpe = model(path)
        self.known: dict[str, tuple[int, ...]] = {}
        lengths = [len(s) for s in self.bpe.spelled]
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(self.bpe.spelled), np.uint8)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null text is an empty one."""
        bpe, known = self.bpe, self.known
        if len(known) > REMEMBERED:
            known.clear()
        known |= {text: (token,) for text, token in bpe.special.items()}
        cut = [[w for part in bpe.segments(text) for w in bpe.words(part)] if text else [] for text in texts]
        new = list(set().union(*cut) - known.keys())
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            known.update(zip(part, map(tuple, encode_words(bpe, [w.encode() for w in part]))))
        ids = [np.fromiter(chain.from_iterable(map(known.__getitem__, words)), np.int64) for words in cut]
        for word in new:
            if len(word) > KEPT:
                del known[word]
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids spell, broken characters replaced, as UTF-8."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(int(lengths.sum())) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.letters[at].tobytes().decode("utf-8", "replace").encode()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def groups(texts: list[str | None], most: int = 4_000_000) -> Iterator[list[str | None]]:
    """Runs of texts of a few million characters, so that one batch of long texts stays small."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text or "")
        if size > most:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)`` for every row: the token ids of the whole text as an array.

    ``path`` is the tokenizer file, which must be there on every executor. A null text is encoded as
    an empty one; special strings inside texts become their tokens. Repeated rows stay repeated,
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            keys, at = batch.column(0), 0
            for texts in groups(batch.column(1).to_pylist()):
                ids = [i.astype(np.int32) for i in own.encode(texts)]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
                array = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(texts)), array], ["id", "ids"])
                at += len(texts)

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), F.col("ids").alias("ids"))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, ids, text)``: the text that the ids spell; null ids give a null text.

    Special tokens are written out; bytes that are no character become the replacement character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            column = batch.column(1)
            texts = [
                own.decode(column[i].values.to_numpy()).decode() if column[i].is_valid else None for i in range(len(column))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(texts, pa.string())], ["id", "ids", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, text string").withColumnsRenamed({"id": id_col})


def digests(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoded and decoded again, per row: ``n_tokens``, and the SHA-256 of the ids joined by commas and of the decoded text.

    As ``encode`` followed by ``decode``, in one pass that keeps only the digests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        names = np.array([str(i) for i in range(own.bpe.size)], object)
        for batch in batches:
            keys, at = batch.column(0), 0
            for texts in groups(batch.column(1).to_pylist()):
                counts, id_hashes, text_hashes = [], [], []
                for ids in own.encode(texts):
                    counts.append(len(ids))
                    id_hashes.append(hashlib.sha256(",".join(names[ids]).encode()).hexdigest())
                    text_hashes.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, len(texts)), pa.array(counts, pa.int64()), pa.array(id_hashes), pa.array(text_hashes)],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                at += len(texts)

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnsRenamed({"id": id_col})
