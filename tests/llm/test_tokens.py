import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lineloom.llm import bpe_codec, token_prefix
from lineloom.llm.bpe_model import model

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [
    None, "", " ", "Hello there, world!", "the<|endoftext|> end <|startoftext|>x", "don't we'll you're 'll", "\n\n  x \t y ",
    "ÉTÉ été Σίσυφος ΑΣ İ ﬁ", "数字 ١٢٣ ½ ²", "a" * 3000, "͸ Ᲊ \U0001df00", "é   z\x1c\x1f", "aaaa" * 7 + " abab" * 9, "the the",
]


def noise(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("aabcdeinorst  '.,\n1Éß<|>") for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoding_equals_the_library(path):
    texts = TEXTS + noise(400, 2)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [i.tolist() for i in bpe_codec.codec(path).encode(texts)] == want
    assert token_prefix.counter(path).totals(texts) == [len(w) for w in want]


def test_exact_merging_two_ways_and_checked_pairs():
    bpe = model(BYTES)
    words = [w.encode() for w in ["undeneinte", "thhaer", "éçtre", " enpfüber", "x" * 70, "aaaaaaa"]]
    assert bpe.merged(words) == [bpe.exact(w) for w in words] == bpe_codec.encode_words(bpe, words)
    rng = np.random.default_rng(0)
    some = rng.integers(0, 50256, (3000, 2))
    alone = {t for t in range(50256) if bpe.plain.get(bpe.spelled[t]) == t}
    for a, b in [p for p in some.tolist() if set(p) <= alone][:800]:
        assert bpe.fits(a, b) == (bpe.exact(bpe.spelled[a] + bpe.spelled[b]) == [a, b])


def test_every_prefix_count():
    count, library = token_prefix.counter(WORDS), Tokenizer.from_file(WORDS)
    for text in ["Hello there, World's 12 'll x", " é!?'re", *noise(20, 9)]:
        plain = count.bpe.normalise(text)
        want = [len(library.encode(plain[:i], add_special_tokens=False).ids) for i in range(len(plain) + 1)]
        assert count.prefixes(text) == want


def test_frames(spark):
    rows = [(i % 11, t) for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame([(k, t, "n") for k, t in rows], "doc_id int, text string, n_tokens string")
    library = Tokenizer.from_file(BYTES)
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        spelled = library.decode(ids, skip_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((key, len(ids), sha(",".join(map(str, ids))), sha(spelled)))
    assert sorted(map(tuple, bpe_codec.digests(frame, BYTES).collect())) == sorted(want)
    back = bpe_codec.decode(bpe_codec.encode(frame, BYTES), BYTES).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((k, t or "") for k, t in rows)
    assert bpe_codec.digests(frame.limit(0), BYTES).collect() == []


def test_budgets(spark):
    frame = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    counted = token_prefix.token_counts(frame, WORDS, limit=2, prefixes=True)
    out = counted.select(
        "doc_id", "n_bytes", "n_tokens", "over_limit",
        token_prefix.tokens_at("prefix_tokens", 7).alias("at"), token_prefix.fitting_prefix("prefix_tokens", F.lit(2)).alias("fit"),
    )
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, 13, 3, True, 2, 8), (2, 0, 0, False, 0, 0)]
    assert token_prefix.token_counts(frame.limit(0), WORDS).collect() == []
