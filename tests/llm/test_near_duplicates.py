import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lineloom.llm import simhash
from lineloom.llm.components import components


def plain_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def brute(rows):
    prints = [plain_print(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = grouped(near, range(len(rows)))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root[i]] = min(key, least.get(root[i], key))
    return sorted(((k, f"{p:016x}", least.get(root[i])) for i, ((k, _), p) in enumerate(zip(rows, prints))), key=str)


def test_documents_against_brute_force(spark):
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "ÉTÉ", "x y", "delta", "eps", "1"]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t.replace("gamma", "gamma zeta", 1)) for i, t in enumerate(base)]
    rows += [(50, None), (51, ""), (52, " \t\n"), (53, "one"), (54, "One"), (55, "two words"), (None, base[0]), (None, "lonely text here")]
    rows += [(3, base[3]), (3, base[3]), (60, "long " * 9000)]
    frame = spark.createDataFrame([(k, t, "z", 1) for k, t in rows], "doc_id long, text string, fingerprint string, component_id int")
    got = [tuple(r) for r in simhash.near_duplicates(frame).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(frame).collect() == []


def test_links_connect_all_within_the_radius_even_in_pieces(spark):
    rng = np.random.default_rng(3)
    values = set()
    for seed in rng.integers(0, 1 << 63, 40).tolist():
        for _ in range(6):
            seed ^= sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False))
            values.add(seed)
    values = sorted(values)
    pairs = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3]
    frame = spark.createDataFrame([(v,) for v in values], "print long")
    for piece in (4096, 3):
        found = [(r.a, r.b) for r in simhash.links(frame, piece=piece).collect()]
        assert grouped(found, values) == grouped(pairs, values)


def test_local_links_in_one_large_group():
    values = np.array([1 << b for b in range(60)] + [(1 << 40) - 1], np.uint64)
    lanes, earlier = simhash.local_links(values, np.array([61]))
    assert set(lanes.tolist()) == set(range(1, 60)) and set(earlier.tolist()) == {0}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    frame = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(frame.filter(F.col("a").isNotNull())).collect()}
    want = {n: r for n, r in grouped(edges, {n for e in edges for n in e}).items() if n != r}
    assert got == want
    assert components(frame.limit(0)).collect() == []
