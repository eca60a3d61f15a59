"""Merkle manifest, decontamination and divergence audit, against SQL, brute force and edge cases."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from lineloom.llm import decontaminate, divergence, merkle
from lineloom.llm.transducer import Transducer

DOCS = "doc_id long, text string, lang string, source string, n_chars int, place int, digest string, `key` string, term string, item string"
EXTRA = (7, "x", "y", "z", "i")


def table(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*row, *EXTRA) for row in rows], DOCS)


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(f"_{name}", frame.toArrow())
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM _{name}")
    result = con.execute(sql)
    return [d[0] for d in result.description], sorted(result.fetchall(), key=str)


def same(frame, sql, **tables):
    columns, want = by_sql(sql, **tables)
    assert sorted(columns) == sorted(frame.columns)
    got = sorted([tuple(r) for r in frame.select(*columns).collect()], key=str)
    assert got == want and want
    return got


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Root and the siblings of every leaf, by plain recursion over lists."""
    paths = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for at in range(0, len(nodes), merkle.FANOUT):
            run = nodes[at : at + merkle.FANOUT]
            for k in range(len(run)):
                for leaf in owners[at + k]:
                    paths[leaf].append((run[:k], run[k + 1 :]))
            above.append(h(*run))
            held.append([leaf for group in owners[at : at + len(run)] for leaf in group])
        nodes, owners = above, held
    return nodes[0], paths


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return h(*map(field, (row[0], row[3], row[2], row[4], text)))


def test_manifest_by_hand(spark):
    rng = random.Random(5)
    rows = [(i, f"Text {i} Ä " * rng.randrange(3), "en", f"s{0 if i % 3 else i % 40}", i) for i in range(700)]
    rows += [(1000, None, None, None, None), (1001, "", "", "", 0), (1002, "Alone", "fr", "~last", 5), (-3, "A" * 100_000, "de", "s0", 1)]
    rng.shuffle(rows)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, want = {}, {}
    for s in sources:
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: r[0])
        trees[s] = (mine, *tree([leaf(r, r[1]) for r in mine]))
    root, over = tree([trees[s][1] for s in sources])
    for s, up in zip(sources, over):
        mine, subroot, paths = trees[s]
        for row, path in zip(mine, paths):
            hit = row[1] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            text = "".join(c.lower() if c.isascii() else c for c in row[1]) if hit else row[1]
            node = leaf(row, text)
            for left, right in path + up:
                node = h(*left, node, *right)
            proof = h(*[d for left, right in path + up for d in left + right])
            want[row[0]] = (leaf(row, row[1]), subroot, root, proof, node, node == root)
    got = merkle.audit(table(spark, rows))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert {v[-1] for v in want.values()} == {True, False}
    same(got, merkle.SQL, documents=table(spark, rows))


def test_manifest_edges(spark):
    assert merkle.audit(table(spark, [])).collect() == []
    only = merkle.audit(table(spark, [(1, "a", "en", "s", 1)])).collect()
    assert len(only) == 1 and only[0].leaf == only[0].subroot == only[0].root and only[0].proof_sha256 == h()
    repeated = [(1, "a", "en", "s", 1)] * 20 + [(None, "b", "en", "s", 1), (1, "c", "en", "s", 1)]
    got = merkle.audit(table(spark, repeated)).collect()
    assert len(got) == 22 and len({r.root for r in got}) == 1 and {r.folded_root == r.root for r in got} == {r.verified for r in got}
    # Another fanout, and columns of the caller's own.
    rows = [(i, f"t{i}", "en", f"s{i % 3}", i) for i in range(50)]
    own = merkle.manifest(table(spark, rows), ["doc_id", "text"], carried={"path_of": merkle.F.col("text")}, fanout=3)
    own = own.withColumn("to", merkle.folded(merkle.F.col("leaf"), merkle.F.col("path"))).collect()
    assert len(own) == 50 and all(r.to == r.root and r.path_of == f"t{r.doc_id}" for r in own)


ITEM = "one two three four five six seven eight nine ten eleven twelve"


def plain_words(text):
    low = (text or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER))
    return re.findall(decontaminate.WORD, low)


def brute(text, items):
    """Hit words and items of a text, by comparing lists."""
    words = plain_words(text)
    hit, found = set(), set()
    for name, item in items:
        n = min(len(item), decontaminate.WINDOW)
        for at in range(len(item) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i] == item[at] and words[i : i + n] == item[at : at + n]:
                    hit |= set(range(i, i + n))
                    found.add(name)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def contamination_cases():
    rng = random.Random(2)
    word = lambda: rng.choice("ab cd ef gh ij kl".split())
    texts = [
        None, "", " .,;", ITEM, ITEM.upper().replace(" ", "--"), "x " + " ".join(ITEM.split()[1:11]) + " y", " ".join(ITEM.split()[:9]),
        " ".join(ITEM.split()[:5] + ["gap"] + ITEM.split()[5:]), f"{ITEM} {ITEM}", "short item", "a short item and a short item", "solo", "no solos",
        "Straße über die Brücke", " ".join(ITEM.split()[:10]) + " " + " ".join(ITEM.split()[2:]), "repeat repeat repeat repeat " * 4,
        "word " * 1_500 + ITEM, ITEM, ITEM,
    ]
    texts += [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(60)]
    items = [(1, ITEM), (2, "A short ITEM"), (3, "solo"), (4, "straße über"), (5, None), (6, " ? "), (7, "repeat " * 12), (None, "gap"), (10, ITEM)]
    items += [(20 + i, " ".join(word() for _ in range(rng.randrange(1, 25)))) for i in range(12)] + [(1, "seven eight nine")]
    return texts, items


def test_contamination_by_hand(spark):
    texts, items = contamination_cases()
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(*i, "x", "y") for i in items], "item_id long, text string, `key` string, passage string")
    listed = [(str(i), plain_words(t)) for i, t in items if i is not None]
    want = {i: brute(t, listed) for i, t in enumerate(texts)}
    got = decontaminate.report(docs, bench)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    same(got, decontaminate.SQL, documents=docs, benchmark=bench)
    # A filter of few bits lets more through to the join and changes no result.
    assert {r.doc_id: tuple(r)[1:] for r in decontaminate.report(docs, bench, filter_bits=64).collect()} == want


def test_contamination_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SENT", 0)
    texts, items = contamination_cases()
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    same(decontaminate.report(docs, bench), decontaminate.SQL, documents=docs, benchmark=bench)


def test_contamination_edges(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = table(spark, [(1, ITEM, "en", "s", 1), (1, "clean", "en", "s", 1), (1, ITEM, "en", "s", 1), (None, ITEM, "en", "s", 1), (None, None, "en", "s", 1)])
    got = sorted((str(r.doc_id), r.n_hit) for r in decontaminate.report(docs, bench).collect())
    assert got == [("1", 0), ("1", 12), ("1", 12), ("None", 0), ("None", 12)]
    assert decontaminate.report(docs.limit(0), bench).collect() == []
    clean = decontaminate.report(docs, bench.limit(0)).collect()
    assert len(clean) == 5 and not any(r.contaminated or r.n_hit or r.n_items for r in clean)
    plan = decontaminate.report(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_transducer_is_minimal_and_gives_ordinals():
    rng = random.Random(1)
    terms = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))).encode() for _ in range(800)})
    made = Transducer.of_sorted(terms)
    other = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 8))).encode() for _ in range(500)})
    words = terms + other + [b"\xff", b"a" * 50]
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    found = Transducer.from_bytes(*made.to_bytes()).ordinals(data, np.cumsum(lengths) - lengths, lengths)
    place = {t: i for i, t in enumerate(terms)}
    assert found.tolist() == [place.get(w, -1) for w in words]
    # As many states as there are different sets of what may still follow.
    prefixes = {t[:i] for t in terms for i in range(len(t) + 1)}
    assert len(made.finals) == len({frozenset(t[len(p) :] for t in terms if t.startswith(p)) for p in prefixes})
    assert Transducer.of_sorted([]).ordinals(data, np.cumsum(lengths) - lengths, lengths).max() == -1


def divergence_rows():
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("Alpha", "beta", "gaßmma", "é", "longerwordthaneight") for b in "abcdefgh"]
    rows = []
    for i in range(500):
        lang = ("en", "fr", None)[i % 3]
        source = f"s{i % 3 if i % 2 else i % 7}"
        text = " ".join(rng.choice(words[: 10 + i % 7 * 5]) for _ in range(rng.randrange(40)))
        rows.append((i, text.replace(" ", rng.choice([" ", "-1,", "\n"])), lang, source, 1))
    rows += [(900, None, "xx", "s1", 1), (901, "", "xx", None, 1), (902, "seldom", "fr", "silent", 1), (903, "betaa " * 3_000, "en", "s1", 1), (904, "x", "solo", "s", 1)]
    return rows + [(7, "betaa betab", "en", "s1", 1)] * 3


@pytest.mark.parametrize("options", [{}, {"block_terms": 7, "round_bytes": 500, "tile": 2, "tile_terms": 3}])
def test_divergence_equals_sql(spark, options):
    docs = table(spark, divergence_rows())
    got = same(divergence.audit(docs, **options), divergence.SQL, documents=docs)
    assert {("pair",), ("term",)} <= {(r[2],) for r in got}


def test_divergence_streams_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "STREAM_BYTES", 50)
    monkeypatch.setattr(divergence, "HELD", 3)
    rows = divergence._named(table(spark, divergence_rows()), "text", "lang", "source")
    terms = divergence.vocabulary(rows)
    blocks = divergence.transducers(terms).collect()
    texts = rows.toArrow().to_batches()
    counter = divergence.Counter([tuple(b) for b in blocks])
    sums: dict = {}
    for batch in counter.run(iter(texts)):
        for lang, source, ordinal, n in zip(*[c.to_pylist() for c in batch.columns]):
            sums[lang, source, ordinal] = sums.get((lang, source, ordinal), 0) + n
    whole = {(r.lang, r.source, r.ordinal): r.n for r in divergence.recount(rows, divergence.transducers(terms)).collect()}
    assert sums == whole and whole


def test_divergence_edges(spark):
    assert divergence.audit(table(spark, [])).collect() == []
    few = divergence.audit(table(spark, [(1, "a", "en", "s", 1), (2, None, "en", "t", 1), (3, "b", "fr", None, 1)])).collect()
    assert sorted(map(tuple, few)) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    # Counts whose product with 10^9 no longer fits a long.
    frame = spark.sql("SELECT 4000000000000000000L AS n, 9000000000000000000L AS total, 11L AS size")
    share = frame.select(divergence.share("n", "total", "size")).first()[0]
    assert share == 1 + 10**9 * (4 * 10**18 + 5) // (9 * 10**18 + 55)
