import random
import zlib

import numpy as np

import corpus_pipeline
from lineloom.llm import line_windows, multi_index, pfair, simhash, toxicity


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[300:340] = x[20]
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)]
    odd = [(700, None, 1), (720, [0.0] * 8, 1), (740, [float("nan")] + [1.0] * 7, 1), (760, [float("inf")] * 8, 1), (780, [1.0, None] + [1.0] * 6, 1), (800, [1.0], 1), (None, x[0].tolist(), 1)]
    frame = spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in multi_index.neighbours(frame, centroids=8, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    exact = x.astype(np.float64)
    hits = 0
    assert set(got) == set(range(0, 600, 20))
    for q, found in got.items():
        scores = (exact * exact[q]).sum(axis=1)
        scores[q] = -np.inf
        want = np.lexsort((np.arange(600), -scores))[:20].tolist()
        hits += len(set(want) & {i for i, _ in found})
        assert len(found) == 20 and all(abs(scores[i] - s) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits >= 0.9 * 20 * len(got)
    few = multi_index.neighbours(frame.filter("vec_id < 4")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert multi_index.neighbours(frame.limit(0)).collect() == []


def test_cells_come_in_order_of_summed_scores():
    rng = np.random.default_rng(0)
    index = multi_index.Index(rng.normal(size=(5, 2)), rng.normal(size=(4, 2)), counts=np.ones(20, np.int64))
    query = rng.normal(size=4)
    sums = (index.first @ query[:2])[:, None] + (index.second @ query[2:])[None]
    assert index.probed(query, 20) == np.argsort(-sums.reshape(-1)).tolist()


def corpus(spark, n=400):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinrst") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = [rng.choice(words) for _ in range(60)]
        if toxic:
            text[rng.randrange(50)] = rng.choice(["zorrat", "zorrit", "idiot"])
        rows.append((i, " ".join(text[:20]) + "\n" + " ".join(text[20:40]) + "\n" + " ".join(text[40:]), "en", f"s{i % 4}", 9))
        labels.append((i, 1, int(toxic)))
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, kind), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    documents, labels = corpus(spark)
    out = {r.doc_id: r for r in toxicity.toxicity(documents, labels).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i].held_out == (i in set(held)) for i in out)
    assert all(out[i].predicted == int(i % 5 == 0) for i in held)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "idiot " * 20000)], "doc_id long, text string")
    scores = sorted(r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect())
    assert 0 <= scores[0] == scores[1] < 0.7 <= scores[2] <= 1
    assert toxicity.toxicity(documents.limit(0), labels).collect() == []


def test_label_model_counts_twins_once():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.4
    one = (rng.random(2000) < np.where(y, 0.7, 0.1)).astype(float)
    other = (rng.random(2000) < np.where(y, 0.7, 0.1)).astype(float)
    apart = toxicity.label_model(np.stack([one, other], 1), y, 0.4)
    twins = toxicity.label_model(np.stack([one, one], 1), y, 0.4)
    both = (one == 1) & (other == 1)
    assert twins[one == 1].mean() < apart[both].mean()


def test_pipeline_against_its_parts(spark, tmp_path):
    documents, labels = corpus(spark, 150)
    texts = {r.doc_id: r.text for r in documents.collect()}
    again = (1005, "a row that comes twice with words of its own")
    more = [again, again, (1000, texts[1]), (1001, texts[2] + " more"), (1002, "x\n" + texts[3] + "\ny"), (1003, None), (1004, "")]
    extra = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in more], documents.schema)
    every = documents.unionByName(extra)
    every.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    clean = {r.doc_id for r in toxicity.toxicity(every, labels).filter("predicted = 0").collect()}
    rest = every.filter(every.doc_id.isin(list(clean)))
    cut = line_windows.without_repeats(rest)
    groups = simhash.near_duplicates(cut)
    kept = {r.doc_id for r in groups.filter("doc_id = component_id").collect()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == kept and len(out) == len(kept)
    assert {i for i in kept if i < 150} == {i for i in clean if i < 150}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mix_sources", "bpe_encode"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    order = [r.doc_id for r in pfair.in_order(docs).collect()]
    placed = {r.doc_id: (r.slot, r.rank) for r in pfair.mixed(docs).collect()}
    assert order == sorted(order, key=placed.get)


def test_pipeline_rows_come_in_the_order_of_the_mix(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=rng.choice((9, 200)))), f"s{i % 3}") for i in range(240)]
    documents = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = corpus_pipeline.run(spark, str(tmp_path))
        got = [r.doc_id for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    mixed = corpus_pipeline.mix_sources(spark, documents.join(out.select("doc_id"), "doc_id", "left_semi"), str(tmp_path))
    assert len(got) > 200 and got == [r.doc_id for r in mixed.collect()]
    assert [r.position for r in out.collect()] == list(range(len(got)))


def test_one_row_of_each_group_of_copies_stays(spark):
    rng = random.Random(5)
    a, b, c = (" ".join("".join(rng.choices("aeinrst", k=5)) for _ in range(400)) for _ in range(3))
    near = a + " more"
    assert bin(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(near.encode())).count("1") <= 3
    rows = [(1, a), (5, a), (5, b), (6, a), (None, c), (None, c), (None, a), (7, "one of its own"), (1, near), (8, None), (8, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect()]
    first = min(a, near, key=lambda t: simhash.fingerprint(t.encode()) % (1 << 64))
    if simhash.fingerprint(a.encode()) == simhash.fingerprint(near.encode()):
        first = a
    assert sorted(got, key=str) == sorted([(1, first), (5, b), (None, c), (7, "one of its own"), (8, None)], key=str)


def test_toxicity_with_clashing_columns(spark):
    """Documents may have columns with any name; those of the operator, and of the labels, among them."""
    rows = [(i, ("you vile scum " if i % 2 else "a kind word ") * 3 + str(i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS _id", "'y' AS _toxic", "1 AS id", "2 AS toxic", "'z' AS score")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 60 and {r.predicted for r in got if r.doc_id % 2} == {1}
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id % 2 for r in kept.collect()} == {0}
