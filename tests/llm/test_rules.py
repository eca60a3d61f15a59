import re

import duckdb
import pytest

from lineloom.llm import chat, license_templates, line_windows, pfair, quality

TEXTS = [
    None, "", "   ", "\n\n\n", "one", "Licensed under the Apache License, Version 2.0.", "cc by cc by CC-BY-NC 4.0\nLicensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.", "gnu general public", "Released under the MIT License. All rights reserved",
    "a b c d e f g h " * 5, "x y z\nx y z\nq\nx y z\n\n", " ".join(map(str, range(40))), " ".join(f"w{i}###" for i in range(30)),
    "HEY!! YOU!! " * 20, "é ü ß " + " ".join(f"wort{i}" for i in range(30)), "v\x0bw\x0cx\ry", "l1\nl2\nl3\nl4", "q\nl1\nl2\nl3\nl4\nz", "l1\nl2\nl3",
    "s\ns\ns\ns\ns\ns", "word " * 30000,
]


def documents(spark, texts=TEXTS):
    rows = [(i, t, f"src{i % 3}", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, labels string")


def by_sql(frame, sql, name="documents"):
    con = duckdb.connect()
    con.register("t", frame.toArrow())
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM t")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return columns, sorted(result.fetchall(), key=str)


@pytest.mark.parametrize(
    "operator, sql",
    [(license_templates.scan, license_templates.sql()), (quality.quality, quality.SQL), (line_windows.line_report, line_windows.SQL)],
)
def test_equal_to_sql(spark, operator, sql):
    frame = documents(spark)
    columns, want = by_sql(frame, sql)
    assert sorted([tuple(r) for r in operator(frame).select(*columns).collect()], key=str) == want
    assert operator(frame.limit(0)).collect() == []


def test_null_ids_and_repeats(spark):
    frame = spark.createDataFrame([(None, "l1\nl2\nl3"), (1, "l1\nl2\nl3"), (1, "l1\nl2\nl3"), (2, "l1\nl2\nl3\nl9")], "doc_id long, text string")
    kept = sorted(map(str, [r.text for r in line_windows.without_repeats(frame).collect()]))
    assert kept == sorted(["l1\nl2\nl3"] * 3 + ["l9"])
    assert license_templates.scan(frame).count() == quality.quality(frame).count() == 4


def test_passages_within_lines(spark):
    passage = "One is here. Two comes next! Is three last?"
    texts = [f"Own. {passage} Tail a.", f"Other. {passage} Tail b.\nend", "Start. One is here. Two comes next!\nIs three last? Stop", "no marks\nhere"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_windows.without_repeats(frame, sentences=True).collect()}
    assert got == {0: texts[0], 1: "Other. Tail b.\nend", 2: "Start.\nStop", 3: texts[3]}
    assert sorted(r.text for r in line_windows.without_repeats(frame).collect()) == sorted(texts)
    from corpus_pipeline import drop_repeated_lines

    staged = drop_repeated_lines(spark, frame.selectExpr("*", "0L AS n_chars"), "").collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in staged} == {i: (t, len(t)) for i, t in got.items()}


def test_optional_and_replaceable_regions():
    own = license_templates.Automaton({"t": "a [b [c]] d {2} e"})
    found = lambda text: [m[:2] for m in own.matches([w.encode() for w in text.split()])]
    assert found("a d e") == [(0, 3)] and found("x a b d z e") == [(1, 6)] and found("a b c d y z e") == [(0, 7)]
    assert found("a c d e") == [] and found("a d x y z e") == [] and found("a b d") == []


def test_cascade_order_never_changes_the_verdict():
    texts = [quality.Text(t.encode()) for t in TEXTS if t]
    names = list(quality.RULES)
    for text in texts:
        if not text.base_failed:
            assert (quality.verdict(text, names) is None) == (quality.verdict(text, names[::-1]) is None)
    assert sorted(quality.cascade([t.encode() for t in TEXTS if t])) == sorted(names)


def test_mix_equals_sql(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 7}") for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "'x' AS slot")
    columns, want = by_sql(frame.drop("slot"), pfair.SQL)
    placed = pfair.mixed(frame)
    assert sorted([tuple(r) for r in placed.select(*columns).collect()], key=str) == want
    assert pfair.in_order(frame).columns == frame.columns and pfair.in_order(frame).count() == 1500
    assert pfair.mixed(frame.limit(0)).collect() == []


def test_mix_stays_within_a_block_of_the_shares():
    parts = pfair.shares({"a": 5, "b": 3.3, "c": 1, "d": 0.01}, 100)
    slots = pfair.schedule(parts)
    assert sorted(s for own in slots.values() for s in own) == list(range(100)) and sum(parts.values()) == 100
    for source, own in slots.items():
        for t in range(101):
            assert abs(sum(s < t for s in own) - t * parts[source] / 100) < 1


def test_mix_of_null_sources_ids_and_weights(spark):
    frame = spark.createDataFrame([(None, None), (1, None), (1, "a"), (2, "a"), (2, "a"), (3, "b")], "doc_id long, source string")
    out = pfair.mixed(frame, weights={"a": 2.0, None: 1.0}, block=1, period=5).collect()
    assert len(out) == 6 and len({r.slot for r in out}) == 6
    assert {r.source: r.share for r in out} == {"a": 2, None: 2, "b": 1}
    with pytest.raises(ValueError):
        pfair.mixed(frame, period=2)


@pytest.mark.parametrize("weights", [{"a": 90, "b": 9, "c": 1}, {f"s{i:03}": 1 + 199 * (i == 7) for i in range(200)}])
def test_exact_mix_stays_within_a_block_of_the_weights(weights):
    total, blocks, had = sum(weights.values()), {s: 8 * w for s, w in weights.items()}, dict.fromkeys(weights, 0)
    for at, (source, number, slot) in enumerate(pfair.timetable(pfair.whole(weights), blocks)):
        assert slot == at and number == had[source]
        had[source] += 1
        assert all(abs(n - (at + 1) * weights[s] / total) < 1 + 1e-9 for s, n in had.items())
    assert had == blocks


def test_mix_of_more_sources_than_slots(spark):
    frame = spark.range(2600).selectExpr("id AS doc_id", "concat('s', id % 1100) AS source")
    out = pfair.mixed(frame, block=1).collect()
    assert len(out) == len({r.doc_id for r in out}) == len({r.slot for r in out}) == 2600
    with pytest.raises(ValueError):
        pfair.mixed(frame, period=pfair.PERIOD)


def test_exact_mix_over_a_table(spark):
    weights = {"s0": 0.9, "s1": 0.09, "s2": 0.01}
    frame = spark.range(6000).selectExpr("id AS doc_id", "concat('s', CASE WHEN id < 5000 THEN 0 ELSE 1 + id % 2 END) AS source")
    out = pfair.mixed(frame, weights, block=1, exact=True).collect()
    assert len({r.slot for r in out}) == len({(r.source, r.rank) for r in out}) == 6000
    parts = {r.source: r.share for r in out}
    assert all(abs(parts[s] / sum(parts.values()) - w) < 1e-9 for s, w in weights.items())
    slots = {s: sorted(r.slot for r in out if r.source == s) for s in weights}
    assert all([r.slot for r in sorted(out, key=lambda r: r.rank) if r.source == s] == slots[s] for s in weights)
    for s, w in weights.items():
        assert all(abs(n - t * w) < 1 + 1e-6 for n, t in enumerate(slots[s]) if t < 5000)
    assert pfair.mixed(frame.limit(0), exact=True).collect() == []


ROWS = [
    (1, 0, "user", "hi <|im_end|> there"), (1, 1, "assistant", "<|<\\|<\\\\|im_start|>"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, None, None, None),
    (2, 5, "as\nsis\\tant\\l\\\\", "text\nwith lines"), (3, 0, "assistant", None), (3, 600, "assistant", "é" * 5000 + "<"), (3, 300, "user", "|x"), (4, 0, "user", ""),
]


def test_chat_equals_sql(spark):
    kind = "conv_id long, turn long, role string, text string, loss string"
    frame = spark.createDataFrame([(*r, "x") for r in ROWS], kind)
    from pyspark.sql import functions as F

    more = spark.createDataFrame([(-1, i, r, f"{chat.END}{chat.START}assistant ok", "") for i, r in enumerate(("user", "assistant"))], kind)
    got = chat.digests(chat.format_rows(frame.unionByName(more)))
    columns, want = by_sql(frame, chat.SQL.replace("ORDER BY turn, role, text", "ORDER BY turn NULLS FIRST, role, text"), "conversations")
    assert sorted([tuple(r) for r in got.select(*columns).collect()], key=str) == want
    assert chat.digests(chat.format_rows(frame.limit(0))).collect() == []
    turns = chat.format_rows(frame).select("conv_id", F.explode(chat.read_back("formatted", "loss")).alias("t")).select("conv_id", "t.role", "t.text")
    assert sorted(map(str, turns.collect())) == sorted(f"Row(conv_id={c}, role={(r or '')!r}, text={(t or '')!r})" for c, _, r, t in ROWS)


def test_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}',
        '{"prompt":"q","completion":"a"}', '{"instruction":"q","output":"a","input":""}', '{"response":"a","prompt":"q"}', '{"other":1}', "no json", None, '{"prompt":null,"completion":"a"}',
    ]
    frame = spark.createDataFrame(list(enumerate(records)), "id int, record string")
    out = chat.format_records(frame, "record", "id").orderBy("id").collect()
    assert [r.n_turns for r in out] == [2, 2, 2, 2, 2, 0, 0, 0, 1]
    assert len({r.formatted for r in out[:5]}) == 1 and len({r.fingerprint for r in out[:6]}) == 6


@pytest.mark.parametrize("sources", [20, 999, 1001])
def test_registered_mix_stays_within_a_block_of_the_weights(spark, sources):
    """A hot source and many small ones: the default weights are kept to whatever the number of sources."""
    rows = 40 * sources
    frame = spark.range(rows).selectExpr("id AS doc_id", f"concat('s', IF(id % 3 = 0, 0, id % {sources})) AS source")
    out = pfair.mixed(frame, block=1).select("source", "rank", "slot", "share").toPandas()
    weights = out.groupby("source").share.first() / out.groupby("source").share.first().sum()
    sizes = out.groupby("source").size()
    assert (abs(weights / weights["s1"] - (sizes / sizes["s1"]) ** 0.5) < 0.01).all() and len(out) == rows == out.slot.nunique()
    # Until the first source runs out each has had its weight of the slots so far, to less than a block.
    last = out.groupby("source").slot.max().min()
    early = out[out.slot <= last]
    given = early["rank"].to_numpy() - early.slot.to_numpy() * weights[early.source].to_numpy()
    assert abs(given).max() < 1 and abs(given + 1 - weights[early.source].to_numpy()).max() < 1


def rendered(template, optional, filler):
    """The wording of a template with or without its optional parts; mandatory words are marked with a star."""
    out, depth = [], 0
    for part in re.findall(r"\[|\]|\{\d+\}|[^\s\[\]{}]+", template):
        if part in "[]":
            depth += 1 if part == "[" else -1
        elif part[0] == "{":
            out += ["name"] * min(int(part[1:-1]), filler)
        elif not depth or optional:
            out.append(part if depth else part + "*")
    return out


def test_whole_notices(spark):
    """Every notice is found with and without its optional parts, and not with one mandatory word changed."""
    texts, want = [], {}
    for label, template in license_templates.TEMPLATES.items():
        for optional, filler in ((True, 9), (False, 0), (True, 1)):
            words = rendered(template, optional, filler)
            want[len(texts)] = (label, True)
            texts.append("Copyright x. " + ", ".join(w.strip("*").upper() for w in words) + ". End")
            must = [i for i, w in enumerate(words) if w.endswith("*")]
            for at in {must[0], must[len(must) // 2], must[-1]}:
                want[len(texts)] = (label, False)
                texts.append("Copyright x. " + " ".join("changed" if i == at else w.strip("*") for i, w in enumerate(words)) + " End")
    frame = documents(spark, texts)
    for row in license_templates.scan(frame).collect():
        label, there = want[row.doc_id]
        assert (label in row.labels.split(",")) == there, (label, there, texts[row.doc_id])
    columns, rows = by_sql(frame, license_templates.sql())
    assert sorted([tuple(r) for r in license_templates.scan(frame).select(*columns).collect()], key=str) == rows
