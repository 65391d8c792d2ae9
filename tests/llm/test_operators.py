"""Each training-data operator against SQL, brute force or an exact round trip, and on awkward tables."""

from __future__ import annotations

import json
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from secscan.llm import (bagminhash, block_anchors, chat_format, common, decontaminate, host_reputation, kneser_ney, mixing, packed,
                         queries, quality_rules, separator_scan, suffix_buckets)
from tests.llm import brute
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_words int, kept string, label string"
_PROSE = " ".join(f"w{i * 7919 % 613}" for i in range(400))
EDGE = [(1, _PROSE, "en", "src0", 1, "x", "y"), (2, None, None, None, None, None, None), (3, "", "en", "src1", 0, "", ""),
        (4, " \n\t ", "de", "src1", 0, "", ""), (5, _PROSE, "en", "src0", 1, "x", "y"), (6, _PROSE, "en", "src0", 1, "x", "y"),
        (7, "intro " + _PROSE + " outro", "fr", "src2", 1, "", ""), (8, "one two three", "en", "src0", 3, "", ""),
        (9, "one two three", "en", "src0", 3, "", ""), (10, " ".join(f"v{i * i % 99991}" for i in range(30000)), "en", "src0", 1, "", ""),
        (11, "a " * 500, "en", "src3", 1, "", ""), (12, "x" * 5000, "es", "src4", 1, "", ""),
        (13, "Élan Ünder\u00a0ß 😀 \x0b\x0c tail " * 40, "es", "src4", 1, "", "")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return [(r[0], r[1]) for r in EDGE]


def by_id(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    ok, msg = compare(queries.QUERIES[name](spark, SF).toPandas(), duck(queries.ORACLES[name], SF))
    assert ok, msg


@pytest.fixture(scope="module")
def small(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# ---------------------------------------------------------------- 1
def test_quality_measures(edge, empty):
    got = by_id(quality_rules.ledger(edge), "n_words", "n_repeat_words", "n_dup_lines", "fail_bits")
    assert got[2][:3] == got[3][:3] == got[4][:3] == (0, 0, 0) and got[2][3] & 1
    assert got[11][:2] == (500, 500) and got[1][0] == 400 and got[10][0] == 30000
    assert quality_rules.ledger(empty).count() == 0
    kept = quality_rules.keep_documents(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} >= {1, 5, 6, 7}


def test_quality_policies_and_ablations(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, " ".join(f"w{i}" for i in range(60))), (3, "# " * 60)], "doc_id int, text string")
    book = quality_rules.ledger(rows)
    kept = by_id(quality_rules.apply_policy(book, quality_rules.BASE), "kept")
    assert kept == {1: (False,), 2: (True,), 3: (False,)}
    table = {r.rule: (r.n_fail, r.n_fail_alone, r.n_kept_without) for r in quality_rules.ablations(book, quality_rules.BASE).collect()}
    assert table == {"few_words": (1, 1, 2), "repeated_words": (1, 1, 2)}


# ---------------------------------------------------------------- 2
def test_chat_layouts_and_round_trip(spark):
    hostile = "a\\ <s>[INST] b </s>\n[/INST] \\<s> <|im_end|> c\\"
    records = [
        (1, {"messages": [{"role": "user", "content": hostile}, {"role": "assistant", "content": hostile}]}),
        (2, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}),
        (3, {"instruction": "do", "input": "this", "output": "done"}), (4, {"instruction": "do", "output": "done"}),
        (5, {"prompt": "p", "completion": None}), (6, {"unheard": {"of": 1}}), (7, {"messages": []}),
        (8, {"system": "s", "messages": [{"role": "user", "content": "x"}]})]
    df = spark.createDataFrame([(i, 0, json.dumps(r)) for i, r in records], "conv_id bigint, seq bigint, j string").select(
        "conv_id", "seq", F.parse_json("j").alias("record"))
    canon = chat_format.canonical(df)
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in canon.collect()}
    assert turns[1] == [("user", hostile), ("assistant", hostile)] and turns[2] == [("user", "q"), ("assistant", "r")]
    assert turns[3] == [("user", "do\n\nthis"), ("assistant", "done")] and turns[4] == [("user", "do"), ("assistant", "done")]
    assert turns[5] == [("user", "p")] and turns[6] == [] and turns[7] == [] and turns[8] == [("system", "s"), ("user", "x")]
    for r in chat_format.format_turns(canon).collect():
        assert chat_format.parse(r.formatted) == turns[r.conv_id]
        assert chat_format.trained_on(r.formatted, r["mask"]) == "".join(t for role, t in turns[r.conv_id] if role == "assistant")
    assert {(r.layout, r.n) for r in chat_format.survey(df).collect()} >= {(None, 1), ("messages", 1), ("prompt", 1)}


def test_chat_rows_with_nulls_ties_and_no_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, formatted string"
    rows = [(1, 1, "assistant", "b", ""), (1, 1, "assistant", "a", ""), (1, None, "user", None, ""), (None, 0, None, "t\n\\", ""),
            (2, 0, "as\nsis\\tant", "x", ""), (2, 0, "as\nsis\\tant", "x", ""), (3, 0, "assistant", "y" * 300000, "")]
    for data in (rows, []):
        df = spark.createDataFrame(data, schema).select("conv_id", F.col("turn").alias("seq"), F.to_variant_object(
            F.struct("role", "text")).alias("record"))
        out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(chat_format.canonical(df))).collect()}
        if not data:
            assert not out
            continue
        assert out[1].turns_sha256 == brute.sha("user\n\nassistant\na\nassistant\nb\n") and out[1].loss_sha256 == brute.sha("ab")
        assert out[None].turns_sha256 == brute.sha("\nt\n\\\n") and out[2].turns_sha256 == brute.sha("as\nsis\\tant\nx\n" * 2)
        assert out[3].loss_chars == 300000


# ---------------------------------------------------------------- 3
def test_decontamination_finds_renamed_questions(spark, edge, empty):
    question = "Every morning in Ohio the farmer Alice packs 12 boxes with 7 apples and gives 12 boxes to Bob at noon sharp"
    renamed = question.replace("12", "31").replace(" 7 ", " 9 ").replace("Alice", "Carla").replace("Bob", "Dieter")
    mixed = question.replace("packs 12", "packs 31").replace("Alice", "Bob")
    clash = renamed.replace("with 9", "with 31").replace("Dieter", "Carla")
    bench = spark.createDataFrame([(1, question), (2, None), (3, ""), (4, "short item here"), (5, question)], "item_id bigint, text string")
    docs = spark.createDataFrame([
        (1, "Before. " + question + ". After"), (2, "Before. " + renamed + ". After"), (3, "Before. " + mixed + ". After"),
        (4, None), (5, ""), (6, "this short item here is found"), (7, _PROSE), (None, question), (8, question.replace("12", "31", 1)),
        (9, question.replace("12", "31", 1) + " then" * 200), (10, clash)], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(docs, bench).collect()}
    # 3, 8 and 9 keep 13 words as they are behind the edited value; 10 makes two values equal within every 13 words
    assert got == {(1, 1): "verbatim", (2, 1): "renamed", (3, 1): "verbatim", (6, 4): "verbatim", (8, 1): "verbatim", (9, 1): "verbatim"}
    assert {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()} == {4, 5, 7, 10}
    assert decontaminate.leaks(edge, bench).count() == 0 == decontaminate.leaks(empty, bench).count()
    assert decontaminate.leaks(edge, bench.limit(0)).count() == 0


def test_decontamination_tells_rows_of_a_doc_id_apart(spark):
    question = "Every morning in Ohio the farmer Alice packs 12 boxes with 7 apples and gives 12 boxes to Bob at noon sharp"
    bench = spark.createDataFrame([(1, question, "x")], "item_id bigint, text string, shift string")
    rows = [(5, "hello"), (5, question.replace("12", "31", 1)), (5, "hello"), (6, question), (6, question.replace("12", "31")), (7, "fine")]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id bigint, text string, _row int, rank string")
    got = {(r.doc_id, r.item_id): (r.kind, r.n_windows) for r in decontaminate.leaks(docs.drop("_row"), bench).collect()}
    assert {k: v[0] for k, v in got.items()} == {(5, 1): "verbatim", (6, 1): "verbatim"} and got[6, 1][1] == 15
    kept = decontaminate.clean_documents(docs, bench)
    assert sorted(r.text for r in kept.collect()) == ["fine", "hello", "hello"] and kept.columns == docs.columns


def test_decontamination_equals_sql_on_difficult_tables(spark, tmp_path):
    """Renamed, half-edited and loosely matching copies of items, so that both forms and both kinds occur."""
    import random

    from pyspark.sql import Row
    rng = random.Random(4)
    names, plain = ["Tom", "Ann", "Bob", "Eve", "Ohio"], "the has buys more and then gives to some red old apples boxes for of".split()
    def word():
        return rng.choice([*plain, *plain, rng.choice(names), str(rng.randrange(9)), rng.choice(["three", "five"]), "km", "Km", "12kg"])
    items = [" ".join(word() + rng.choice(["", "", "", ".", ","]) for _ in range(rng.choice([3, 9, 16, 25]))) for _ in range(25)]
    docs = []
    for i, text in enumerate(items * 6):
        new = {n: rng.choice(names) for n in names} | {str(k): str(rng.randrange(9)) for k in range(9)} | {"three": "five"}
        out = [w if rng.random() < 0.3 else "".join(new.get(p, p) for p in [w.rstrip(".,"), w[len(w.rstrip(".,")):]]) for w in text.split()]
        docs.append(Row(doc_id=i % 140, text="so " * rng.randrange(3) + " ".join(out) + " end"))
    spark.createDataFrame(docs).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([Row(item_id=i, text=t) for i, t in enumerate(items)]).coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = queries.op3(spark, str(tmp_path)).toPandas()
    ok, msg = compare(got, con.execute(queries.ORACLES["op3_decontamination"]).fetchdf())
    assert ok, msg
    assert set(got.kind) == {"verbatim", "renamed"} and len(got) > 50


def test_decontamination_finds_names_that_open_sentences_and_number_words(spark):
    tom = "Tom has 3 apples. Tom buys 5 more apples. How many apples does Tom have now?"
    lead = "Sarah walks to the old market hall. Peter carries three heavy baskets and Sarah pays twenty-one coins for the fish"
    bench = spark.createDataFrame([(1, tom), (2, lead)], "item_id bigint, text string")
    docs = spark.createDataFrame([
        (1, "Q: " + tom.replace("Tom", "Ann")), (2, "so " + tom.replace("Tom", "Ann").replace("3", "four")),
        (3, lead.replace("Sarah", "Maria").replace("Peter", "Hugo").replace("three", "five").replace("twenty-one", "30")),
        (4, lead.lower()), (5, lead.replace("Sarah", "Maria", 1).replace("three", "five").replace("Peter", "Sarah")), (6, tom),
        (7, lead.replace("Sarah", "Maria").replace("three", "five").replace("Peter", "Maria"))], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(docs, bench).collect()}
    # 5 renames its first 13 words one to one, 7 gives two people one name within every 13 words
    assert got == {(1, 1): "renamed", (2, 1): "renamed", (3, 2): "renamed", (4, 2): "verbatim", (5, 2): "renamed", (6, 1): "verbatim"}
    assert {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()} == {7}


# ---------------------------------------------------------------- 4
def test_near_classes(spark, edge, empty, texts, small):
    assert by_id(bagminhash.classes(edge), "class_id") == {k: (v,) for k, v in brute.near_classes(texts).items()}
    docs = spark.createDataFrame(small, "doc_id bigint, text string")
    assert by_id(bagminhash.classes(docs), "class_id") == {k: (v,) for k, v in brute.near_classes(small).items()}
    assert bagminhash.classes(empty).count() == 0
    odd = spark.createDataFrame([(None, _PROSE), (1, _PROSE), (1, _PROSE)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.class_id) for r in bagminhash.classes(odd).filter("doc_id IS NOT NULL").collect()) == [(1, 1), (1, 1)]
    assert sorted(str(r.doc_id) for r in bagminhash.keep_documents(odd).collect()) == ["1", "None"]


def test_near_copies_where_a_doc_id_has_several_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    near = a.replace("a59", "z")
    rows = [(1, a), (2, near), (2, b), (2, b), (3, b + " tail"), (4, a), (5, ""), (5, None), (6, a + " end"), (6, near)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id bigint, text string, kind string, node int")
    got = sorted((r.doc_id, r.class_id) for r in bagminhash.classes(docs).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (2, 2), (3, 2), (4, 1), (5, 5), (5, 5), (6, 1), (6, 1)]
    assert sorted((r.doc_id, r.text or "") for r in bagminhash.keep_documents(docs).collect()) == [(1, a), (2, b), (5, "")]
    assert bagminhash.keep_documents(docs).columns == docs.columns


def _edited(n, edits, seed, size=120):
    """Texts that are one base text with several words changed, each at places of its own."""
    import random
    rng = random.Random(seed)
    for d in range(n):
        w = [f"b{i}" for i in range(size)]
        for j, at in enumerate(rng.sample(range(size), edits(d, rng))):
            w[at] = f"e{d}_{j}" if rng.random() < 0.7 else f"s{rng.randrange(30)}"
        yield d, " ".join(w[rng.randrange(8):])


def test_only_bags_of_pairs_are_exchanged(spark):
    """Pairs meet the bags they name; the many others are left out before any exchange."""
    sets = spark.createDataFrame([(i, bytes([i % 250]) * 8) for i in range(2000)], "node bigint, bag binary")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (4, 4), (5, -1)], "a bigint, b bigint")
    got = bagminhash.with_bags(pairs, sets, "a", "b")
    assert sorted((r.a, r.b, r._x[0], r._y[0]) for r in got.collect()) == [(1, 2, 1, 2), (1, 2, 1, 2), (1, 3, 1, 3), (4, 4, 4, 4)]
    waiting = [got._jdf.queryExecution().optimizedPlan()]
    joins = []
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "Join":
            joins.append(node.joinType().toString())
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    assert sorted(joins) == ["Inner", "Inner", "LeftSemi", "LeftSemi"]


def test_only_texts_of_candidates_are_exchanged(spark, monkeypatch):
    """The texts of others go before an exchange, also where the candidates are too many for a broadcast; none is lost."""
    rows = spark.range(20000).select(F.col("id").alias("node"), F.lit("x").alias("text"))
    for n in (0, 1, 900):
        keys = spark.range(n).select((F.col("id") * 17 - 34).alias("node"))
        left = common.perhaps(rows, "node", keys)
        assert left.columns == ["node", "text"] and left.join(keys, "node", "left_semi").count() == max(0, n - 2) and left.count() <= n + 2500
    monkeypatch.setattr(common, "MOST_BITS", 1 << 10)
    monkeypatch.setattr(common, "BUCKET", 1 << 8)
    assert common.perhaps(rows, "node", keys).join(keys, "node", "left_semi").count() == 898
    monkeypatch.undo()
    got = bagminhash.texts_of(rows.withColumn("more", F.lit(1)), keys)
    assert sorted(r.node for r in got.collect()) == [17 * i for i in range(898)]
    last = next(x for x in _below(got._jdf.queryExecution().optimizedPlan()) if x.nodeName() == "Join")
    assert any(x.nodeName() == "Join" and "xxhash64" in x.toString() for x in _below(last.left()))


def _below(node):
    return [node, *(x for i in range(node.children().size()) for x in _below(node.children().apply(i)))]


@pytest.mark.parametrize("edits", [lambda d, r: d % 4, lambda d, r: 1 + d % 6, lambda d, r: r.randrange(3, 12)])
def test_near_classes_of_one_template(spark, edits):
    """All documents share bands, but few pairs reach the threshold; classes are those of all pairs."""
    rows = list(_edited(150, edits, 7))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = by_id(bagminhash.classes(docs, bands=64, rows=1), "class_id")
    want = brute.near_classes(rows)
    assert got == {d: (c,) for d, c in want.items()} and len(set(want.values())) > 5


def test_recall_of_bands(spark):
    """Pairs of the given table at 0.8 and more, by exact similarity, that end in one class."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = by_id(bagminhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string")), "class_id")
    pairs = [(a, b) for a, b, _ in brute.near_pairs(rows)]
    found = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) > 20 and found >= 0.99 * len(pairs)


def test_signatures_estimate_weighted_similarity():
    import numpy as np
    h = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = np.repeat(h, np.arange(40) % 5 + 1), np.repeat(h, np.arange(40) % 3 + 1)
    row = np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)])
    sig = bagminhash.signatures(2, row, np.concatenate([a, b]), 4096)
    want = brute.Counter(a.tolist()), brute.Counter(b.tolist())
    similarity = sum((want[0] & want[1]).values()) / sum((want[0] | want[1]).values())
    assert abs((sig[0] == sig[1]).mean() - similarity) < 4 * math.sqrt(similarity / 4096)


# ---------------------------------------------------------------- 5
@pytest.mark.parametrize("block", [1, 7, 1 << 19])
def test_token_counts(spark, edge, empty, texts, block):
    enc = separator_scan.encoder(queries.VOCABULARY, queries.SPLIT)
    args = queries.VOCABULARY, queries.SPLIT, queries.END_OF_TEXT
    if block == 1:
        texts, edge = texts[1:4], edge.filter("doc_id IN (2, 3, 4)")
    got = separator_scan.count_tokens(edge.repartition(3), *args, block=block)
    assert by_id(got, "n_tokens") == {d: (len(enc.encode_ordinary(t or "")),) for d, t in texts}
    assert separator_scan.count_tokens(empty, *args).count() == 0


def test_open_token_file(spark, tmp_path):
    import numpy as np
    np.array([5, 9, 9, 1, 2, 3], "<u2").tofile(tmp_path / "a.tokens")
    np.array([], "<u2").tofile(tmp_path / "b.tokens")
    for block in (1, 2, 4, 100):
        got = separator_scan.documents(spark, f"file://{tmp_path}", 9, block).orderBy("ordinal").collect()
        assert [(r.file, r.ordinal, r["first"], r.n_tokens, r.closed) for r in got] == [
            ("a.tokens", 0, 0, 1, True), ("a.tokens", 1, 2, 0, True), ("a.tokens", 2, 3, 3, False)]
    (tmp_path / "c.tokens").write_bytes(b"abc")
    with pytest.raises(ValueError):
        separator_scan.documents(spark, f"file://{tmp_path}", 9)


# ---------------------------------------------------------------- 6
def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 1, 10), ("a", "y", 1, 100), ("b", "x", 1, 100), ("c", None, 1, 100)],
                                   "domain string, lang string, n_docs bigint, tokens bigint")
    weights = {("a",): 2, ("b",): 1, ("c",): 0, ("a", "x"): 3}
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(
        leaves, ["domain", "lang"], F.lit(90), weights, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 50, ("b", "x"): 30, ("c", None): 0}  # 60 for a: 45 of it for x, which has 10
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(
        leaves, ["domain", "lang"], F.lit(180), weights, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 70, ("c", None): 0}  # a is full, the rest goes to b


def test_mix_of_awkward_rows(edge, empty):
    tree = {"lang": F.col("lang"), "source": F.col("source")}
    got = mixing.mix(edge, tree, F.expr("tokens"), {}, epochs=3, per_bucket=1)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "copies"]
    assert all(1 <= r.copies <= 3 for r in got.collect())
    assert mixing.mix(empty, tree, F.expr("tokens"), {}).count() == 0
    one = {r.doc_id: r.copies for r in mixing.mix(edge, {"all": F.lit("x")}, F.expr("tokens * 2"), {}, epochs=3).collect()}
    assert set(one) == {r[0] for r in EDGE} and set(one.values()) == {2}


# ---------------------------------------------------------------- 7, 8
def test_substring_dedup(spark, edge, empty, texts, small):
    cols = "n_words", "n_removed", "kept_sha256"
    assert by_id(block_anchors.dedup(edge), *cols) == brute.block_anchors(texts)
    assert by_id(block_anchors.dedup(spark.createDataFrame(small, "doc_id bigint, text string")), *cols) == brute.block_anchors(small)
    assert block_anchors.dedup(empty).count() == 0 == block_anchors.clean_documents(empty).count()
    clean = block_anchors.clean_documents(edge)
    assert clean.columns == edge.columns
    got = by_id(clean, "text", "n_words", "label")
    assert got[1] == (_PROSE, 1, "y") and got[2] == (None, None, None) and got[7][0] == "intro outro" and 5 not in got
    odd = spark.createDataFrame([(None, _PROSE), (1, _PROSE), (1, _PROSE), (2, _PROSE)], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in block_anchors.dedup(odd).collect()) == [
        ("1", 0), ("1", 0), ("2", 400), ("None", 0)]


def test_blocks_are_hashed_by_slices():
    """A worker that sends the blocks of 8 MB holds their entries, not every array of their hashing; what it sends is that
    of one piece."""
    class Sent:
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            self.f = f
            return self

        groupBy = applyInArrow = lambda self, *_: self

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 9999, 1000)) for _ in range(1400)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([*range(1399), None], pa.int64()), "text": texts})
    docs = Sent()
    block_anchors.block_hits(docs, 8)
    [*docs.f(iter([batch.slice(0, 3)]))]
    tracemalloc.start()
    got = pa.Table.from_batches([b for b in docs.f(iter([batch]))])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ids, h, fixed = block_anchors.probes(pa.Table.from_batches([batch]), block_anchors.BLOCK)
    whole = pa.Table.from_batches([*packed.pack(ids, h, 8, block_anchors.KEY_BYTES, fixed)])
    assert got.equals(whole) and len(ids) == 1399 * 994
    assert most < 12 * batch.nbytes, most / batch.nbytes


def test_byte_dedup(spark, edge, empty, texts, small):
    cols = "n_bytes", "n_removed", "n_spans", "kept_sha256"
    assert by_id(suffix_buckets.dedup(edge), *cols) == brute.suffix_buckets(texts)
    few = small[:120]
    assert by_id(suffix_buckets.dedup(spark.createDataFrame(few, "doc_id bigint, text string")), *cols) == brute.suffix_buckets(few)
    assert suffix_buckets.dedup(empty).count() == 0
    odd = spark.createDataFrame([(None, _PROSE), (1, _PROSE), (2, _PROSE)], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in suffix_buckets.dedup(odd).collect()) == [
        ("1", 0), ("2", len(_PROSE)), ("None", 0)]


def test_bytes_are_hashed_by_pieces():
    """Hashing holds its results and little more, whatever the text's length; pieces change no identifier and no sample."""
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 3 * suffix_buckets.PIECE + 17, dtype=np.uint8)
    border = 2 * suffix_buckets.PIECE
    text[border - 150:border + 150] = text[500:800]  # over a border of pieces, and within one
    tracemalloc.start()
    gram, whole = suffix_buckets.refined(text, [32, 100])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 * len(text), most / len(text)
    at, none = np.array([0, 40, 40, len(text)]), np.zeros(3, bool)
    start, row, place = suffix_buckets.sampled(gram, at, none, 100, 32)
    assert start.tolist() == list(range(40, len(text) - 99)) and set(row.tolist()) == {2}
    here, there = (np.searchsorted(start, 500) + np.arange(201), np.searchsorted(start, border - 150) + np.arange(201))
    assert (whole[start[here]] == whole[start[there]]).all() and (gram[start[here]] == gram[start[there]]).all()
    assert (place[here] - start[here] == place[there] - start[there]).all()
    assert ((place >= start) & (place <= start + 68)).all() and len(np.unique(place)) < len(start) / 20
    _, later = suffix_buckets.refined(text[border - 200:], [32, 100])
    assert (later[:400] == whole[border - 200:border + 200]).all()
    assert not len(suffix_buckets.sampled(gram, at, ~none, 100, 32)[0])


def test_sent_documents_may_be_compressed_harder(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 31 + j * j) % 997}" for j in range(400))) for i in range(60)], "doc_id bigint, text string")
    plain, hard = (packed.parcels(docs.coalesce(1), 1, level=n).toArrow() for n in (3, suffix_buckets.LEVEL))
    for g in (0, 1):
        a, b = (t.filter(pa.compute.equal(t["grp"], g)) for t in (plain, hard))
        assert packed.opened(a).equals(packed.opened(b)) and b.nbytes < a.nbytes


def test_copies_are_told_apart_by_text_where_a_doc_id_has_two(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id bigint, text string")
    for dedup, size in ((block_anchors.dedup, lambda t: 60), (suffix_buckets.dedup, len)):
        got = sorted((r.doc_id, r.text[0], r.n_removed) for r in dedup(docs).collect())
        assert got == [(1, "a", 0), (2, "a", size(a)), (2, "b", 0), (3, "b", size(b))]
    assert sorted((r.doc_id, r.text) for r in block_anchors.clean_documents(docs).collect()) == [(1, a), (2, b)]


def test_kept_text_takes_no_separator_from_the_next_row(spark):
    import numpy as np
    from secscan.llm import packed
    group = packed.group_of(np.arange(1000), 8)
    first, second = np.flatnonzero(group == group[0])[:2].tolist()  # neighbours in one group
    docs = spark.createDataFrame([(first, "alpha beta"), (second, "\ngamma\t delta ")], "doc_id bigint, text string")
    got = by_id(block_anchors.dedup(docs), "kept_text", "kept_sha256")
    assert got == {i: (t, brute.sha(t)) for i, t in ((first, "alpha beta"), (second, "gamma delta"))}


# ---------------------------------------------------------------- 9
def test_language_model(spark, edge, empty, texts, small):
    for df, rows in ((edge, texts), (spark.createDataFrame(small, "doc_id bigint, text string"), small)):
        want = brute.kneser_ney(rows)
        for r in kneser_ney.score_corpus(df).collect():
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
            assert r.base_score == pytest.approx(want[r.doc_id][4]) and r.score == pytest.approx(want[r.doc_id][5])
    assert kneser_ney.score_corpus(empty).count() == 0
    untrained = kneser_ney.score(edge, kneser_ney.learn(empty), F.lit(True)).collect()
    assert all(r.score == r.base_score == 0 and r.n_known == 0 for r in untrained)


def test_model_beats_the_base_on_held_out_texts(spark):
    got = {r.held_out: r for r in kneser_ney.perplexity(kneser_ney.score_corpus(
        spark.read.parquet(f"{SF}/documents.parquet"))).collect()}
    assert got[True].perplexity < 0.6 * got[True].base_perplexity


# ---------------------------------------------------------------- 10
def test_urls_and_reputation(spark):
    urls = [(1, None), (2, "no scheme"), (3, "http://A.Example.ORG?x"), (4, "https://x.example.org/es/1?y#z"), (5, "http://bad.net/p"),
            (6, "http://good.net/p"), (7, "http://new.net"), (8, "http://x.example.org/en/12"), (8, "http://x.example.org/en/12"),
            (9, "http://org/a"), (10, "x://y://z/" + "p" * 100000)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in urls] + [(100 + i, "http://bad.net/q", "") for i in range(60)]
                                  + [(200 + i, "http://good.net/q", "") for i in range(60)], "page_id bigint, url string, host string")
    labels = spark.createDataFrame([(100 + i, 0, None) for i in range(60)] + [(200 + i, 1, 0) for i in range(60)]
                                   + [(1, None, None), (100, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = {r.page_id: r for r in host_reputation.judge(pages, labels, queries.URL_RULES).collect()}
    assert (out[1].host, out[1].path, out[2].host, out[3].host, out[3].path) == ("", "", "", "a.example.org", "")
    assert (out[4].rule, out[4].verdict, out[8].rule, out[9].rule) == ("example.org/es/", "block", "example.org/en/1", "org/")
    assert out[3].rule is None and out[5].verdict == "block" and out[6].verdict == "allow" and out[5].n_bad == 60
    assert out[10].host == "y:" and len(out) == 130
    assert host_reputation.judge(pages.limit(0), labels, queries.URL_RULES).count() == 0
    assert {r.verdict for r in host_reputation.judge(pages.filter("page_id > 4"), labels.limit(0), ()).collect()} == {"allow"}


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages_on_awkward_rows(spark, edge, empty):
    import corpus_pipeline
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "mixing" or out.columns == docs.columns
            out.count()


def test_pipeline_keeps_one_copy_and_clean_documents(spark, small):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF)
    near = {r.doc_id for r in corpus_pipeline.near_dedup(spark, kept, SF).select("doc_id").collect()}
    want = brute.near_classes([(r.doc_id, r.text) for r in kept.collect()])
    assert near == {d for d, c in want.items() if d == c}


def test_pipeline_equals_a_plain_run_of_all_stages(spark, tmp_path):
    """Ids, texts and copies after each stage: quality, leaks and mix by their SQL, near classes and repeats by brute force."""
    import duckdb

    import corpus_pipeline
    con = duckdb.connect()
    docs = con.execute(f"SELECT * FROM read_parquet('{SF}/documents.parquet')").fetchdf()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")

    def sql(name, rows):
        con.register("documents", rows)
        return con.execute(queries.ORACLES[name]).fetchdf()

    got = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, SF)
        seen.append({r.doc_id: (r.text, r.n_chars) for r in got.collect()})
        got = spark.createDataFrame(got.collect(), got.schema)

    def state(rows):
        return {r.doc_id: (r.text, r.n_chars) for r in rows.itertuples()}

    good = sql("op1_quality_rules", docs)
    docs = docs[docs.doc_id.isin(good[good.kept].doc_id)].copy()
    assert seen[0] == state(docs)
    label = brute.near_classes(list(zip(docs.doc_id.tolist(), docs.text.tolist())))
    docs = docs[[label[d] == d for d in docs.doc_id.tolist()]].copy()
    assert seen[1] == state(docs)
    cut = brute.without_repeats(list(zip(docs.doc_id.tolist(), docs.text.tolist())))
    docs = docs[[cut[d] is not None for d in docs.doc_id.tolist()]].copy()
    changed = [cut[d] != t for d, t in zip(docs.doc_id.tolist(), docs.text.tolist())]
    docs["text"] = [cut[d] for d in docs.doc_id.tolist()]
    docs["n_chars"] = [len(t) if c else n for t, n, c in zip(docs.text.tolist(), docs.n_chars.tolist(), changed)]
    assert seen[2] == state(docs) and any(changed)
    leaks = sql("op3_decontamination", docs)
    docs = docs[~docs.doc_id.isin(leaks.doc_id)].copy()
    assert seen[3] == state(docs)
    ok, msg = compare(corpus_pipeline.run(spark, SF).toPandas(), sql("op6_mixing", docs))
    assert ok, msg
