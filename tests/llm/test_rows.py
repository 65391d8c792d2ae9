"""Conversation repair, whitening and web archives against plain versions, and on awkward tables."""

from __future__ import annotations

import random

import numpy as np
import pytest

from secscan.llm import queries, turn_repair, warc, whitening
from tests.llm import brute_rows as brute

SF = "/root/testdata/sf0.001"
TURNS = "conv_id bigint, turn bigint, role string, text string, place string, code int, same string"


def report(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


# ---------------------------------------------------------------- 11
def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = report(queries.op11(spark, SF))
    assert got == brute.op11(rows) and len(got) > 5


def made(n, seed, convs):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", " \t", "A!", "b?", "Long enough.", "x"]
    return [(rng.randrange(convs), rng.choice([None, *range(30)]), rng.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]),
             rng.choice(texts) + str(rng.randrange(40)) * rng.randrange(2) + rng.choice(["", ".", "?"])) for _ in range(n)]


def test_repair_of_random_and_awkward_rows(spark):
    rows = made(1500, 11, 200) + [(None, 1, "user", "q."), (None, 2, None, None), (1000, None, None, None), (1001, 5, "user", "z." * 200000)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS)
    assert report(turn_repair.repair(df)) == brute.repaired(rows)
    got = report(turn_repair.repair_damaged(df))
    assert got == brute.op11(rows)
    none = spark.createDataFrame([], TURNS)
    assert turn_repair.repair(none).count() == 0 == turn_repair.repair_damaged(none).count()


def test_repair_of_a_conversation_over_many_tasks(spark):
    """One conversation holds most rows, so it spans several sorted partitions; its stretches are joined exactly."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), f"text {t}" + rng.choice(["", ".", "."])) for t in range(900)]
    rows += made(100, 3, 5) + [(7, 3, "user", "again."), (7, 800, "user", "again.")]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sorted_rows = turn_repair.ordered(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
        narrow = turn_repair.lattice(sorted_rows)
        assert narrow.filter("conv_id = 7").select("part").distinct().count() > 3
        got = report(turn_repair.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got == brute.repaired(rows)


def test_prices_are_distances_and_segments_join():
    rng = random.Random(2)
    for n in (1, 2, 31, 32, 33, 100):
        codes = [rng.randrange(12) for _ in range(n)]
        whole = turn_repair.prices(codes, list(turn_repair.END), False)[0][:4]
        cut = rng.randrange(n) + 1
        at = list(turn_repair.END)
        for part in (codes[cut:], codes[:cut]):
            if part:
                d = turn_repair.distances(part)
                at = [min(d[4 * q + to] + at[to] for to in range(4)) for q in range(4)]
        assert at == whole


# ---------------------------------------------------------------- 12
def test_whitening_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute.whitened(rows)
    got = queries.op12(spark, SF).collect()
    assert len(got) == len(want)
    sign = {}
    for r in got:
        n, deviation, w, explained = want[r.vec_id, r.component]
        sign.setdefault(r.component, np.sign(w * r.whitened))
        assert (r.n, r.deviation) == (n, deviation) and r.explained == pytest.approx(explained, rel=1e-9)
        assert r.whitened == pytest.approx(sign[r.component] * w, abs=1e-5) and 0 <= r.identity_error < 1e-8


def test_whitening_of_awkward_rows(spark):
    schema = "vec_id bigint, embedding array<float>, x int, id string"
    rng = np.random.default_rng(1)
    good = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(40)]
    odd = [(90, None), (91, []), (92, [1.0, None, 0.0, 0.0, 0.0]), (93, [float("nan")] * 5), (94, [float("inf")] + [0.0] * 4), (95, [1.0, 2.0]),
           (96, [3e38, 0.0, 0.0, 0.0, 0.0])]
    again = [good[3]] * 20 + [(None, good[3][1])]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in good + odd + again], schema).repartition(5)
    got = whitening.whiten(df).collect()
    want = brute.whitened(good)
    assert len(got) == 61 * 5 and {r.vec_id for r in got} == {None, *range(40)}
    assert all((r.n, r.deviation) == want[r.vec_id, r.component][:2] for r in got if r.vec_id is not None)
    assert all(abs(abs(r.whitened) - abs(want[r.vec_id, r.component][2])) < 1e-6 for r in got if r.vec_id is not None)
    assert whitening.whiten(df.limit(0)).count() == 0 == whitening.whiten(df.filter("vec_id >= 90")).filter("vec_id < 90").count()
    assert whitening.whiten(df.filter("vec_id = 3")).count() == 0  # one distinct vector has no variance
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], "vec_id bigint, embedding array<double>")
    line = whitening.whiten(flat).collect()
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)


def test_eigenvectors_of_difficult_matrices():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    close = q @ np.diag(np.concatenate([[5, 5, 5, 5 - 1e-9, 4.999], np.linspace(3, 0.1, 25)])) @ q.T
    w21 = np.diag(np.abs(np.arange(21) - 10.0) + 20) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    for a in (np.eye(6) * 3, np.diag([3.0, 1, 2]), close, w21, np.array([[2.0]]), np.array([[2.0, 1], [1, 2]])):
        values, vectors = whitening.leading(a, 16)
        k = min(16, len(a))
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], rtol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-10)
        assert np.abs(a @ vectors - vectors * values).max() < 1e-9


# ---------------------------------------------------------------- 13
def test_archives_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    assert sorted((tuple(r) for r in queries.op13(spark, SF).collect()), key=str) == brute.warc(rows)


AWKWARD = [(1, "http://a/ b\nc", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"),
           (6, "é", "HTTP/1.1 404 no\r\n\r\nß😀"), (None, "n", "x"), (None, "n", "alone"), (None, "n", "alone"), (7, "u", "y" * 3000000), (7, "u", "z"),
           (8, "u", "twice"), (8, "u", "twice"), (9, "u", " "), (-3, "u", " ")]


@pytest.mark.parametrize("size", [1, 1 << 30])
def test_archives_of_awkward_rows(spark, size):
    df = spark.createDataFrame([(*r, 1, "f", 0) for r in AWKWARD], "page_id bigint, url string, html string, length int, file string, `offset` int").repartition(3)
    got = warc.round_trip(df, archive_bytes=size)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute.warc([(i, h) for i, _, h in AWKWARD])
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archives_are_read_by_index(spark):
    df = spark.createDataFrame(AWKWARD, "page_id bigint, url string, html string")
    files = warc.write(df, least=2)
    places = warc.index(files).cache()
    assert places.count() == len(AWKWARD) == files.agg({"n_records": "sum"}).first()[0]
    assert {r.id for r in places.filter("record_type = 'revisit'").collect()} == set()  # 'x' and ' ' are shorter than 2 bytes
    got = {r.id: r for r in warc.read(places.filter("id IN (1, 5, 6)")).collect()}
    assert got[5].payload.decode() == AWKWARD[4][2] and got[6].payload.decode() == AWKWARD[5][2] and got[1].url == "http://a/%20b%0Ac"
    assert all(r.payload_digest == r.payload_sha1 for r in got.values()) and places.filter("id = 2").first().url is None


def test_reads_are_coalesced():
    at = [("a", 0, 10), ("a", 12, 5), ("a", 500, 5), ("a", 505, 100), ("b", 0, 1)]
    assert [(f, s, e, len(h)) for f, s, e, h in warc.coalesced(at, gap=5, most=50)] == [
        ("a", 0, 17, 2), ("a", 500, 505, 1), ("a", 505, 605, 1), ("b", 0, 1, 1)]


def test_a_cut_archive_is_an_error():
    data = warc.record(1, "u", b"abc", None, "2000-01-01T00:00:00Z")
    assert [(o, n) for o, n, _ in warc.members([(data * 3)[i:i + 7] for i in range(0, 3 * len(data), 7)])] == [(k * len(data), len(data)) for k in range(3)]
    with pytest.raises(ValueError):
        list(warc.members([data + data[:-5]]))
