"""Operators on pages and embeddings, and the Elias-Fano sequences."""

import hashlib

import numpy as np
import pytest
from meridia.llm import ann, url_filter, warc
from meridia.llm.elias_fano import EliasFano
from pyspark.sql import functions as F


@pytest.mark.parametrize("n,top", [(1, 1), (5, 3), (1000, 1 << 40), (5000, 6000), (3000, 100)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
    ef = EliasFano.encode(values)
    assert (ef.access(np.arange(n)) == values).all()
    asked = np.concatenate((values, rng.integers(0, top + 5, 500).astype(np.uint64)))
    found = ef.find(asked)
    have = np.isin(asked, values)
    assert ((found >= 0) == have).all() and (values[found[have]] == asked[have]).all()


def test_warc_round_trip(spark):
    big = "<p>" + "payload " * 50 + "</p>"
    rows = [(5, "http://a/5", big), (2, "http://a/2", big), (9, None, big), (1, "http://a/1", "small"), (3, "http://a/3", "small"), (4, "http://a/é", None), (7, "http://a/7", "ü" * 60), (8, "http://a\n/8", "ü" * 60), (2, "http://a/2", big), (None, "x", big), (11, "long", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("path", F.lit("clash")).repartition(3)
    got = warc.archive_pages(pages).collect()
    assert len(got) == len(rows)
    bodies = {}
    for i, _, h in rows:
        bodies[i] = (h or "").encode()
    for r in got:
        body = bodies[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        want = {5: 2, 9: 2, 8: 7}.get(r.page_id)
        assert (r.record_type, r.refers_to) == (("revisit", want) if want else ("response", None))
    assert warc.archive_pages(pages.where("false")).count() == 0


@pytest.mark.parametrize("files", [1, 2])
def test_warc_keeps_other_payloads_of_a_repeated_id(spark, files):
    a, b = "a" * 200, "b" * 200
    rows = [(1, a), (5, a), (5, b), (6, b), (1, a), (None, b)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").repartition(files)
    got = warc.archive_pages(pages)
    want = [(1, a, "response", None), (1, a, "response", None), (5, a, "revisit", 1), (5, b, "response", None), (6, b, "revisit", 5), (None, b, "response", None)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()], key=key) == sorted([(i, hashlib.sha256(h.encode()).hexdigest(), k, f) for i, h, k, f in want], key=key)


def test_url_filter(spark):
    rules = [url_filter.Rule("net", "/", "block"), url_filter.Rule("example.net", "/en/", "allow"), url_filter.Rule("example.com", "/de/", "block"), url_filter.Rule("org", "/fr/", "allow")]
    rows = [
        (1, "http://A.example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "http://example.net/de/", "example.net", "/de/", "net/", "block"),
        (3, "https://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
        (4, "https://x.example.com/de/", "x.example.com", "/de/", "example.com/de/", "block"),
        (5, "https://www.spam.com/page.html#f", "www.spam.com", "/page.html", None, "block"),
        (6, "http://q.org/fr/#a", "q.org", "/fr/", "org/fr/", "allow"),
        (7, None, "", "", None, "allow"),
        (8, "no scheme", "", "", None, "allow"),
        (9, "http://host?x=/a", "host", "", None, "allow"),
        (9, "http://host?x=/a", "host", "", None, "allow"),
        (10, "http://bare.net", "bare.net", "", None, "allow"),
    ]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").withColumn("block", F.lit(1)).withColumn("host", F.lit("clash"))
    listed = spark.createDataFrame([("spam.com/page",), ("spam.com/page",), (None,)], "url string")
    got = url_filter.filter_urls(pages, listed, rules)
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {(r[0], *r[2:]) for r in rows}
    assert url_filter.filter_urls(pages.where("false"), listed, rules).count() == 0
    assert url_filter.filter_urls(pages, listed.where("false"), rules).where("listed").count() == 0


def test_url_filter_lets_no_listed_url_through(spark):
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 50, F.lit(".com/p"), "id").alias("url"))
    listed = pages.where("page_id % 3 = 0").select(url_filter.canonical(F.col("url")).alias("url"))
    got = url_filter.filter_urls(pages, listed, [])
    assert got.where("(page_id % 3 = 0) <> listed or (listed and not possible)").count() == 0
    assert got.where("possible and not listed").count() < 200


def vectors(spark, n=3000, d=16):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[500:900] = x[500]  # a frequent vector
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def test_nearest_recall_order_and_ties(spark):
    x, frame = vectors(spark)
    got = ann.nearest(frame.withColumn("leaf", F.lit("clash")), frame.where("vec_id % 100 = 0").select("vec_id"))
    rows = {}
    for r in got.collect():
        rows.setdefault(r.query_id, []).append(r)
    assert set(rows) == set(range(0, 3000, 100))
    hit = 0
    for q, rs in rows.items():
        rs.sort(key=lambda r: r["rank"])
        far = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        order = [int(i) for i in np.lexsort((np.arange(3000), far)) if i != q][:10]
        assert [r["rank"] for r in rs] == list(range(1, 11)) and q not in [r.vec_id for r in rs]
        assert [(r.score, r.vec_id) for r in rs] == sorted((r.score, r.vec_id) for r in rs)
        assert all(abs(r.score - far[r.vec_id]) < 1e-12 for r in rs)
        hit += len({r.vec_id for r in rs} & set(order))
        if 500 <= q < 900:
            assert [r.vec_id for r in rs] == order
    assert hit >= 0.9 * 10 * len(rows)


def test_search_goes_as_far_as_it_must():
    """With structure, a small share of the rows; within the radius, every leaf of each tree."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 6000)] + 0.01 * rng.normal(size=(6000, 16))
    forest = ann.Forest(x, ann.TREES, len(x) // ann.LEAVES, 7)
    found = [forest.search(q, ann.REACH * 0.06) for q in x[::100]]
    assert np.mean([sum(forest.shares[leaf] for leaf in leaves) for leaves in found]) < 0.3
    assert all(len(set(leaves)) == len(leaves) for leaves in found)
    assert len(forest.search(x[0], np.inf)) == len(forest.shares) and len(forest.search(x[0], np.inf, 5)) == 5


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_distances_break_ties_by_row(offset):
    """Binary and one-hot vectors are full of ties; a large common offset must not hide what is near."""
    rng = np.random.default_rng(4)
    tables = [rng.integers(0, 2, (450, 12)).astype(float) + offset, np.eye(60) + offset, rng.normal(size=(300, 8)) + offset]
    for x in tables:
        owner, row, far = ann._distances(x[:20], x, 7)
        for q in range(20):
            exact = np.sqrt(((x - x[q]) ** 2).sum(1))
            order = np.lexsort((np.arange(len(x)), exact))[:7]
            assert row[owner == q].tolist() == order.tolist() and np.array_equal(far[owner == q], exact[order])


def test_nearest_ties_go_to_smaller_ids(spark):
    x = np.random.default_rng(6).integers(0, 2, (450, 10)).astype(float)
    x[:, 0] = 1.0  # none is zero
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(frame, frame.where("vec_id % 10 = 0").select("vec_id")).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q, ids in got.items():
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert ids == [i for i in np.lexsort((np.arange(450), far)).tolist() if i != q][:10]


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 2.0]), (9, [2.0, 0.0]), (9, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(frame, frame.where("vec_id % 100 = 0").select("vec_id")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 100, 0.0), (0, 2, 9, 1.0), (100, 1, 0, 0.0), (100, 2, 9, 1.0)]
    assert ann.nearest(frame.where("false")).count() == 0


def test_the_driver_collects_no_vectors(spark, monkeypatch):
    """However many vectors the trees are fitted on, the driver gets one row of planes."""
    frame = _vectors(spark)
    kind, sizes = type(frame), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: sizes.append(len(rows := collect(self))) or rows)
    found = ann.nearest(frame, frame.where("vec_id % 100 = 0").select("vec_id"))
    assert sizes and max(sizes) == 1 and not [c for c in ("BroadcastHashJoin", "BroadcastNestedLoopJoin") if c in found._jdf.queryExecution().executedPlan().toString()]


def _vectors(spark):
    x = np.random.default_rng(5).normal(size=(1200, 6))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
