"""The pipeline over a small corpus, each stage against a plain version of what it has to do."""

import random

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

KEY = "ghp_aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0dF3gH6"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, label string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [f"t{i}" for i in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = prose(24)
    texts, labels = [], []
    for i in range(320):
        t = prose(90).split()
        bad = i % 4 == 0
        if bad:
            t[10:13] = ["awful", "nasty", "awful"]
        texts.append((i, " ".join(t)))
        labels.append((i, 1, int(bad)))
    clean = dict(texts)[1]
    near = clean.split()
    near[40] = "changed"
    texts += [(400, clean), (401, " ".join(near)), (402, f"{prose(60)} {item.upper()} {prose(30)}"), (403, f"{prose(50)} token = {KEY} {prose(40)}"), (403, prose(70)), (None, prose(80)), (404, None), (405, "")]
    rows = [(i, t, "en", f"s{k % 3}", len(t or ""), "clash", "clash") for k, (i, t) in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_and_run(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{corpus}/{name.replace(' ', '-')}"
        stage(spark, docs, corpus).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = [r.asDict() for r in docs.collect()]
        assert name == "mixing" or docs.columns == columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    good = seen[names[0]]
    assert not any(" awful " in (r["text"] or "") for r in good) and sum(r["doc_id"] is not None and r["doc_id"] < 320 for r in good) >= 0.98 * 240
    groups = brute.near([(r["doc_id"], r["text"]) for r in good if r["doc_id"] not in (None, 403)], 5)
    kept = {i for i, (_, c) in groups.items() if i == c} | {None, 403}
    assert {r["doc_id"] for r in seen[names[1]]} == kept and 401 not in kept and 400 not in kept
    assert {r["doc_id"] for r in seen[names[2]]} == kept - {402}
    before, after = ({(r["doc_id"], r["text"]) for r in seen[n]} for n in names[2:4])
    assert after == {(i, t and t.replace(KEY, "<SECRET>")) for i, t in before} and after != before
    sizes = sorted((r["doc_id"] or -1, len((r["text"] or "").split())) for r in seen[names[3]])
    assert sorted((r["doc_id"] or -1, r["size"]) for r in seen[names[4]]) == sizes
    again = corpus_pipeline.run(spark, corpus)
    assert {tuple(r) for r in again.collect()} == {tuple(r.values()) for r in seen[names[4]]}


def test_stages_on_an_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        assert out.count() == 0 and (name == "mixing" or out.columns == docs.columns)
