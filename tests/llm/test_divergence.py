import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from meridia.llm import divergence

DOC = "doc_id long, text string, lang string, source string, term string, digest long"


def terms(text):
    found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in found]


def plain_audit(rows, least, listed):
    groups, documents = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        groups[lang or "", source or ""].update(terms(text))
        documents[lang or ""].update(set(terms(text)))
    kept = {lang: [t for t, n in c.items() if n >= least] for lang, c in documents.items()}
    langs = defaultdict(Counter)
    for (lang, _), c in groups.items():
        langs[lang].update(c)

    def probabilities(count, lang):
        below = sum(count[t] for t in kept[lang]) + 5 * len(kept[lang])
        return {t: 1 + 1_000_000_000 * (count[t] + 5) // below for t in kept[lang]}

    p = {g: probabilities(c, g[0]) for g, c in groups.items()}
    q = {lang: probabilities(c, lang) for lang, c in langs.items()}
    out = []
    for lang, source in groups:
        mine = p[lang, source]
        pairs = [(sum(abs(mine[t] - p[g][t]) for t in kept[lang]), g[1]) for g in groups if g[0] == lang and g[1] != source]
        over = [(mine[t] - q[lang][t], t) for t in kept[lang] if groups[lang, source][t] and mine[t] > q[lang][t]]
        for part, found in (("pair", pairs), ("term", over)):
            found = sorted(found, key=lambda v: (-v[0], v[1].encode()))
            out += [(lang, source, part, i, v, r) for r, (v, i) in enumerate(found if part == "pair" else found[:listed], 1)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("un", "Zw", "dreÉ", "日本", "x") for b in "abcdefghij"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) + "1,é", rng.choice(["en", "de"]), f"s{rng.randint(0, 4)}", "x", 1) for i in range(150)]
    rows += [(900, None, "en", "s0", None, None), (901, "", None, None, None, None), (None, "A-a.B", "de", None, None, None), (902, "12 34", "xx", "s9", None, None)]
    return rows + rows[:5] + [(903, "una " * 50_000, "en", "s0", "x", 1)]


def audited(frame, **how):
    return sorted(tuple(r) for r in divergence.audit(frame, **how).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("seed,how", [(1, {"least": 5, "listed": 4}), (2, {"least": 2, "listed": 50, "bits": 3}), (3, {"least": 10_000, "listed": 50})])
def test_audit_is_that_of_plain_counting(spark, seed, how):
    rows = corpus(seed)
    found = audited(spark.createDataFrame(rows, DOC).repartition(6), **how)
    assert found == plain_audit(rows, how["least"], how["listed"])


def test_many_sources_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "CELLS", 40)
    rows = corpus(4)
    assert audited(spark.createDataFrame(rows, DOC), least=3, listed=3) == plain_audit(rows, 3, 3)


def test_colliding_digests_are_found(spark):
    counts = divergence.count_terms(spark.createDataFrame(corpus(5), DOC), bits=4)
    assert divergence.collisions(counts).count() > 0
    assert divergence.collisions(divergence.count_terms(spark.createDataFrame(corpus(5), DOC))).count() == 0


def test_probability_is_exact_for_large_counts(spark):
    cases = [(0, 0, 1), (5, 10, 7), (9_000_000_000_000, 9_000_000_000_001, 3), (123_456_789_012, 8_999_999_999_999_999, 10)]
    frame = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence.probability(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r.p == 1 + 1_000_000_000 * (r.c + 5) // (r.n + 5 * r.v) for r in frame.collect())


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], DOC)).count() == 0
