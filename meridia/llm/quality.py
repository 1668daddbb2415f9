"""Quality classification by co-training.

Two logistic models look at a document from different sides: one at the words
and the make-up of its text, one at its page metadata.  In each round each model
labels those unlabelled documents of which it is sure, for the other to learn
from.  Both are then calibrated on labelled documents held out from training, a
last model over the two calibrated views is fitted on others, and every document
is scored.

The labelled documents are a sample of documented size, chosen by hashes of ids.
They also tell which words the text view knows: those whose share differs most
between the classes, measured by their z score.  All other documents take part
in every round, as short rows of the features that the views know; the metadata
view learns from them by counts of equal rows.  Scoring goes over the rows of
the input themselves, so nothing is joined or shuffled for it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Labelled documents that models are fitted on, at most.
MAX_LABELLED = 20_000
#: Words that the text view knows.  The metadata view knows every value that two labelled documents have.
KNOWN = 512
LONGEST_WORD = 40
ROUNDS = 2
STEPS = 100
#: Strength of the prior, as of half a labelled document.
PRIOR = 0.5
#: A view labels for the other what it gives this probability or more.
SURE = 0.97
#: Of eight folds the first calibrates, the second combines, the others train.
FOLDS = 8
#: Documents below this probability are rejected: one toxic document kept weighs as much as two good ones lost.
THRESHOLD = 0.7
VIEWS = ("text", "meta")


def _bin(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"\n{name}="), F.least(F.floor(value), F.lit(15)).cast("string"))


def _share(name: str, text: Column, pattern: str) -> Column:
    """A token for the share of such characters, on a log scale; no word holds a newline."""
    share = F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))
    return _bin(name, 2 * F.log2(1 + 255 * share))


SHAPES = ("upper", "digits", "marks", "lines", "words")


def tokens(row: Column, text_col: str, metadata: list[str]) -> dict[str, Column]:
    """What each view sees of a document, as strings; null text counts as empty."""
    text = F.coalesce(row[text_col].cast("string"), F.lit(""))
    words = F.split(F.lower(text), "[\\x20\\x09-\\x0D.,;:!?\"'()#$%&*|]+")
    shapes = F.array(_share("upper", text, "[A-Z]"), _share("digits", text, "[0-9]"), _share("marks", text, "[!#$%&*|]"), _share("lines", text, "\n"), _bin("words", F.log2(F.size(words))))
    facts = [F.concat(F.lit(c + "="), row[c].cast("string")) for c in metadata]
    pairs = [F.concat(a, F.lit(" "), b) for i, a in enumerate(facts) for b in facts[i + 1 :]]
    meta = F.array_compact(F.array(*facts, *pairs)) if facts else F.array().cast("array<string>")
    return {"text": F.concat(words, shapes), "meta": meta}


def _telling(labelled: DataFrame, view: str, n: dict[float, int]) -> list[str]:
    """Of words the KNOWN whose share differs most between the classes, and all shape tokens; of metadata every value of two documents.

    Both come from the bounded sample of labelled documents.
    """
    n0, n1 = float(n[0.0]), float(n[1.0])
    each = labelled.select("label", F.explode(F.array_distinct(view)).alias("value")).groupBy("value").agg(F.sum(1 - F.col("label")).alias("c0"), F.sum("label").alias("c1"))
    p = (F.col("c0") + F.col("c1")) / (n0 + n1)
    z = F.abs(F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-12)
    usual = f"not startswith(value, '\\n') and length(value) between 1 and {LONGEST_WORD}" if view == "text" else "true"
    scored = each.where(f"c0 + c1 >= 2 and {usual}").select("value", z.alias("z"))
    scored = scored.orderBy(F.desc("z"), "value")
    best = [r.value for r in (scored.limit(KNOWN) if view == "text" else scored).collect()]
    return best + ([f"\n{s}={i}" for s in SHAPES for i in range(16)] if view == "text" else []) or ["\n"]


@dataclass
class CoTrained:
    vectors: dict[str, CountVectorizerModel]
    views: dict[str, LogisticRegressionModel]
    calibrated: dict[str, np.ndarray]
    both: np.ndarray

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with the views' tokens -> + text_score, meta_score, score."""
        logits = []
        for v in VIEWS:
            rows = _margin(self.vectors[v].transform(rows), self.views[v], v).drop(f"{v}_features")
            a, b = map(float, self.calibrated[v])
            logits.append(F.greatest(F.least(F.col(f"{v}_margin") * a + b, F.lit(30.0)), F.lit(-30.0)))
        c, d, e = map(float, self.both)
        chance = lambda x: 1 / (1 + F.exp(-x))
        return rows.select("*", *(chance(x).alias(f"{v}_score") for v, x in zip(VIEWS, logits)), chance(logits[0] * c + logits[1] * d + e).alias("score"))


def _margin(rows: DataFrame, model: LogisticRegressionModel, view: str) -> DataFrame:
    return model.transform(rows).withColumn(f"{view}_margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction")


def _fit(rows: DataFrame, view: str, size: float) -> LogisticRegressionModel:
    """rows: features, label, weight; size: the sum of weights."""
    return LogisticRegression(featuresCol=f"{view}_features", labelCol="label", weightCol="weight", regParam=PRIOR / max(size, 1.0), maxIter=STEPS, standardization=False).fit(rows)


def logistic(x: np.ndarray, y: np.ndarray, prior: float = 1e-2) -> np.ndarray:
    """Slopes and intercept by damped Newton steps, on targets smoothed by the size of each class.

    A slope below zero, by which a view would be read the wrong way round, is
    set to zero and the intercept fitted again.
    """
    x = np.column_stack((np.clip(x, -30, 30), np.ones(len(x))))
    up, down = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    held = np.append(np.full(x.shape[1] - 1, prior), 1e-6)
    free, out = np.ones(x.shape[1], bool), np.zeros(x.shape[1])
    for _ in range(x.shape[1]):
        out[~free] = 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
            gradient = (x.T @ (target - p) - held * out)[free]
            curve = ((x * (p * (1 - p))[:, None]).T @ x + np.diag(held))[np.ix_(free, free)]
            step = np.linalg.solve(curve, gradient)
            out[free] += step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        wrong = free & (out < 0) & (np.arange(len(out)) < len(out) - 1)
        if not wrong.any():
            break
        free &= ~wrong
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("lang", "source"), rounds: int = ROUNDS) -> CoTrained | None:
    """labels: id and label (1 keep, 0 reject).  None if the labels do not hold both classes."""
    kind = dict(docs.dtypes)[id_col]
    labels = labels.select(F.col(id_col).cast(kind).alias("id"), F.col("label").cast("double").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"))
    # the first by hash: a bounded sample, and so may be broadcast
    chosen = F.broadcast(materialise(labels.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS))), "quality-chosen"))
    known = [c for c in metadata if c in docs.columns]
    rows = docs.select(F.col(id_col).alias("id"), F.struct(text_col, *known).alias("row"))
    seen = [c.alias(v) for v, c in tokens(F.col("row"), text_col, known).items()]
    labelled = materialise(rows.join(chosen, "id").select("label", "fold", *seen), "quality-labelled")
    train = labelled.where("fold > 1")
    n = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    small = len(n) < 2  # too few labels for folds: all of them train, calibrate and combine
    if small:
        train = labelled
        n = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if len(n) < 2:
            return None
    vectors = {v: CountVectorizerModel.from_vocabulary(_telling(train, v, n), inputCol=v, outputCol=f"{v}_features") for v in VIEWS}
    for model in vectors.values():
        model.setBinary(True)
    short = rows.join(chosen, "id", "left").select("label", "fold", *seen)
    short = vectors["text"].transform(short).select("label", "fold", "meta", "text_features")
    short = materialise(short, "quality-features")
    pool = short.where("label is null")
    known = materialise(vectors["meta"].transform(short.where("label is not null")), "quality-known").coalesce(4)
    start = (known if small else known.where("fold > 1")).select("label", "text_features", "meta_features", F.lit(1.0).alias("weight"))
    size = float(sum(n.values()))
    held = known if small else known.where("fold <= 1")
    alone = views = {v: _fit(start, v, size) for v in VIEWS}
    for _ in range(rounds):
        sure = {v: _surely(views[v], v, _margins(held, views)) for v in VIEWS}
        views = {
            "text": _taught(start, sure["meta"](vectors["meta"].transform(pool)).select("label", "text_features", F.lit(1.0).alias("weight")), "text", size, alone),
            "meta": _taught(start, vectors["meta"].transform(sure["text"](pool).groupBy("meta", "label").agg(F.count("*").cast("double").alias("weight"))), "meta", size, alone),
        }
    got = _margins(held, views)
    calibrated = {v: _calibrated(got, v) for v in VIEWS}
    logits = np.column_stack([got[v] * calibrated[v][0] + calibrated[v][1] for v in VIEWS])
    use = _fold(got, 1)
    return CoTrained(vectors, views, calibrated, logistic(logits[use], got["label"][use]))


def _margins(held: DataFrame, views: dict[str, LogisticRegressionModel]) -> dict[str, np.ndarray]:
    """Folds, labels and both margins of the held-out labels, a part of the bounded sample."""
    for v in VIEWS:
        held = _margin(held, views[v], v)
    got = held.select("fold", "label", *(F.col(f"{v}_margin").alias(v) for v in VIEWS)).toPandas()
    return {c: got[c].to_numpy() for c in got.columns}


def _fold(got: dict[str, np.ndarray], fold: int) -> np.ndarray:
    """Rows of a fold; all, if folds are not used or a fold lacks a class."""
    parts = [got["fold"] == 0, got["fold"] == 1]
    whole = any(len(set(got["label"][p])) < 2 for p in parts) or got["fold"].max() > 1
    return np.ones(len(got["fold"]), bool) if whole else parts[fold]


def _calibrated(got: dict[str, np.ndarray], view: str) -> np.ndarray:
    use = _fold(got, 0)
    return logistic(got[view][use, None], got["label"][use])


def _surely(model: LogisticRegressionModel, view: str, got: dict[str, np.ndarray]):
    """A function that leaves rows of which the calibrated view is sure, with its label."""
    a, b = map(float, _calibrated(got, view))

    def told(rows: DataFrame) -> DataFrame:
        p = 1 / (1 + F.exp(-(F.col(f"{view}_margin") * a + b)))
        return _margin(rows.drop("label"), model, view).withColumn("label", F.when(p >= SURE, 1.0).when(p <= 1 - SURE, 0.0)).where("label is not null")

    return told


def _taught(start: DataFrame, told: DataFrame, view: str, size: float, alone: dict[str, LogisticRegressionModel]) -> LogisticRegressionModel:
    """Fitted on the labelled rows and all told ones, which together weigh no more than the labelled; as it is alone if it was told none."""
    told = materialise(told.select("label", f"{view}_features", "weight"), f"quality-told-{view}")
    total = told.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    if total == 0:
        return alone[view]
    share = min(1.0, size / max(total, 1.0))
    rows = start.select("label", f"{view}_features", "weight").unionByName(told.withColumn("weight", F.col("weight") * share))
    return _fit(rows, view, size + total * share)


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, metadata: tuple[str, ...], threshold: float) -> DataFrame:
    """row (all columns of a document), text_score, meta_score, score, rejected."""
    model = fit(docs, labels, id_col, text_col, metadata)
    seen = tokens(F.col("row"), text_col, [c for c in metadata if c in docs.columns])
    rows = docs.select(F.struct("*").alias("row")).select("row", *(c.alias(v) for v, c in seen.items()))
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select("row", none.alias("text_score"), none.alias("meta_score"), none.alias("score"), F.lit(False).alias("rejected"))
    return model.score(rows).select("row", "text_score", "meta_score", "score", (F.col("score") < threshold).alias("rejected"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("lang", "source"), threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, text_score, meta_score, score (probability to keep), rejected.

    Null texts are scored as empty ones, null metadata as absent, null ids and
    repeated rows like any other; texts of any length are read whole.  Null
    labels are not used; of contradicting labels the lower holds.  If the labels
    do not hold both classes nothing can be learned: scores are null and nothing
    is rejected.  An empty table gives no rows; columns of other names are not read.
    """
    scored = _scored(docs, labels, id_col, text_col, metadata, threshold)
    return scored.select(F.col("row")[id_col].alias("doc_id"), *(F.round(c, 6).alias(c) for c in ("text_score", "meta_score", "score")), "rejected")


def keep_accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("lang", "source"), threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, without rejected ones; a null id is judged like any other."""
    return _scored(docs, labels, id_col, text_col, metadata, threshold).where("not rejected").select("row.*")
