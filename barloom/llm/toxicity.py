"""Toxicity by a classifier chain of linear models.

Categories are label columns, judged one after the other. Each has a sparse (L1) logistic regression on
the distinct stems of the whole text (first ``STEMS`` letters of its words, so that inflected and compound
forms meet), a few marks of its shape, and the probabilities of the categories
before it. A later model is trained on out-of-fold probabilities of the earlier ones (``FOLDS`` folds, equal
texts in one fold), so that it learns from predictions as uncertain as those it will get.

Training takes a bounded sample of labelled rows: the ``MOST_LABELLED`` first by hash of their id, equal texts
once. A model chooses among the ``FEATURES`` stems per category that deviate most from chance. Scoring covers
every document in one pass; what is sent to the tasks are the stems with a weight.

Defined cases: a null or empty text has no words and gets the scores of the bias; a category with one class
among the labelled rows has its smoothed share as constant score; without any labelled row scores are
null and nothing is toxic; label rows without id or label, or labelled twice with different values, are
left out; repeated rows get equal scores; columns other than the ids, text and labels are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import arrow_map
from barloom.session import stored

CATEGORIES = ("quality", "toxic")
MOST_LABELLED = 20_000
FOLDS = 3
#: Stems per category that enter a model, by how far their share of a category is from chance.
FEATURES = 1_024
#: A stem must occur in as many labelled texts.
MIN_TEXTS = 8
REGULARISATION = 0.0005
STEPS = 30
FIT_TASKS = 2
THRESHOLD = 0.5
STEMS = (4, 5)
WORDS = re.compile(r"[^\W\d_]+")
SYMBOLS = "#*$%&|<>"


def features(text: str | None) -> list[str]:
    """The distinct stems in lower case, and marks of the text's shape (they hold a blank, no stem does)."""
    text = text or ""
    words = WORDS.findall(text.lower())
    distinct = set(words)
    stems = {w[:n] for n in STEMS for w in distinct}
    size = max(1, len(text))
    shape = [
        name
        for name, there in (
            ("mostly capitals", sum(map(str.isupper, text)) > 0.3 * size),
            ("many symbols", sum(map(text.count, SYMBOLS)) > 0.02 * size),
            ("many bars", text.count("|") > 0.02 * size),
            ("few distinct words", len(words) > 20 and len(distinct) < 0.3 * len(words)),
            ("hardly any words", len(words) < 10),
        )
        if there
    ]
    return [*stems, *shape]


@dataclass
class Model:
    """One link: bias, weights of words, weights of the earlier categories' probabilities."""

    bias: float
    words: dict[str, float] = field(default_factory=dict)
    earlier: list[float] = field(default_factory=list)

    def probability(self, found: list[str], before: list[float]) -> float:
        z = self.bias + sum(map(self.words.get, self.words.keys() & set(found))) + sum(w * p for w, p in zip(self.earlier, before, strict=False))
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z))))


def chain_scores(chain: list[Model], text: str | None) -> list[float]:
    found, scores = features(text), []
    for model in chain:
        scores.append(model.probability(found, scores))
    return scores


def _labelled(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], most: int) -> DataFrame:
    known = F.col("doc_id").isNotNull()
    for c in categories:
        known = known & F.col(c).isNotNull()
    ends = [f(c).alias(f"{n}_{c}") for c in categories for n, f in (("a", F.min), ("b", F.max))]
    once = labels.filter(known).groupBy("doc_id").agg(*ends)
    for c in categories:
        once = once.filter(F.col(f"a_{c}") == F.col(f"b_{c}"))
    picked = once.select("doc_id", *[F.col(f"a_{c}").cast("double").alias(f"y_{c}") for c in categories])
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # ``most`` rows of a few numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("h", F.xxhash64("text"))
    ys = [f"y_{c}" for c in categories]

    def run(batch: dict) -> dict:
        return {"h": batch["h"], **{y: batch[y] for y in ys}, "words": [features(t) for t in batch["text"].to_pylist()]}

    schema = "h long, " + ", ".join(f"{y} double" for y in ys) + ", words array<string>"
    found = arrow_map(rows.select("h", *ys, "text"), run, schema)
    return stored(found.groupBy("h").agg(*[F.min(y).alias(y) for y in ys], F.first("words").alias("words")))


def _telling_stems(rows: DataFrame, categories: tuple[str, ...]) -> list[str]:
    """The stems whose share of labelled texts deviates most from a category's own, ``FEATURES`` per category."""
    ys = [f"y_{c}" for c in categories]
    shares = rows.agg(*[F.avg(y).alias(y) for y in ys]).first()
    counts = rows.select(*ys, F.explode("words").alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys])
    counts = stored(counts.filter(F.col("n") >= MIN_TEXTS))
    found: set[str] = set()
    for y in ys:
        p = shares[y]
        if 0.0 < p < 1.0:
            z = F.abs(F.col(y) - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
            found |= {r["stem"] for r in counts.orderBy(z.desc(), "stem").limit(FEATURES).collect()}
    return sorted(found)


def _fit(rows: DataFrame, label: str) -> tuple[float, np.ndarray]:
    """Bias and coefficients; a constant if there is one class only."""
    n, positive = rows.agg(F.count(F.lit(1)), F.sum(label)).first()
    positive = positive or 0.0
    if positive in (0.0, float(n)):
        return math.log((positive + 1.0) / (n - positive + 1.0)), np.zeros(0)
    lr = LogisticRegression(labelCol=label, featuresCol="x", maxIter=STEPS, regParam=REGULARISATION, elasticNetParam=1.0, tol=1e-4)
    # The sample is bounded: a step of the optimiser is a job, and two tasks make it a short one.
    model = lr.fit(rows.select(label, "x").coalesce(FIT_TASKS))
    return float(model.intercept), model.coefficients.toArray()


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, most: int = MOST_LABELLED) -> list[Model]:
    """One model per category; none without labelled rows."""
    rows = _labelled(docs, labels, categories, most)
    if rows.limit(1).count() == 0:
        return []
    words = _telling_stems(rows, categories)
    if words:
        vectors = CountVectorizerModel.from_vocabulary(words, inputCol="words", outputCol="vector").setBinary(True)
        rows = vectors.transform(rows)
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("h"), F.lit(FOLDS)))
    chain: list[Model] = []
    earlier: list[str] = []
    for i, c in enumerate(categories):
        inputs = (["vector"] if words else []) + earlier
        if inputs:
            rows = VectorAssembler(inputCols=inputs, outputCol="x").transform(rows)
        bias, weights = _fit(rows, f"y_{c}") if inputs else (_fit(rows.withColumn("x", F.lit(None)), f"y_{c}")[0], np.zeros(0))
        own = {w: float(x) for w, x in zip(words, weights, strict=False) if x}
        chain.append(Model(bias, own, [float(x) for x in weights[len(words) :]] if len(weights) else []))
        if i + 1 < len(categories) and inputs:
            rows = stored(_out_of_fold(rows, f"y_{c}", f"p_{c}").drop("x"))
            earlier.append(f"p_{c}")
    return chain


def _out_of_fold(rows: DataFrame, label: str, name: str) -> DataFrame:
    """``rows`` with the probability that a model of the other folds gives."""
    parts = []
    for fold in range(FOLDS):
        bias, weights = _fit(rows.filter(F.col("fold") != fold), label)
        kept = np.nonzero(weights)[0]
        at = F.array(*[F.lit(int(k)) for k in kept]) if len(kept) else None
        z = F.lit(bias)
        if at is not None:
            x = vector_to_array("x")
            by = F.zip_with(at, F.array(*[F.lit(float(weights[k])) for k in kept]), lambda k, w: F.get(x, k) * w)
            z = z + F.aggregate(by, F.lit(0.0), lambda a, b: a + b)
        parts.append(rows.filter(F.col("fold") == fold).withColumn(name, 1.0 / (1.0 + F.exp(-z))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scores(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """doc_id, p_<category> of each category, and ``toxic``: the last one's at or above ``THRESHOLD``."""
    chain = fit_chain(docs, labels, categories)
    names = [f"p_{c}" for c in categories]

    def run(batch: dict) -> dict:
        found = [chain_scores(chain, t) if chain else [None] * len(names) for t in batch["text"].to_pylist()]
        columns = dict(zip(names, zip(*found, strict=True), strict=True))
        return {"doc_id": batch["doc_id"], **columns, "toxic": [p is not None and p >= THRESHOLD for p in columns[names[-1]]]}

    schema = "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean"
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
