"""Toxicity by cumulative-link ordinal regression.

Grades are ordered, 0 (clean) upwards.  One weight vector is shared by all thresholds:
P(grade <= k) = sigmoid(theta_k - w.x), with theta rising.  Features are sparse: words, and
runs of four and five characters of words with their edges; those that tell toxic from clean
documents best (chi-square over documents) are kept, with value log(1 + count).  The output
is the expected severity, the sum over k of P(grade > k).

Labels are grades from 0.  Where none exceeds 1, a toxic document's grade is 1, 2 or 3 by how much of
the telling wording it holds, in thirds of the training documents (``grade_labels``): an ordering
made from the same features, no independent judgement.  Where labels exceed 1, they are the grades.

Defined results: null and empty texts have no features and get the model's severity for
none, grade 0; a text's severity depends on it alone, so repeated rows agree; without labels
of both kinds every severity is 0; an empty table gives an empty result.  Extra columns are
ignored by ``severity`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_columns

#: Bounds of the training sample: labelled documents of either class; features kept.
SAMPLE, FEATURES = 2_500, 400
#: Bytes of text that training collects at most on average, and of a training text.
SAMPLE_BYTES, LONGEST = 128 << 20, 1 << 20
#: Words whose features a worker keeps.
CACHE = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    edged = f"<{word}>"
    return [word, *(edged[i : i + 4] for i in range(len(edged) - 3)), *(edged[i : i + 5] for i in range(len(edged) - 4))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _counted(text: str | None, of_word: dict[str, tuple[int, ...]], index: dict[str, int]) -> Counter:
    words = _WORD.findall((text or "").lower())
    own: Counter = Counter()
    if len(of_word) > CACHE:
        of_word.clear()
    for w in words:
        ids = of_word.get(w)
        if ids is None:
            ids = of_word[w] = tuple(i for i in map(index.get, set(features_of(w))) if i is not None)
        if ids:
            own.update(ids)
    return own


def choose_features(texts: list[str], toxic: list[bool], most: int) -> list[str]:
    """The features with the largest chi-square among those more frequent in toxic texts, and a
    tenth of that number among the others."""
    seen, n = (Counter(), Counter()), Counter(toxic)
    for text, t in zip(texts, toxic, strict=True):
        words = set(_WORD.findall((text or "").lower()))
        seen[t].update({f for w in words for f in features_of(w)})
    scored = []
    for f in set(seen[0]) | set(seen[1]):
        a, b = seen[1][f], seen[0][f]
        if a + b < 4:
            continue
        c, d = n[True] - a, n[False] - b
        chi = (a * d - b * c) ** 2 * (a + b + c + d) / max(1, (a + b) * (c + d) * (a + c) * (b + d))
        scored.append((chi, f, a * n[False] > b * n[True]))
    scored.sort(key=lambda x: (-x[0], x[1]))
    return [f for _, f, up in scored if up][:most] + [f for _, f, up in scored if not up][: most // 10]


def grade_labels(counts: list[Counter], toxic: list[bool], telling: set[int]) -> np.ndarray:
    """Grades: 0, or 1 to 3 by thirds of the toxic texts' counts of telling features."""
    amount = np.array([sum(n for i, n in c.items() if i in telling) for c in counts], dtype=float)
    is_toxic = np.array(toxic)
    if not is_toxic.any():
        return np.zeros(len(counts), dtype=int)
    low, high = np.quantile(amount[is_toxic], [1 / 3, 2 / 3])
    return np.where(is_toxic, 1 + (amount > low) + (amount > high), 0)


def fit_ordinal(counts: list[Counter], grades: np.ndarray, n_features: int, steps: int = 300, rate: float = 0.1, penalty: float = 3e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds by Adam on the cumulative-link likelihood.  A document counts by the
    inverse square root of the number of clean or of toxic ones, between their natural share and equal
    shares: equal shares of four grades would make three quarters of the prior toxic, and doubtful texts
    with it.  The thresholds are a first one and positive steps (their logarithms)."""
    top = int(grades.max())
    rows = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    columns = np.fromiter((i for c in counts for i in c), dtype=np.int64, count=len(rows))
    values = np.log1p(np.fromiter((n for c in counts for n in c.values()), dtype=float, count=len(rows)))
    n_toxic = int((grades > 0).sum())
    weight = 1 / np.sqrt(np.where(grades > 0, n_toxic, len(grades) - n_toxic))
    weight /= weight.sum()
    x = np.zeros(n_features + top)
    x[n_features] = 1.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, theta = x[:n_features], x[n_features] + np.concatenate([[0], np.cumsum(np.exp(x[n_features + 1 :]))])
        score = np.bincount(rows, weights=values * w[columns], minlength=len(counts))
        cumulative = np.column_stack([np.zeros(len(score)), _sigmoid(theta[None, :] - score[:, None]), np.ones(len(score))])
        hi, lo = cumulative[np.arange(len(score)), grades + 1], cumulative[np.arange(len(score)), grades]
        chance = np.maximum(hi - lo, 1e-9)
        slope_hi, slope_lo = hi * (1 - hi) / chance * weight, lo * (1 - lo) / chance * weight
        by_score = slope_hi - slope_lo  # of the loss, by the score
        grad_theta = np.zeros(top)
        for k in range(top):
            grad_theta[k] = -slope_hi[grades == k].sum() + slope_lo[grades == k + 1].sum()
        g = np.zeros_like(x)
        g[:n_features] = np.bincount(columns, weights=values * by_score[rows], minlength=n_features) + penalty * w
        g[n_features] = grad_theta.sum()
        for k in range(1, top):
            g[n_features + k] = grad_theta[k:].sum() * np.exp(x[n_features + k])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:n_features], x[n_features] + np.concatenate([[0], np.cumsum(np.exp(x[n_features + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> dict:
    """A model from about ``sample`` labelled documents of either kind, clean or toxic, and SAMPLE_BYTES of
    text at most, chosen by a hash of their ids; texts longer than LONGEST are not in the sample.  Whole
    texts are collected.  A document labelled twice counts twice; labels under 0 are none."""
    empty = {"index": {}, "weights": [], "theta": []}
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("grade")).filter("grade >= 0 AND doc_id IS NOT NULL").withColumn("toxic", F.col("grade") > 0)
    counts = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}  # two rows
    if len(counts) < 2:
        return empty

    def chosen(share: dict) -> Column:
        within = lambda t: F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share[t] * (1 << 20)) + 1
        return (F.col("toxic") & within(True)) | (~F.col("toxic") & within(False))

    share = {t: min(1.0, sample / n) for t, n in counts.items()}
    some = F.broadcast(labels.filter(chosen(share)).limit(4 * sample))  # at most 4 * sample rows
    texts = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).join(some, "doc_id")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > SAMPLE_BYTES:
        texts = texts.filter(chosen({t: s * SAMPLE_BYTES / size for t, s in share.items()}))
    rows = texts.select("text", "grade").limit(8 * sample).collect()
    texts, grades = [r.text for r in rows], np.array([r.grade for r in rows], dtype=int)
    toxic = (grades > 0).tolist()
    if len(set(toxic)) < 2:
        return empty
    names = choose_features(texts, toxic, features)
    index = {f: i for i, f in enumerate(names)}
    of_word: dict[str, tuple[int, ...]] = {}
    counted = [_counted(t, of_word, index) for t in texts]
    if grades.max() == 1:
        clean: Counter = Counter()
        for c, t in zip(counted, toxic, strict=True):
            if not t:
                clean.update(c.keys())
        telling = {i for i in range(len(names)) if clean[i] <= 0.002 * toxic.count(False)}
        grades = grade_labels(counted, toxic, telling)
    weights, theta = fit_ordinal(counted, grades, len(names))
    return {"index": index, "weights": weights.tolist(), "theta": theta.tolist()}


class Scorer:
    def __init__(self, model: dict):
        self.index, self.weights, self.theta = model["index"], model["weights"], np.array(model["theta"])
        self.of_word: dict[str, tuple[int, ...]] = {}

    def severity(self, texts: list[str | None]) -> tuple[list[float], list[int]]:
        """Expected severities and likeliest grades."""
        if not len(self.theta):
            return [0.0] * len(texts), [0] * len(texts)
        w = self.weights
        scores = []
        for t in texts:
            own = _counted(t, self.of_word, self.index)
            scores.append(sum(w[i] * np.log1p(own[i]) for i in sorted(own)))
        above = 1 - _sigmoid(self.theta[None, :] - np.array(scores, dtype=float).reshape(-1, 1))
        return above.sum(axis=1).tolist(), (above >= 0.5).sum(axis=1).tolist()


def severity(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, severity, grade) of every text: the expected severity and the median grade."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: Iterator[dict]) -> Iterator[dict]:
        own = Scorer(shared.value)
        for c in columns:
            expected, grades = own.severity(c["text"])
            yield {"doc_id": c["doc_id"], "severity": expected, "grade": grades}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, severity double, grade int")


def keep_clean(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` whose median grade is 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(texts: list) -> list[bool]:
        own = decide.__dict__.get("own")
        if own is None:
            own = decide.__dict__["own"] = Scorer(shared.value)
        return [g == 0 for g in own.severity(texts)[1]]

    return keep_rows(docs, decide)
