"""Quality classifier: Naive Bayes support vectors.

Indicators of n-grams, scaled by the log ratio of their class counts, feed a linear hinge-loss model fitted by dual
coordinate descent.  N-grams are of words (one and two) and of word shapes (one and two; a word equal to the one
before has a shape of its own), so that markup, shouting and repetition count whatever the words.

The model is fitted in one task on a sample bounded by ``MAX_PER_CLASS`` labelled documents of at most ``MAX_CHARS``
characters; scoring reads all documents and whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .toxicity import sample

MAX_PER_CLASS = 3_000
MAX_CHARS = 50_000
RUNS = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """Upper case X, lower case x, digits 9, other characters as they are; runs as one; at most eight signs."""
    signs = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word[:32])
    return "~" + RUNS.sub(r"\1", signs)[:8]


class Grams:
    """The distinct n-grams of a text; with ``wanted``, word pairs only where one of these begins like it."""

    def __init__(self, wanted: set[str] | None = None, limit: int = 200_000):
        self.shapes: dict[str, str] = {}
        self.limit = limit
        self.heads = None if wanted is None else {g.split(" ")[0] for g in wanted if " " in g and g[0] != "~"}

    def __call__(self, text: str) -> set[str]:
        words = text.split()
        known = self.shapes
        if len(known) > self.limit:
            known.clear()
        shapes, before = [], None
        for w in words:
            if w == before:
                shapes.append("~=")
            else:
                s = known.get(w)
                if s is None:
                    s = known[w] = shape(w)
                shapes.append(s)
            before = w
        lower = text.lower().split()
        grams = set(lower)
        heads = self.heads
        grams.update([a + " " + b for a, b in zip(lower, lower[1:]) if heads is None or a in heads])
        grams.update(shapes)
        grams.update([a + " " + b for a, b in set(zip(shapes, shapes[1:]))])
        return grams


def log_count_ratios(counts: list[Counter], min_docs: int, alpha: float = 1.0) -> dict[str, float]:
    """log((p / |p|) / (q / |q|)) with p, q the smoothed document counts of the n-gram in either class."""
    grams = sorted(g for g in counts[0].keys() | counts[1].keys() if counts[0][g] + counts[1][g] >= min_docs)
    q, p = (np.array([c[g] for g in grams], float) + alpha for c in counts)
    r = np.log(p / p.sum()) - np.log(q / q.sum()) if grams else np.zeros(0)
    return dict(zip(grams, r.tolist()))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n: int, cost: np.ndarray,
                            epochs: int = 20, seed: int = 7) -> np.ndarray:
    """Weights of the L2-regularised hinge loss; ``rows`` are sparse (index, value), ``y`` is -1 or 1."""
    w, a = np.zeros(n), np.zeros(len(rows))
    norm = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            index, value = rows[i]
            if norm[i] == 0:
                continue
            g = y[i] * float(w[index] @ value) - 1
            new = min(max(a[i] - g / norm[i], 0.0), cost[i])
            if new != a[i]:
                w[index] += (new - a[i]) * y[i] * value
                moved = max(moved, abs(new - a[i]) / cost[i])
                a[i] = new
        if moved < 1e-3:
            break
    return w


def fit(texts: list[str], y: np.ndarray, min_docs: int = 4, cost: float = 1.0) -> dict[str, float]:
    """Weight by n-gram (ratio times weight), ``""`` the bias and ``"\\n"`` the scale of the margin."""
    grams, bags = Grams(), []
    counts = [Counter(), Counter()]
    for text, k in zip(texts, y):
        bag = grams(text)
        bags.append(bag)
        counts[k].update(bag)
    ratio = log_count_ratios(counts, min_docs)
    names = list(ratio)
    number = {g: k for k, g in enumerate(names)}
    r = np.array([ratio[g] for g in names] + [1.0])  # last: the bias, as an indicator of every document
    rows = []
    for bag in bags:
        index = np.array(sorted(number[g] for g in bag if g in number) + [len(names)], np.int64)
        value = r[index] / max(1.0, np.sqrt(len(index)))  # documents of any length weigh alike
        rows.append((index, value))
    sign = np.where(y == 1, 1.0, -1.0)
    share = cost * len(y) / 2 / np.where(y == 1, max(1, (y == 1).sum()), max(1, (y == 0).sum()))
    w = dual_coordinate_descent(rows, sign, len(r), share)
    margins = np.array([float(w[i] @ v) for i, v in rows])
    scale = 2.0 / max(1e-9, np.median(np.abs(margins))) if len(margins) else 1.0
    model = {g: float(w[k] * r[k]) for g, k in number.items() if abs(w[k] * r[k]) > 1e-9}
    return model | {"": float(w[-1]), "\n": float(scale)}


def train(docs: DataFrame, labels: DataFrame, label: str, train_rows: Column) -> dict[str, float]:
    """Fit on the bounded sample in one executor task; the weights, bounded by its n-grams, come to the driver.

    Without labels every document scores 0.5; with one class all go to that class.
    """
    rows = sample(docs, labels, label, train_rows, MAX_PER_CLASS, MAX_CHARS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "y": []}), *batches]).sort_values(["doc_id", "text"])
        model = fit(rows["text"].tolist(), rows["y"].to_numpy(int)) if len(rows) else {"": 0.0, "\n": 1.0}
        yield pd.DataFrame({"feature": list(model), "weight": list(model.values())})

    model = {r.feature: r.weight for r in rows.repartition(1).mapInPandas(run, "feature string, weight double").collect()}
    return model or {"": 0.0, "\n": 1.0}  # no row, no task


def margin(model: dict[str, float], bag: set[str], known: set[str]) -> float:
    hit = bag & known
    return (sum(map(model.__getitem__, hit)) + model[""]) / max(1.0, np.sqrt(len(hit) + 1)) * model["\n"]


def score(docs: DataFrame, model: dict[str, float]) -> DataFrame:
    """``doc_id, score`` per input row: logistic of the margin, 0.5 at the separating plane.

    Null texts are empty and score by the bias alone.  Ids may repeat or be null; other columns are not read; an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = set(model) - {"", "\n"}
        grams = Grams(known)
        for batch in batches:
            m = np.array([margin(model, grams(t), known) for t in batch["text"]], float)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": 1 / (1 + np.exp(-np.clip(m, -30, 30)))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty().alias("text")).mapInPandas(run, "doc_id long, score double")
