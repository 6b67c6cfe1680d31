"""Toxicity by multiple-instance learning: sentences are instances, documents carry the labels.

A sentence's score is logistic in the weights of its words and word beginnings; a document's is the noisy-or of its
sentences, 1 - prod(1 - p).  Only document labels are known, and the gradient of the document's likelihood tells each
sentence its share.  The fitted sentence scores then locate the offending sentences.

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

#: Bounds of the training sample: documents per class and characters of one document.
MAX_PER_CLASS = 3_000
MAX_CHARS = 50_000
#: Word weights a worker remembers before it starts anew.
REMEMBERED = 300_000
SENTENCE = re.compile(r"[.!?\n]+")
BEGINNINGS = (4, 5, 6)
MIN_WORDS = 8


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, max_chars: int) -> DataFrame:
    """``(doc_id, text, y)``: the first ``per_class`` labelled training documents of each class by hash of the id.

    One row per id, the least text where an id has several, and then ``per_class`` of each class: no more reach the
    fitting task, however often an id is repeated.  Ids with both labels are left out.
    """
    ids = labels.where(F.col(label).isin(0, 1) & train).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    ids = ids.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty().alias("text")).where(F.length("text") <= max_chars)
    order = F.xxhash64("doc_id")
    # a little more than needed, as some labelled ids have no document within the bound
    chosen = [ids.where(f"y = {k}").orderBy(order).limit(per_class + per_class // 4) for k in (0, 1)]
    rows = texts.join(F.broadcast(C.written(chosen[0].unionByName(chosen[1]), "sample-ids")), "doc_id")
    rows = C.written(rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "sample-texts")
    both = [rows.where(f"y = {k}").orderBy(order).limit(per_class) for k in (0, 1)]
    return both[0].unionByName(both[1]).select("doc_id", "text", "y")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence; one of fewer than ``MIN_WORDS`` words is joined with what follows."""
    out, start = [], 0
    for m in [*SENTENCE.finditer(text), None]:
        end = m.start() if m else len(text)
        if m is None or len(text[start:end].split(None, MIN_WORDS)) >= MIN_WORDS:
            if text[start:end].strip():
                out.append((start, end))
            start = m.end() if m else end
    return out


def features(word: str) -> list[str]:
    """The word itself and its first letters, which inflected forms share."""
    bare = word.strip(",;:!.?\"'()")
    return [bare, *(f"{bare[:n]}-" for n in BEGINNINGS if len(bare) > n)]


def telling(clean: Counter, toxic: Counter, n_clean: int, n_toxic: int, min_docs: int, deviations: float) -> list[str]:
    """Features whose share of documents differs between the classes by so many standard deviations of chance."""
    out = []
    for f in sorted(clean.keys() | toxic.keys()):
        a, b = clean[f], toxic[f]
        p = (a + b) / (n_clean + n_toxic)
        if a + b >= min_docs and n_clean and n_toxic and p < 1:
            spread = (p * (1 - p) * (1 / n_clean + 1 / n_toxic)) ** 0.5
            if abs(b / n_toxic - a / n_clean) >= deviations * spread:
                out.append(f)
    return out


def fit(texts: list[str], y: np.ndarray, min_docs: int = 3, deviations: float = 4.0, steps: int = 200, rate: float = 1.0) -> dict[str, float]:
    """Weights by feature, ``""`` being the bias: Adagrad on the noisy-or likelihood, classes weighed equally."""
    split, seen = [], (Counter(), Counter())
    for t, label in zip(texts, y):
        t = t.lower()
        doc = [t[a:b].split() for a, b in sentences(t)]
        split.append(doc)
        seen[label].update({f for words in doc for w in set(words) for f in features(w)})
    number = {f: k for k, f in enumerate(telling(*seen, int((y == 0).sum()), int((y == 1).sum()), min_docs, deviations))}
    known: dict[str, list[int]] = {}
    index, per_sentence, per_doc = [], [], []
    for doc in split:
        per_doc.append(len(doc))
        for words in doc:
            n = len(index)
            for w in words:
                if w not in known:
                    known[w] = [number[f] for f in features(w) if f in number]
                index += known[w]
            per_sentence.append(len(index) - n)
    index = np.array(index, np.int32)
    sentence_of = np.repeat(np.arange(len(per_sentence)), per_sentence)
    doc_of = np.repeat(np.arange(len(per_doc)), per_doc)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(len(number)), -5.0
    gw, gb = np.full(len(number), 1e-12), 1e-12
    for _ in range(steps):
        s = np.bincount(sentence_of, w[index], len(per_sentence)) + b
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        log_none = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(per_doc))
        any_ = -np.expm1(log_none)
        # d loss / d s: p for documents labelled 0, -(1 - P) / P * p for those labelled 1
        pull = np.where(y == 1, -np.exp(log_none) / np.maximum(any_, 1e-9), 1.0) * share
        g = pull[doc_of] * p
        dw = np.bincount(index, g[sentence_of], len(number))
        db = g.sum()
        gw += dw * dw
        gb += db * db
        w -= rate * dw / np.sqrt(gw)
        b -= rate * db / np.sqrt(gb)
    heavy = {f: float(w[k]) for f, k in number.items() if abs(w[k]) > 1e-3}
    return heavy | {"": float(b)}


def train(docs: DataFrame, labels: DataFrame, label: str, train_rows: Column) -> dict[str, float]:
    """Fit on the bounded sample in one executor task; the weights, bounded by its words, come to the driver.

    Without labels the model is its bias alone; with one class no feature can tell, and the bias follows that class.
    """
    rows = sample(docs, labels, label, train_rows, MAX_PER_CLASS, MAX_CHARS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "y": []}), *batches]).sort_values(["doc_id", "text"])
        model = fit(rows["text"].tolist(), rows["y"].to_numpy(int)) if len(rows) else {"": -5.0}
        yield pd.DataFrame({"feature": list(model), "weight": list(model.values())})

    model = {r.feature: r.weight for r in rows.repartition(1).mapInPandas(run, "feature string, weight double").collect()}
    return model or {"": -5.0}  # no row, no task


class Scorer:
    def __init__(self, model: dict[str, float]):
        self.model, self.bias, self.known = model, model[""], {}

    def weight(self, word: str) -> float:
        if word not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = sum(self.model.get(f, 0.0) for f in features(word) if f)
        return self.known[word]

    def sentence_scores(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        spans = sentences(text)
        parts = [text[a:b].lower().split() for a, b in spans]
        s = np.array([sum(map(self.weight, words)) for words in parts]) + self.bias
        return spans, 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def score(docs: DataFrame, model: dict[str, float]) -> DataFrame:
    """One row per input row: ``doc_id, score, n_sentences, n_toxic, worst_start, worst_end``.

    ``score`` is the noisy-or over all sentences of the whole text, ``n_toxic`` counts those with 0.5 or more, and the
    worst sentence is given in code points (null without sentences).  Null and empty texts have no sentence and score 0.
    Ids may repeat or be null; other columns are not read; an empty table gives an empty result.
    """
    kind = "doc_id long, score double, n_sentences int, n_toxic int, worst_start long, worst_end long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                spans, p = scorer.sentence_scores(text)
                worst = spans[int(p.argmax())] if spans else (None, None)
                rows.append((float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())), len(spans), int((p >= 0.5).sum()), *worst))
            out = pd.DataFrame(rows, columns=["score", "n_sentences", "n_toxic", "worst_start", "worst_end"])
            out = out.astype({"worst_start": "Int64", "worst_end": "Int64"})
            yield pd.concat([batch["doc_id"].astype("Int64").reset_index(drop=True), out], axis=1)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty().alias("text")).mapInPandas(run, kind)


def offending(docs: DataFrame, model: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """``doc_id, start, end, sentence, score`` of every sentence at or above ``threshold``.

    Null and empty texts have no sentence; repeated rows give their sentences again; ids may be null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            rows = [(d, a, b, text[a:b], float(x)) for d, text in zip(batch["doc_id"].astype("Int64"), batch["text"])
                    for (a, b), x in zip(*scorer.sentence_scores(text)) if x >= threshold]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "sentence", "score"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty().alias("text"))
    return rows.mapInPandas(run, "doc_id long, start long, end long, sentence string, score double")
