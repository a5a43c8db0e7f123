"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are a text's distinct words (letters, lower case) and the words' beginnings of three to five letters, hashed
to 31 bits. The model is P(grade <= k) = sigmoid(theta_k - w.x): all ordered thresholds share the weights w, so a
text's expected severity is one number between 0 and the highest grade.

Fitting takes a bounded sample, SAMPLE labelled rows a class chosen by the digest of their ids, and weighs the classes
back to their shares of all labels. Features enter if their likelihood ratio between the classes is beyond chance.
Where labels are only clean or toxic, the toxic sample is graded by how many distinct words carry such features:
from GRADE_TWO on it is severe (2), else mild (1). The fit is convex but for the order of the thresholds and runs on
the driver in bounded memory; scoring is one map over rows with a broadcast model of at most FEATURES weights.

Cases: a null text has no features; null labels are ignored, and of several labels for a document the highest counts;
without labels of both kinds every text scores 0; rows that repeat a doc_id are scored each; texts are read whole, however long, each
feature counting once; of chances that tie the milder grade is taken; an empty table gives no rows. Other columns are passed by.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, lean, small_batches, text_or_empty, whole_row

SAMPLE = 1500  # labelled rows a class: the bound of the fit
FEATURES = 3000
GRADE_TWO = 3
LEAST_ROWS = 4  # labelled rows that must have a feature
BLOCK = 1 << 18  # features that the driver handles at once
LEAST_RATIO = 20.0  # twice the log likelihood ratio; chance exceeds it about once in 100,000 features
_WORDS = re.compile(r"[^\W\d_]+").findall


def word_features(word: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(x.encode()) & 0x7FFFFFFF for x in (word, *(f"{word[:k]}*" for k in (3, 4, 5) if len(word) > k)))


_FEATURES = Memo(word_features)


@dataclass
class OrdinalModel:
    """Weights by feature; thresholds[k] separates grades up to k from those above."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def grade_chances(self, score: float) -> list[float]:
        if not self.thresholds:
            return [1.0]
        up_to = [1 / (1 + np.exp(score - t)) for t in self.thresholds] + [1.0]
        return [b - a for a, b in zip([0.0, *up_to], up_to, strict=False)]


def fit_ordinal(row: np.ndarray, col: np.ndarray, m: int, y: np.ndarray, weight: np.ndarray, grades: int,
                l2: float = 2e-4, steps: int = 400):
    """Accelerated gradient steps for the cumulative-link likelihood; returns (w, thresholds).

    Text row[i] has feature col[i] of m; y are the texts' grades.
    """
    n = len(y)
    weight = weight / weight.sum()
    base = np.array([np.clip(weight[y <= k].sum(), 1e-4, 1 - 1e-4) for k in range(grades - 1)])
    cuts = np.log(base / (1 - base))
    # parameters: w, the first threshold, logarithms of the gaps between thresholds
    p = np.concatenate([np.zeros(m), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])

    def loss_and_slope(p):
        w, theta = p[:m], p[m] + np.concatenate([[0.0], np.cumsum(np.exp(p[m + 1 :]))])
        low = np.concatenate([[-40.0], theta])[y]
        high = np.concatenate([theta, [40.0]])[y]
        s = np.bincount(row, weights=w[col], minlength=n)
        a, b = 1 / (1 + np.exp(np.clip(s - high, -40, 40))), 1 / (1 + np.exp(np.clip(s - low, -40, 40)))
        chance = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a), b * (1 - b)
        slope = np.zeros_like(p)
        slope[:m] = np.bincount(col, weights=(weight * (da - db) / chance)[row], minlength=m) + l2 * w
        to = np.zeros(grades - 1)
        for k in range(grades - 1):  # from grades that end at threshold k and grades that begin there
            to[k] = -(weight * da / chance)[y == k].sum() + (weight * db / chance)[y == k + 1].sum()
        slope[m] = to.sum()
        slope[m + 1 :] = [to[k:].sum() * np.exp(p[m + k]) for k in range(1, grades - 1)]
        return -(weight * np.log(chance)).sum() + l2 / 2 * (w @ w), slope

    rate, ahead, t = 1.0, p.copy(), 1.0
    for _ in range(steps):
        loss, slope = loss_and_slope(ahead)
        while True:
            new = ahead - rate * slope
            if loss_and_slope(new)[0] <= loss - rate / 2 * (slope @ slope) or rate < 1e-6:
                break
            rate /= 2
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - p)
        if slope @ (new - p) > 0:  # overshot: start the momentum anew
            ahead, t_new = new.copy(), 1.0
        p, t, rate = new, t_new, rate * 1.3
    return p[:m], (p[m] + np.concatenate([[0.0], np.cumsum(np.exp(p[m + 1 :]))])).tolist()


def likelihood_ratios(has: np.ndarray, has_toxic: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """Twice the log likelihood ratio of each feature between the classes, signed by its direction."""
    def part(k, total, rate):
        rate = np.clip(rate, 1e-9, 1 - 1e-9)
        return k * np.log(rate) + (total - k) * np.log(1 - rate)

    clean, n_clean = has - has_toxic, n - n_toxic
    gain = (part(has_toxic, n_toxic, has_toxic / n_toxic) + part(clean, n_clean, clean / n_clean)
            - part(has_toxic, n_toxic, has / n) - part(clean, n_clean, has / n))
    return 2 * gain * np.sign(has_toxic / n_toxic - clean / n_clean)


def _sample(docs: DataFrame, labels: DataFrame, label: str) -> tuple[pa.Table | None, dict[int, int]]:
    """The sampled documents' label, features word after word and features a word; how many documents have each label."""
    small_batches(docs.sparkSession)
    each = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    shares = {r["label"]: r["count"] for r in each.groupBy("label").count().collect()}
    ids = None
    for k in shares:
        part = each.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        ids = part if ids is None else ids.union(part)
    if ids is None:
        return None, shares
    # at most SAMPLE ids a class: the bound of this broadcast
    chosen = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [[_FEATURES[w] for w in sorted(set(_WORDS(x.lower())))] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"),
                 pa.array([[f for w in ws for f in w] for ws in words], pa.list_(pa.int32())),
                 pa.array([[len(w) for w in ws] for ws in words], pa.list_(pa.int32()))],
                ["doc_id", "label", "features", "sizes"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = chosen.select("doc_id", "label", "text").mapInArrow(
        lean(run), f"doc_id {kind}, label int, features array<int>, sizes array<int>")
    return rows.toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")]).combine_chunks(), shares


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and each list's length."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())


def _by_block(n: int, kind, of) -> np.ndarray:
    """of(slice) for all slices of n, end to end, without large values in between."""
    out = np.empty(n, kind)
    for at in range(0, n, BLOCK):
        out[at : at + BLOCK] = of(slice(at, at + BLOCK))
    return out


def _counts(places: np.ndarray, n: int, chosen=lambda part: slice(None)) -> np.ndarray:
    """How often each place below n occurs among the chosen ones."""
    return sum((np.bincount(places[at : at + BLOCK][chosen(slice(at, at + BLOCK))], minlength=n) for at in range(0, len(places), BLOCK)),
               np.zeros(n, np.int64))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> OrdinalModel:
    """Fit on documents that labels (doc_id, label) covers; labels above 1 are taken as grades as they are."""
    table, shares = _sample(docs, labels, label)
    y = labelled = np.array(table["label"] if table else [], np.int64)
    if not (y > 0).any() or not (y == 0).any():
        return OrdinalModel()
    feature, _ = _flat(table["features"])
    size, words = _flat(table["sizes"])
    per_text = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(words)])]
    # distinct features of each text, one text at a time, so that the driver holds few arrays of all features
    own = [np.unique(feature[a:b]) for a, b in zip(per_text, per_text[1:], strict=False)]
    rows_of = np.repeat(np.arange(len(y), dtype=np.int32), [len(x) for x in own])
    features = np.concatenate(own)
    del own
    names = np.unique(features)
    back = _by_block(len(features), np.int32, lambda part: np.searchsorted(names, features[part]))
    del features
    toxic = y > 0
    has, has_toxic = _counts(back, len(names)), _counts(back, len(names), lambda part: toxic[rows_of[part]])
    ratio = likelihood_ratios(has, has_toxic, len(y), int((y > 0).sum()))
    ratio[has < LEAST_ROWS] = 0
    chosen = np.flatnonzero(np.abs(ratio) >= LEAST_RATIO)
    chosen = chosen[np.argsort(-np.abs(ratio[chosen]), kind="stable")][:FEATURES]
    place = np.full(len(names), -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    at = place[back]
    held = at >= 0
    row, col = rows_of[held], at[held]
    del back, rows_of, at, held
    if set(shares) <= {0, 1}:
        toxic_names = names[chosen[ratio[chosen] > 0]]
        word = np.repeat(np.arange(len(size), dtype=np.int32), size)
        hits = np.unique(word[_by_block(len(feature), bool, lambda part: np.isin(feature[part], toxic_names))])
        hits = np.bincount(np.repeat(np.arange(len(y)), words)[hits], minlength=len(y))
        y = np.where(y > 0, 1 + (hits >= GRADE_TWO), 0)
    grades = sorted(set(y.tolist()))
    y = np.searchsorted(grades, y)
    weight = np.array([shares[k] / max(1, (labelled == k).sum()) for k in labelled])
    del table, feature
    pa.default_memory_pool().release_unused()
    w, thresholds = fit_ordinal(row, col, len(chosen), y, weight, len(grades))
    return OrdinalModel({int(f): float(v) for f, v in zip(names[chosen], w, strict=True)}, thresholds)


def score(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, expected_severity, grade, p_toxic, toxic, kept): grade is the likeliest, toxic if P(grade > 0) >= threshold."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = model.weights
        of_word = Memo(lambda word: tuple(f for f in word_features(word) if f in weights))
        for batch in batches:
            chances = []
            for text in batch.column("text").to_pylist():
                hits = {f for word in set(_WORDS(text.lower())) for f in of_word[word]}
                chances.append(model.grade_chances(sum(weights[f] for f in sorted(hits))))
            p = np.array(chances).reshape(len(chances), -1)
            toxic = 1 - p[:, 0] >= threshold
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p @ np.arange(p.shape[1], dtype=float)), pa.array(p.argmax(axis=1).astype(np.int32)),
                 pa.array(1 - p[:, 0]), pa.array(toxic), pa.array(~toxic)],
                ["doc_id", "expected_severity", "grade", "p_toxic", "toxic", "kept"])

    schema = T.StructType([docs.schema["doc_id"]])
    for name, kind in (("expected_severity", T.DoubleType()), ("grade", T.IntegerType()), ("p_toxic", T.DoubleType()),
                       ("toxic", T.BooleanType()), ("kept", T.BooleanType())):
        schema.add(name, kind)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(lean(run), schema)


def keep_clean(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score rejects; whole rows pass through the scoring map, so nothing is joined."""
    whole = docs.select(whole_row(docs).alias("doc_id"), "text")
    return score(whole, model, threshold).where("kept").select("doc_id.*")
