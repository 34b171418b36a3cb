"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector over hashed features is shared by all grades; ordered thresholds part the
grades: P(grade >= g) = logistic(score - threshold[g]). The expected grade is the sum of
these tail probabilities, and a document is kept if P(grade >= top) is at least CUT.

Features are present or not: each distinct word in lower case without outer marks, its first
four and five letters, and coarse rates of marks, capitals and immediate repeats. The model
is fitted on at most ``most_rows`` rated documents, those first by a hash of their id, and
applied to every whole text. Weights are evidence against a text, never above 0, so that good
words cannot make up for bad ones, however long the text; features that do not go with lower
grades in the sample (by SPREAD standard deviations) have weight 0.

The grade of ``labels`` is how many of its two checks a document passes: quality above 0, and
not toxic. Defined cases: a null or
wordless text has grade 0 and tail 0 and is not kept; ratings with a null are not used, and of
several for one document the lowest counts; without any rating the scores are null and all
documents are kept; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import give_back
from .common import table

BITS, MOST_ROWS, CUT, SEEN, SPREAD, DECAY, STEPS = 32, 8000, 0.8, 3, 4.5, 1e-5, 1000
MARKS = "#*$%&|<>!=_~^@+/\\{}[]"
_OUTER = ".,;:!?\"'()«»…#*$%&|<>=_~^@+/\\{}[]-"
TOP = 2


def _slot(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


class Features:
    """Hashed features of texts; the slots of known words are remembered up to a bound.

    With a model's ``slots``, features are its places in that sorted array, and others are left out.
    """

    LIMIT = 200_000

    def __init__(self, slots: np.ndarray | None = None):
        self.known: dict[str, int] = {}
        self.places = None if slots is None else {s: i for i, s in enumerate(slots.tolist())}
        self.slots = np.zeros((self.LIMIT, 3), np.int64)

    def _feature(self, name: str) -> int:
        return _slot(name) if self.places is None else self.places.get(_slot(name), -1)

    def _place(self, word: str) -> int:
        at = self.known[word] = len(self.known)
        bare = word.strip(_OUTER).lower()
        self.slots[at] = self._feature("w " + bare), self._feature("4 " + bare[:4]), self._feature("5 " + bare[:5])
        return at

    def of(self, text: str | None) -> np.ndarray | None:
        """Sorted distinct features; None for a text without words."""
        words = text.split() if text else []
        if not words:
            return None
        rates = [(f"m {c}", text.count(c) / len(words)) for c in MARKS if c in text]
        rates.append(("up", sum(map(str.isupper, words)) / len(words)))
        rates.append(("twice", sum(map(operator.eq, words, words[1:])) / len(words)))
        shapes = [self._feature(f"{name} {min(9, int(10 * rate))}") for name, rate in rates if rate > 0.02]
        distinct, parts = list(set(words)), [np.array(shapes, np.int64)]
        for i in range(0, len(distinct), self.LIMIT // 4):  # a clearing in between must not move slots that are being read
            some = distinct[i : i + self.LIMIT // 4]
            if len(self.known) + len(some) > self.LIMIT:
                self.known.clear()
            get, place = self.known.get, self._place
            at = np.fromiter((place(w) if (k := get(w)) is None else k for w in some), np.int64, len(some))
            parts.append(self.slots[at].ravel())
        found = np.unique(np.concatenate(parts))
        return found[found >= 0] if self.places is not None else found


def logistic(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def telling(flat: np.ndarray, whose: np.ndarray, grades: np.ndarray, n_grades: int, n: int) -> np.ndarray:
    """Features whose documents reach some grade less often than all do, by SPREAD standard deviations."""
    seen = np.bincount(flat, minlength=n)
    told = np.zeros(n, bool)
    for g in range(1, n_grades):
        off = (grades >= g) - (grades >= g).mean()
        told |= -np.bincount(flat, off[whose], minlength=n) >= SPREAD * np.sqrt(seen * max(off.var(), 1e-12))
    return told & (seen >= SEEN)


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = TOP + 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, their weights, and thresholds of the penalised likelihood, by full-batch gradient steps with moments."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i].tobytes(), int(grades[i])))  # the result must not depend on the rows' order
    rows, grades = [rows[i] for i in order], np.asarray(grades)[order]
    slots, flat = np.unique(np.concatenate(rows), return_inverse=True)
    whose = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    told = telling(flat, whose, grades, n_grades, len(slots))
    flat, whose = (np.cumsum(told) - 1)[flat[told[flat]]], whose[told[flat]]
    slots, n = slots[told], int(told.sum())
    weights, cuts = np.zeros(n), np.array([-4.0, *np.full(n_grades - 2, 2.0)])  # the first threshold, and the gaps' logarithms
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, cuts)]
    for step in range(1, STEPS + 1):
        score = np.bincount(whose, weights[flat], minlength=len(rows))
        gaps = np.exp(cuts[1:])
        at = cuts[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        tail = logistic(score[:, None] - at[None, :])
        # P(grade) = tail[grade] - tail[grade + 1]
        full = np.concatenate([np.ones((len(rows), 1)), tail, np.zeros((len(rows), 1))], axis=1)
        i = np.arange(len(rows))
        p = np.maximum(full[i, grades] - full[i, grades + 1], 1e-12)
        slope = full * (1 - full)
        by_score = (slope[i, grades] - slope[i, grades + 1]) / p
        by_tail = np.zeros((len(rows), n_grades + 1))
        by_tail[i, grades] += slope[i, grades] / p
        by_tail[i, grades + 1] -= slope[i, grades + 1] / p
        by_at = -by_tail[:, 1:-1].sum(axis=0)
        grads = (
            np.bincount(flat, by_score[whose], minlength=n) / len(rows) - DECAY * weights,
            np.array([by_at.sum(), *(by_at[k:].sum() * gaps[k - 1] for k in range(1, n_grades - 1))]) / len(rows),
        )
        for x, g, m in zip((weights, cuts), grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x += 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        np.minimum(weights, 0, out=weights)
    return slots, weights, cuts[0] + np.concatenate([[0.0], np.cumsum(np.exp(cuts[1:]))])


def ratings(labels: DataFrame) -> DataFrame:
    """(id, grade) of the rated documents."""
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null")
    grade = (F.col("quality") > 0).cast("int") + (F.col("toxic") <= 0).cast("int")
    return rated.groupBy(F.col("doc_id").alias("id")).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, rated: DataFrame, most_rows: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The model of at most ``most_rows`` rated documents of ``docs`` (doc_id, text), fitted in one executor's task."""
    some = rated.orderBy(F.xxhash64("id"), "id").limit(most_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Features()
        for batch in batches:
            found = [maker.of(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([b"" if x is None else x.tobytes() for x in found], pa.binary()), batch.column(1)], names=["x", "grade"])

    def fitted(t: pa.Table) -> pa.Table:
        slots, weights, cuts = fit([np.frombuffer(x, np.int64) for x in t.column("x").to_pylist()], np.array(t.column("grade").to_pylist(), np.int64))
        return pa.table({"slots": pa.array([slots.tobytes()], pa.binary()), "weights": pa.array([weights.tobytes()], pa.binary()), "cuts": pa.array([cuts.tobytes()], pa.binary())})

    rows = docs.join(F.broadcast(some), F.col("doc_id") == F.col("id")).where("text is not null").select("text", F.col("grade").cast("int").alias("grade"))
    model = rows.mapInArrow(features, "x binary, grade int").withColumn("one", F.lit(0)).groupBy("one").applyInArrow(fitted, "slots binary, weights binary, cuts binary").collect()
    return (np.frombuffer(model[0]["slots"], np.int64), np.frombuffer(model[0]["weights"]), np.frombuffer(model[0]["cuts"])) if model else None


def grade(docs: DataFrame, rated: DataFrame, doc_id: str = "doc_id", text: str = "text", most_rows: int = MOST_ROWS, cut: float = CUT) -> DataFrame:
    """One row a row of ``docs``: doc_id, expected_grade, tail_prob and kept."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = train(docs, rated, most_rows)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", none.alias("expected_grade"), none.alias("tail_prob"), F.lit(True).alias("kept"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # no more slots than the bounded sample has

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights, cuts = held.value
        maker = Features(slots)
        for batch in batches:
            found = [maker.of(x.as_py()) for x in batch.column(1)]
            score = np.array([-np.inf if x is None else float(weights[x].sum()) for x in found])
            tails = logistic(score[:, None] - cuts[None, :])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= cut)], names=["doc_id", "expected_grade", "tail_prob", "kept"])

    return docs.mapInArrow(scored, "doc_id long, expected_grade double, tail_prob double, kept boolean")


def selected(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is kept."""
    model = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rated)
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights, cuts = held.value
        maker = Features(slots)
        for batch in batches:
            good = [x is not None and bool(logistic(weights[x].sum() - cuts[-1]) >= CUT) for x in (maker.of(v.as_py()) for v in batch.column(at))]
            yield batch.filter(pa.array(good, pa.bool_()))
        del maker
        give_back()

    return docs.mapInArrow(kept, docs.schema)


def op2_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    return grade(table(spark, sf_dir, "documents"), ratings(table(spark, sf_dir, "labels")))
