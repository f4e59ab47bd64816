"""Toxicity: cumulative-link ordinal regression over sparse word and word-start features, one weight vector for all grade thresholds."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._batches import holds_cache, shared_folder, small_batches, written

TRAIN_ROWS = 20_000
FEATURES = 16_384
MIN_DOCUMENTS = 5
GRADES = 4
MIN_Z = 3.0
PENALTY = 1e-3
STEPS = 400
PREFIXES = (4, 5, 6, 7)

CACHED_WORDS = 300_000

_WORD = re.compile(r"[^\W_]+")


def terms_of(text: str, known: dict | None = None) -> Counter:
    """Counts of a text's words and of their beginnings (marked by a hyphen) by PREFIXES letters; with `known`, of its keys only."""
    words = Counter(_WORD.findall(text.lower()))
    out: Counter = Counter()
    for w, n in words.items():
        for term in (w, *[w[:k] + "-" for k in PREFIXES if len(w) > k]):
            if known is None or term in known:
                out[term] += n
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= k) = sigmoid(cuts[k] - sum of weights[word] * log(1 + count))."""

    weights: dict[str, float]
    cuts: tuple[float, ...]

    def severity(self, text: str | None) -> tuple[float, list[float]]:
        """(expected grade, probability of each grade) of a text."""
        w = self.weights
        score = sum(w[x] * np.log1p(n) for x, n in sorted(terms_of(text or "", w).items()))
        below = [*(1 / (1 + np.exp(-np.clip(c - score, -40, 40))) for c in self.cuts), 1.0]
        return float(sum(1 - p for p in below)), [float(b - a) for a, b in zip([0.0, *below], below, strict=False)]


class BatchScorer:
    """Scores many texts at once: a sparse matrix of log(1 + counts) times the weights; remembers which features a word has."""

    def __init__(self, model: OrdinalModel):
        self.place = {w: k for k, w in enumerate(model.weights)}
        self.weights, self.cuts = np.array([*model.weights.values()], float), np.array(model.cuts)
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, word: str) -> tuple[int, ...]:
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        own = tuple(self.place[t] for t in terms_of(word) if t in self.place)
        self.known[word] = own
        return own

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """One row of grade probabilities per text."""
        rows, cols, counts = [], [], []
        for r, text in enumerate(texts):
            for word, n in Counter(_WORD.findall((text or "").lower())).items():
                own = self.known.get(word)
                for k in self._learn(word) if own is None else own:
                    rows.append(r)
                    cols.append(k)
                    counts.append(n)
        size = max(len(self.weights), 1)
        cell, at = np.unique(np.array(rows, np.int64) * size + np.array(cols, np.int64), return_inverse=True)
        values = np.log1p(np.bincount(at, np.array(counts, float), minlength=len(cell)))
        score = np.bincount(cell // size, values * self.weights[cell % size], minlength=len(texts)) if len(cell) else np.zeros(len(texts))
        below = np.column_stack([_sigmoid(self.cuts[None, :] - score[:, None]), np.ones(len(texts))])
        return np.diff(below, axis=1, prepend=0.0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_cumulative_link(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, increasing cuts) by full-batch Adam; the cuts are a first one and positive gaps, so they stay in order."""
    n = len(grades)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / n, 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    p = np.concatenate([np.zeros(n_features), first[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, cut = p[:n_features], np.cumsum(np.concatenate([p[n_features : n_features + 1], np.exp(p[n_features + 1 :])]))
        score = np.bincount(rows, values * w[cols], minlength=n)
        upper = np.where(grades < n_grades - 1, _sigmoid(cut[np.minimum(grades, n_grades - 2)] - score), 1.0)
        lower = np.where(grades > 0, _sigmoid(cut[np.maximum(grades - 1, 0)] - score), 0.0)
        likely = np.maximum(upper - lower, 1e-12)
        up, low = upper * (1 - upper) / likely / n, lower * (1 - lower) / likely / n
        by_score = up - low  # d loss / d score
        g_cut = np.zeros(n_grades - 1)
        np.subtract.at(g_cut, grades[grades < n_grades - 1], up[grades < n_grades - 1])
        np.add.at(g_cut, grades[grades > 0] - 1, low[grades > 0])
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(cols, values * by_score[rows], minlength=n_features) + penalty * w, tail[:1], tail[1:] * np.exp(p[n_features + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:n_features], np.cumsum(np.concatenate([p[n_features : n_features + 1], np.exp(p[n_features + 1 :])]))


def weak_grades(toxic: np.ndarray, evidence: np.ndarray, n_grades: int) -> np.ndarray:
    """Grades from 0/1 labels: 0 for harmless rows; toxic rows by quantiles of their evidence, those without any grade 1."""
    grades = np.zeros(len(toxic), np.int64)
    told = (toxic == 1) & (evidence > 0)
    if told.any():
        edges = np.quantile(evidence[told], np.arange(1, n_grades - 1) / (n_grades - 1))
        grades[told] = 1 + np.searchsorted(edges, evidence[told], "left")
    grades[(toxic == 1) & ~told] = 1
    return grades


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, features: int = FEATURES, n_grades: int = GRADES) -> OrdinalModel:
    """Fit on at most train_rows labelled documents, those with the smallest hash of the id.

    The labels are 0/1, so the severity grades above 0 are weak ones: toxic rows fall into n_grades - 1 quantiles of
    their evidence, the log-odds of the features times log(1 + count); the log-odds come from the half of the rows that a
    row is not in. Features are the words and beginnings of words that at least MIN_DOCUMENTS of the rows have, and
    toxic or harmless ones more often by MIN_Z errors of the log-odds; of more than `features`, a bound for the driver,
    the surest. Rows with NULL text, id or label are left out. Without both kinds of rows the model has no weights and
    grades all texts alike.
    """
    marks = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(train_rows)
    train = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(marks), "id")  # at most train_rows rows of two numbers

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [terms_of(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array([sorted(c.items()) for c in counts], pa.map_(pa.string(), pa.int64()))], names=["id", "toxic", "bag"])

    bag = written(train.mapInArrow(bags, "id bigint, toxic int, bag map<string, bigint>"), f"{shared_folder(docs.sparkSession)}/bags").withColumn("half", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int"))
    found = {(r["half"], r["toxic"]): r["n"] for r in bag.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    n = [[found.get((h, y), 0) for y in (0, 1)] for h in (0, 1)]
    if not all(n[0][y] + n[1][y] for y in (0, 1)):
        return OrdinalModel({}, tuple(np.linspace(2.0, 4.0, n_grades - 1)))

    def odds(with_: list[int]) -> tuple[Column, Column]:
        """(log-odds, its error) over the halves given."""
        a, b = (sum((F.col(f"{c}{h}") for h in with_), F.lit(0.5)) for c in "ab")
        return F.log(a / (sum(n[h][1] for h in with_) + 1.0)) - F.log(b / (sum(n[h][0] for h in with_) + 1.0)), F.sqrt(1 / a + 1 / b)

    count = lambda y, h: F.count_if((F.col("toxic") == y) & (F.col("half") == h))
    both, error = odds([0, 1])
    picked = (
        bag.select("toxic", "half", F.explode(F.map_keys("bag")).alias("word"))
        .groupBy("word").agg(*[count(y, h).alias(f"{c}{h}") for y, c in ((1, "a"), (0, "b")) for h in (0, 1)])
        .where(f"a0 + a1 + b0 + b1 >= {MIN_DOCUMENTS}")
        .select("word", *[odds([1 - h])[0].alias(f"odds{h}") for h in (0, 1)], F.abs(both / error).alias("z"))
        .where(F.col("z") >= MIN_Z)
        .orderBy(F.desc("z"), "word").limit(features).collect()
    )
    place = {r["word"]: k for k, r in enumerate(picked)}
    evidence_of = np.array([[r["odds0"], r["odds1"]] for r in picked]).reshape(len(picked), 2)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [sorted((place[w], c) for w, c in x.as_py() if w in place) for x in batch.column("bag")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "toxic", "half")), pa.array([[k for k, _ in p] for p in pairs], pa.list_(pa.int32())), pa.array([[c for _, c in p] for p in pairs], pa.list_(pa.int32()))], names=["id", "toxic", "half", "at", "count"])

    # at most train_rows rows with at most `features` pairs each
    data = bag.mapInArrow(vectors, "id bigint, toxic int, half int, at array<int>, count array<int>").orderBy("id").toPandas()
    size = data["at"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(data)), size)
    cols = np.concatenate([np.zeros(0, np.int64), *data["at"]]).astype(np.int64)
    values = np.log1p(np.concatenate([np.zeros(0), *data["count"]]).astype(float))
    evidence = np.bincount(rows, values * evidence_of[cols, data["half"].to_numpy()[rows]], minlength=len(data))
    grades = weak_grades(data["toxic"].to_numpy(), evidence, n_grades)
    weights, cuts = fit_cumulative_link(rows, cols, values, grades, len(place), n_grades)
    return OrdinalModel({w: float(weights[k]) for w, k in place.items()}, tuple(map(float, cuts)))


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, grade, grade_probabilities, toxic) of every whole text, without a shuffle.

    severity is the expected grade, from 0 to the highest grade; grade is the likeliest one; toxic: grade 1 or more is
    likelier than 0. NULL and empty texts get what a text without any known word gets. NULL ids stay NULL,
    repeated rows give equal rows, an empty table gives an empty one; other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds_cache("toxicity")
        scorer = BatchScorer(model)
        for batch in batches:
            p = scorer.probabilities(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(1).astype(np.int32)), pa.array(list(p), pa.list_(pa.float64())), pa.array(p[:, 0] < 0.5)], names=["id", "severity", "grade", "grade_probabilities", "toxic"])

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(rows, "id bigint, severity double, grade int, grade_probabilities array<double>, toxic boolean")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, fit_toxicity(docs, labels)).select(F.col("id").alias("doc_id"), "severity", "grade", "toxic")
