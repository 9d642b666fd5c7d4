"""Severity of toxic text by cumulative-link ordinal regression.

A document's chance of a grade above j is sigmoid(w . x - theta_j): one weight vector for
all thresholds, and thresholds that ascend.  x is sparse: log(1 + count) of the words and
beginnings of words (stems, roughly) that the labelled sample tells apart.  The expected
severity is the mean grade.

Labels only say toxic or not, so the toxic documents of the sample are graded by how many
words occur in them that go with the label: few (1), several (2), many (3).
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import discard, nested, quoted, remembered, small_batches, stage, unnested, without

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7)  # characters of the beginnings that count beside the whole word
GRADE_FROM = (1, 3, 6)  # words that go with the label, from which grades 1, 2 and 3 begin


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "-" for k in STEMS if len(word) > k)]


def count_features(text: str) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for f in features_of(word):
            out[f] += n
    return out


@dataclass
class Severity:
    """Weights by feature, ascending thresholds, and the chance of a grade above 0 that rejects."""

    weights: dict[str, float]
    thresholds: np.ndarray
    reject_at: float = 0.5
    memory: int = 400_000

    def __post_init__(self):
        self.known: dict[str, tuple[str, ...]] = {}  # features with a weight, by word

    def above(self, text: str) -> np.ndarray:
        """The chances of a grade above 0, 1, ...; a text without known words has those of the rest."""
        counts: dict[str, int] = {}
        for word, n in Counter(WORD.findall(text.lower())).items():
            own = self.known.get(word)
            if own is None:
                own = tuple(f for f in features_of(word) if f in self.weights)
                if len(self.known) < self.memory:
                    self.known[word] = own
            for f in own:
                counts[f] = counts.get(f, 0) + n
        score = sum(self.weights[f] * np.log1p(n) for f, n in counts.items())
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def thresholds_of(state: np.ndarray, features: int) -> np.ndarray:
    """Ascending: the first one, and gaps that are exponentials."""
    return state[features] + np.concatenate([[0], np.cumsum(np.exp(state[features + 1 :]))])


def likelihood(state: np.ndarray, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, features: int, l2: float) -> tuple[float, np.ndarray]:
    """The mean log-likelihood of the grades, less the penalty on the weights, and its gradient."""
    n, w, theta = len(grades), state[:features], thresholds_of(state, features)
    score = np.bincount(rows, values * w[columns], n)
    above = _sigmoid(score[:, None] - theta[None, :])
    padded = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
    slope = padded * (1 - padded)
    at = np.arange(n)
    chance = np.maximum(padded[at, grades] - padded[at, grades + 1], 1e-12)
    by_score = (slope[at, grades] - slope[at, grades + 1]) / chance
    by_theta = np.zeros_like(padded)
    by_theta[at, grades] -= slope[at, grades] / chance
    by_theta[at, grades + 1] += slope[at, grades + 1] / chance
    t = by_theta[:, 1:-1].sum(axis=0)
    tails = np.cumsum(t[::-1])[::-1]  # a gap moves all thresholds behind it
    by_weight = np.bincount(columns, values * by_score[rows], features) / n - l2 * w
    gradient = np.concatenate([by_weight, [t.sum() / n], tails[1:] * np.exp(state[features + 1 :]) / n])
    return float(np.log(chance).mean() - l2 / 2 * (w @ w)), gradient


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, features: int, levels: int, l2: float = 2e-4, steps: int = 300, rate: float = 0.1):
    """(weights, thresholds) by gradient steps on the mean log-likelihood of a sparse sample."""
    share = np.array([np.clip((grades > j).mean(), 1e-3, 1 - 1e-3) for j in range(levels - 1)])
    start = -np.log(share / (1 - share))
    state = np.concatenate([np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, steps + 1):
        _, gradient = likelihood(state, rows, columns, values, grades, features, l2)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        state += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return state[:features], thresholds_of(state, features)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """(toxic, text) of at most so many labelled documents of each kind, chosen by a hash of their id."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    drawn = [
        known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for kind, most in ((1, max_toxic), (0, max_clean))
    ]
    texts = docs.filter("text is not null and doc_id is not null").select("doc_id", "text")
    rows = texts.join(F.broadcast(drawn[0].union(drawn[1])), "doc_id")  # max_toxic + max_clean rows
    return rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")


def _values(sample: DataFrame) -> DataFrame:
    """(toxic, feature, x), a row for each feature of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                own = count_features(text)
                x = np.log1p(np.fromiter(own.values(), np.float64, len(own)))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(own), pa.int64()), pa.array(list(own), pa.string()), pa.array(x)], names=["toxic", "feature", "x"])

    return sample.mapInArrow(run, "toxic long, feature string, x double")


def _cells(sample: DataFrame, features: dict[str, int], lexicon: set[str]) -> DataFrame:
    """A row for each document: toxic, words of the lexicon, and its cells of the chosen features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                own = count_features(text)
                known = [f for f in own if f in features]
                out.append({"toxic": kind, "hits": sum(own[f] for f in known if f in lexicon), "columns": [features[f] for f in known], "x": [math.log1p(own[f]) for f in known]})
            schema = pa.schema([("toxic", pa.int64()), ("hits", pa.int64()), ("columns", pa.list_(pa.int64())), ("x", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return sample.mapInArrow(run, "toxic long, hits long, columns array<long>, x array<double>")


def fit(
    docs: DataFrame, labels: DataFrame, max_toxic: int = 2500, max_clean: int = 4000, max_features: int = 8000, least_documents: int = 4, least_z: float = 4.0, reject_at: float = 0.5
) -> Severity:
    """Fit on a bounded sample: ``max_toxic`` and ``max_clean`` labelled documents at most.

    Features are the words and stems that occur in ``least_documents`` of the sample and whose
    mean value in toxic and in other documents differs by ``least_z`` standard errors, at most
    ``max_features`` of them; only these reach the driver.  A sample without documents of both
    kinds gives a model that grades everything 0.  Of labels that share an id the largest counts.
    """
    nothing = Severity({}, np.full(len(GRADE_FROM), 40.0), reject_at)
    sample = stage(labelled_sample(docs, labels, max_toxic, max_clean), "toxicity-sample")
    kinds = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = kinds.get(1, 0), kinds.get(0, 0)
    if not n1 or not n0:
        return nothing
    n = n1 + n0
    sums = _values(sample).groupBy("feature").agg(
        F.count("*").alias("n"), F.sum(F.col("x") * F.col("toxic")).alias("s1"), F.sum(F.col("x") * (1 - F.col("toxic"))).alias("s0"), F.sum(F.col("x") * F.col("x")).alias("q")
    )
    spread = F.col("q") / n - F.pow((F.col("s1") + F.col("s0")) / n, F.lit(2))
    z = (F.col("s1") / n1 - F.col("s0") / n0) / F.greatest(F.lit(1e-9), F.sqrt(F.greatest(F.lit(0.0), spread) * (1 / n1 + 1 / n0)))
    chosen = sums.filter(F.col("n") >= least_documents).withColumn("z", z).filter(F.abs("z") >= least_z)
    chosen = sorted(chosen.orderBy(F.desc(F.abs("z")), "feature").limit(max_features).collect(), key=lambda r: r.feature)
    if not chosen:
        return nothing
    features = {r.feature: k for k, r in enumerate(chosen)}
    lexicon = {r.feature for r in chosen if r.z > 0 and not r.feature.endswith("-") and r.s1 / n1 > 10 * r.s0 / n0}
    cells = _cells(sample, features, lexicon).collect()  # max_toxic + max_clean rows
    toxic, hits = (np.array([r[c] for r in cells], np.int64) for c in ("toxic", "hits"))
    grades = np.where(toxic == 1, np.maximum(1, np.searchsorted(GRADE_FROM, hits, side="right")), 0)
    rows = np.repeat(np.arange(len(cells)), [len(r.columns) for r in cells])
    columns = np.array([c for r in cells for c in r.columns], np.int64)
    values = np.array([x for r in cells for x in r.x], np.float64)
    weights, theta = fit_ordinal(rows, columns, values, grades, len(features), len(GRADE_FROM) + 1)
    discard(sample)
    return Severity({f: float(weights[k]) for f, k in features.items()}, theta, reject_at)


FIELDS = ["expected_severity", "p_toxic", "grade", "rejected"]


def score(docs: DataFrame, model: Severity, text: str = "text") -> DataFrame:
    """``docs`` with expected_severity, p_toxic, grade (the likeliest) and rejected, row by row.

    The whole text counts.  A null or empty text has no words and so the chances of a text
    without known words; it is never rejected.  Repeated rows are scored each; a text is held
    whole in the task that reads it.  Columns with those names are replaced.
    """
    small_batches(docs.sparkSession)
    keep = without(docs.columns, FIELDS)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), ("severity", uuid.uuid4().hex)  # a few thousand words at most
    rows = docs.select(nested(keep), F.col(quoted(text)).alias("text"))
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string("expected_severity double, p_toxic double, grade int, rejected boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = remembered(name, lambda: replace(shared.value))  # without the words that it comes to know, the model is small
        for batch in batches:
            above = np.array([own.above(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(own.thresholds))
            full = np.array([bool(t and t.strip()) for t in batch.column("text").to_pylist()], bool)
            padded = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
            new = [
                pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array((padded[:, :-1] - padded[:, 1:]).argmax(axis=1).astype(np.int32)),
                pa.array((above[:, 0] >= own.reject_at) & full),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)

    return unnested(rows.mapInArrow(run, schema), keep, FIELDS)
