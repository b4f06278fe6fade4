"""Quality scores by Bradley-Terry pairwise ranking.

Every document is a vector of text statistics. Labelled rows give preference pairs (a row of label 1 beats a row of
label 0); the chance that a beats b is 1 / (1 + exp(-(s(a) - s(b)))) with s(x) = w . x, and w is learned by logistic
loss on feature differences (with an L2 term) over a bounded sample of pairs. The threshold is a quantile of the learned scores: the
one that parts the training rows in the proportion of their labels, moved along the score axis to where it errs least (both kinds of error weigh the same per label). Scores are mapped to (0, 1) by a logistic curve that passes
the reported cut at the threshold.

The fit takes at most SAMPLE labelled rows per label, the ones with the smallest digests of their ids; everything
else sees all rows and whole texts. Without rows of both labels all weights are 0 and every score is the cut.

Defined results: a null text is an empty one, which has a score like any other; documents with several labels count
by their largest; null ids are no training rows; repeated rows are scored one by one; an empty table gives no rows; other columns come
back as they were, whatever they are called (the score is the last column).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .base import binaries, by_batches, fresh

#: Rows of each label that a fit looks at, at most.
SAMPLE = 6000
#: Preference pairs per fit.
PAIRS = 60_000
#: Scores at or above are predicted 1.
CUT = 0.3

MARKS = [b"!", b"#", b"$", b"%", b"&", b"*", b"|", b"?", b".", b",", b"@", b":", b"<>{}[]", b"()\"'", b"+-=/\\_^~`;"]
GROUPS = np.zeros(256, dtype=np.int64)
for _k, _marks in enumerate(MARKS, 6):
    GROUPS[list(_marks)] = _k
GROUPS[65:91], GROUPS[97:123], GROUPS[48:58], GROUPS[128:] = 1, 2, 3, 4
GROUPS[[9, 10, 11, 12, 13, 32]] = 5


def features(text: bytes) -> list[float]:
    """Statistics of a whole text; shares are of its bytes or words."""
    n = max(len(text), 1)
    histogram = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) if text else np.zeros(256, dtype=np.int64)
    group = np.bincount(GROUPS, weights=histogram, minlength=6 + len(MARKS)) / n
    words = text.split()
    m = max(len(words), 1)
    counts = Counter(words)
    top = counts.most_common(5)
    lines = text.split(b"\n")
    shown = [x for x in lines if x.strip()]
    pairs = len(set(zip(words, words[1:]))) if words else 0
    same = sum(a == b for a, b in zip(words, words[1:]))
    letters = max(group[1] + group[2] + group[4], 1e-9)
    return [
        *np.sqrt(group),
        group[1] / letters,
        math.log1p(len(words)),
        math.log1p(len(words)) ** 2 / 10,
        min(len(text) / m, 40) / 10,
        len(counts) / m,
        len(counts) / m * math.log1p(len(words)) / 5,
        pairs / m,
        (top[0][1] / m) if top else 0.0,
        sum(c for _, c in top) / m,
        same / m,
        len(set(shown)) / max(len(shown), 1),
        min(len(lines) / m, 1.0),
        max(map(len, words), default=0) ** 0.5 / 10,
        float(np.count_nonzero(histogram)) / 100,
        float(not words),
    ]


WIDTH = len(features(b""))


@dataclass(frozen=True)
class Ranking:
    """score = logistic(scale * (w . (x - mean) / spread - threshold) + logit(CUT))."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.scale * (self.strength(x) - self.threshold) + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def expand(z: np.ndarray) -> np.ndarray:
    """The standardised statistics, clipped, and how far each is from its mean."""
    z = np.clip(z, -6, 6)
    return np.hstack([z, np.abs(z)])


def fit(x: np.ndarray, label: np.ndarray, steps: int = 400, penalty: float = 1e-3, seed: int = 7) -> Ranking:
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(2 * WIDTH), 0.0, 1.0)
    mean, spread = x.mean(0), x.std(0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    z = expand((x - mean) / spread)
    pick = np.random.default_rng(seed)
    difference = z[pick.choice(good, PAIRS)] - z[pick.choice(bad, PAIRS)]
    w, moment, square = np.zeros(z.shape[1]), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam
        lost = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
        slope = -(difference * lost[:, None]).mean(0) + penalty * w
        moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w = w - 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    s = z @ w
    share = len(bad) / (len(good) + len(bad))
    quantiles = np.unique(np.clip(np.concatenate([np.linspace(0.005, 0.995, 199), [share]]), 0, 1))
    cuts = np.quantile(s, quantiles)
    wrong = [(s[good] < c).mean() + (s[bad] >= c).mean() for c in cuts]
    threshold = float(cuts[int(np.argmin(wrong))])
    return Ranking(mean, spread, w, threshold, 1.0)


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """text and label of at most `sample` rows of each label among the rows where `learn` holds."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn).groupBy("doc_id").agg(F.max(label).alias("__label"))
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("__label") == value).orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("__label").cast("long").alias("label"))


def fit_labels(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", sample: int = SAMPLE) -> Ranking:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(features(t)).tobytes() for t in binaries(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("label")], names=["x", "label"])

    rows = by_batches(training_rows(docs, labels, learn, label, sample), run, "x binary, label long").collect()
    rows = sorted((bytes(r["x"]), r["label"]) for r in rows)
    x = np.array([np.frombuffer(r[0]) for r in rows]).reshape(-1, WIDTH)
    return fit(x, np.array([r[1] for r in rows]))


def scored(spark: SparkSession, docs: DataFrame, ranking: Ranking) -> DataFrame:
    """docs (all columns) and a last column score, with underscores in front where docs has a column of that name."""
    place, name = docs.columns.index("text"), fresh("score", docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in binaries(batch.column(place))]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranking.score(x), pa.float64())], names=[*batch.schema.names, name])

    return by_batches(docs, run, StructType([*docs.schema.fields]).add(name, DoubleType()))
