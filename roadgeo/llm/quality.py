"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Each whole text gives a fixed number of statistics. Cosines of random projections of them approximate a Gaussian kernel;
the weights solve normal equations that partitions sum up. Raw scores are calibrated on a fold of the labels that the
weights have not seen: its labels are summed by bins of the raw score, and pooled until they rise.

Labels of held-out ids are never read; labels are joined by doc_id to the statistics, never to texts. Nothing but the
text enters a score.

Cases. A null or empty text has the statistics of no words and is scored as any other. Ids with several labels count
with their mean; repeated rows count repeatedly. Null labels and null ids teach nothing. Without any label every score
is PRIOR. Columns other than `doc_id` and `text`, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgeo.llm.common import by_batch, held_out, learnable, partition_sums, staged

FEATURES, RIDGE, SEED, BINS = 256, 1e-3, 20_24, 400
#: Width of the kernel, in standard deviations of the statistics.
WIDTH = 5.0
PRIOR = 0.5
THRESHOLD = 0.7
N_STATS = 20


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text, each of about the size of one."""
    raw = (text or "").encode()
    n = len(raw)
    if not n:
        return [0.0] * N_STATS
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    upper, lower, digits = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    high, white = count[128:].sum(), count[9:14].sum() + count[32]
    signs = n - upper - lower - digits - high - white
    stops, marks = count[[44, 46, 59, 58, 63]].sum(), count[[35, 42, 36, 37, 38, 124, 60, 62]].sum()
    share = lambda x, of: float(np.sqrt(x / max(1, of)))
    runs = len(set(zip(words, words[1:], words[2:])))
    filled = [x for x in lines if x.strip()]
    return [
        float(np.log1p(n)) / 4, float(np.log1p(w)) / 4, share(upper, upper + lower), share(digits, n), share(high, n),
        share(signs, n), share(stops, w), share(marks, w), share(count[33], w), share(count[124], w), share(white, n),
        float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())), share(len(set(words)), w),
        share(runs, max(1, w - 2)), share(len(set(filled)), len(filled)), float(np.log1p(n / max(1, len(filled)))) / 3,
        float(np.log1p(lengths.max())), share((lengths <= 3).sum(), w), share(count[64] + count[95] + count[92] + count[94], w),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row."""
    return by_batch(docs.select("doc_id", "text"), lambda ids, texts: zip(ids, map(statistics, texts)), "doc_id bigint, stats array<float>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosines of random projections, and a constant."""
        z = np.clip((stats - self.mean) / self.scale, -5, 5)
        rng = np.random.default_rng(SEED)
        w = rng.normal(size=(stats.shape[1], FEATURES)) / WIDTH
        shift = rng.uniform(0, 2 * np.pi, FEATURES)
        # Added up term by term: a product of matrices rounds by the place of a row in its batch.
        angle = np.repeat(shift[None], len(z), axis=0)
        for column, row in zip(z.T, w):
            angle += column[:, None] * row
        return np.hstack([np.cos(angle) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        total = np.zeros(len(stats))
        for column, weight in zip(self.features(stats).T, self.weights):
            total += column * weight
        return total

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), PRIOR)
        return np.interp(self.raw(stats), self.knots, self.levels)


def pooled(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and rising levels of the mean of y, each of n rows. Ends lie within 0 and 1."""
    blocks: list[list[float]] = []  # place * n, y * n, n
    for a, b, c in zip(x, y, n):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], (b[:, 1] + 0.01) / (b[:, 2] + 0.02)


def fit(stats: DataFrame, labels: DataFrame, mark: str = "quality") -> Model:
    """A model from stored statistics and the labels that may be learnt from."""
    known = stats.join(learnable(labels, mark), "doc_id").select("stats", "y", (F.crc32(F.col("doc_id").cast("string")) % 4 == 3).alias("late"))
    known = staged(known, "quality-known")
    matrix = lambda c: np.stack(c["stats"]).astype(float)

    def moments(c):
        x = matrix(c)
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    sums = partition_sums(known, moments, 1 + 2 * N_STATS)
    if not sums[0]:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    mean = sums[1 : 1 + N_STATS] / sums[0]
    scale = np.sqrt(np.maximum(sums[1 + N_STATS :] / sums[0] - mean**2, 1e-4))
    model = Model(mean, scale, np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    d = FEATURES + 1

    def normal(c):
        z, y = model.features(matrix(c)), c["y"].astype(float)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(y)]])

    both = known.where("late").limit(1).count() and known.where("not late").limit(1).count()
    eq = partition_sums(known.where("not late") if both else known, normal, d * d + d + 1)
    gram = eq[: d * d].reshape(d, d)
    model.weights = np.linalg.solve(gram + RIDGE * eq[-1] / FEATURES * np.eye(d), eq[d * d : -1])

    def binned(c):
        bins = np.clip(model.raw(matrix(c)) * BINS / 2 + BINS / 4, 0, BINS - 1).astype(int)
        raw = model.raw(matrix(c))
        return np.concatenate([np.bincount(bins, w, BINS) for w in (None, c["y"].astype(float), raw)])

    n, y, x = partition_sums(known.where("late") if both else known, binned, 3 * BINS).reshape(3, BINS)
    some = n > 0
    model.knots, model.levels = pooled(x[some] / n[some], y[some] / n[some], n[some])
    return model


def score(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of statistics."""

    def rows(ids, values):
        scores = model.scores(np.array(values, float)).tolist()
        return ((i, s, int(s >= threshold)) for i, s in zip(ids, scores))

    scored = by_batch(stats, rows, "doc_id bigint, score double, predicted int", 4000)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score, from one pass over the texts."""
    stats = staged(measured(docs), "quality-stats")
    return score(stats, fit(stats, labels))


def accepted(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of the documents that the classifier does not reject. Texts are read twice and never shuffled."""
    model = fit(staged(measured(docs), "quality-stats"), labels)
    picked = docs.select(*columns)
    at = columns.index("text")

    def rows(*values):
        scores = model.scores(np.array([statistics(t) for t in values[at]], float))
        return (row for row, s in zip(zip(*values), scores) if s >= THRESHOLD)

    return by_batch(picked, rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema))
