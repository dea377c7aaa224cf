"""Quality scores: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import batches, fold, only, words
from .work import Workspace

FEATURES, SEED, RIDGE, BINS = 256, 7, 1e-3, 512
THRESHOLD = 0.3
PUNCT = bytes(i for i in range(33, 127) if not (48 <= i < 58 or 65 <= i < 91 or 97 <= i < 123))
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def statistics(text: str | None) -> list[float]:
    """Fourteen numbers of a whole text; an empty or null text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    ws = words(text)
    n, size = len(ws), len(raw)
    if not n:
        return [0.0] * 14
    tally = Counter(ws)
    lines = raw.split(b"\n")
    share = lambda drop: 1 - len(raw.translate(None, drop)) / size
    doubled = sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / n
    p = np.fromiter(tally.values(), np.float64, len(tally)) / n
    return [
        np.log1p(n), size / n, len(tally) / n, max(tally.values()) / n, doubled, float(-(p * np.log(p)).sum()) / np.log1p(n),
        share(UPPER), share(DIGITS), share(PUNCT), share(b".,") , share(b"|"), share(b"!?"),
        len({*lines}) / len(lines), np.log1p(n / len(lines)),
    ]


WIDTH = 14


def _stats(it):
    def one(b):
        x = np.array([statistics(t) for t in b.column(1).to_pylist()], np.float32).reshape(b.num_rows, WIDTH)
        at = np.arange(0, x.size + 1, WIDTH, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["doc_id", "held_out", "x"])

    yield from batches(one)(it)


class Fourier:
    """z(x) = sqrt(2/D) cos(Wx + b) of standardised x approximates a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, width: float = 2.0):
        r = np.random.Generator(np.random.PCG64(SEED))
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w, self.b = r.normal(0, 1 / width, (len(mean), FEATURES)), r.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2 / FEATURES) * np.cos(np.clip((x - self.mean) / self.sd, -6, 6) @ self.w + self.b)
        return np.hstack([z, np.ones((len(x), 1))])


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH) if len(column) else np.zeros((0, WIDTH))


def _summed(parts: DataFrame, each, shape: tuple[int, ...]) -> np.ndarray:
    """Adds up one array a partition, which ``each`` makes; groups of partitions are added on executors first."""
    size = int(np.prod(shape))

    def run(it):
        total = np.zeros(size)
        for b in it:
            if b.num_rows:
                total += each(b).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def add(it):
        total = np.zeros(size)
        for b in it:
            for s in b.column(0).to_pylist():
                total += np.frombuffer(s)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    sums = parts.mapInArrow(run, "s binary").repartition(8).mapInArrow(add, "s binary").collect()
    return sum((np.frombuffer(r.s) for r in sums), np.zeros(size)).reshape(shape)


def isotonic(at: np.ndarray, ones: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted points; (left ends, values) of the blocks."""
    blocks: list[list[float]] = []
    for x, y, w in zip(at, ones, weight, strict=True):
        if w <= 0:
            continue
        blocks.append([x, y, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, y2, w2 = blocks.pop()
            blocks[-1][1] += y2
            blocks[-1][2] += w2
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    def __init__(self, fourier: Fourier, beta: np.ndarray):
        self.fourier, self.beta, self.low, self.high, self.knots = fourier, beta, 0.0, 1.0, None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.beta

    def bins(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - self.low) / (self.high - self.low) * BINS, 0, BINS - 1).astype(int)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.knots is None:
            return np.full(len(x), 0.5)
        at, value = self.knots
        return np.clip(value[np.clip(np.searchsorted(at, self.bins(self.raw(x)), "right") - 1, 0, len(at) - 1)], 0.0, 1.0)


def fit(labelled: DataFrame) -> Model:
    """From (x, y) rows, all of them: moments, normal equations and calibration histogram are sums of fixed size."""
    f = lambda each, shape: _summed(labelled, each, shape)

    def moments(b):
        x = _matrix(b.column(0))
        return np.vstack([x.sum(axis=0), (x * x).sum(axis=0), np.full(WIDTH, float(len(x)))])

    m = f(moments, (3, WIDTH))
    n = m[2, 0]
    if not n:
        return Model(Fourier(np.zeros(WIDTH), np.ones(WIDTH)), np.zeros(FEATURES + 1))
    mean = m[0] / n
    z = Fourier(mean, np.sqrt(np.maximum(m[1] / n - mean**2, 0)))

    def normal(b):
        a = z(_matrix(b.column(0)))
        return np.hstack([a.T @ a, (a.T @ b.column(1).to_numpy(zero_copy_only=False).astype(float))[:, None]])

    g = f(normal, (FEATURES + 1, FEATURES + 2))
    penalty = RIDGE * n / FEATURES * np.eye(FEATURES + 1)
    penalty[-1, -1] = 0
    model = Model(z, np.linalg.lstsq(g[:, :-1] + penalty, g[:, -1], rcond=None)[0])
    model.low, model.high = -0.5, 1.5

    def tally(b):
        at, y = model.bins(model.raw(_matrix(b.column(0)))), b.column(1).to_numpy(zero_copy_only=False)
        return np.vstack([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    h = f(tally, (2, BINS))
    model.knots = isotonic(np.arange(BINS), h[0], h[1])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, text) and (doc_id, quality) to (doc_id, held_out, score, predicted) for every row of docs.

    Learns from all labels of rows with crc32(doc_id) mod 5 other than 0; the score uses nothing but the text.
    score: calibrated probability of quality 1, for empty and null texts too (their statistics are zeros); 0.5
    everywhere if there are no labels. predicted: 1 from 0.3 on. Null doc_ids are scored, not held out and never
    learned from. Null qualities are ignored; conflicting labels of a document each count. Repeated rows are
    scored each. Empty tables give empty results. Further columns are ignored.
    """
    ws = ws or Workspace(docs.sparkSession)
    src = only(docs, "doc_id", "text").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)))
    stats = ws.save(src.mapInArrow(_stats, "doc_id long, held_out boolean, x array<float>"), "statistics")
    known = only(labels, "doc_id", "quality").where("quality in (0, 1)")
    rows = ws.save(stats.where("not held_out").join(known, "doc_id").select("x", F.col("quality").cast("double").alias("y")), "labelled")
    model = docs.sparkSession.sparkContext.broadcast(fit(rows))

    def scored(it):
        def one(b):
            s = model.value.score(_matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

        yield from batches(one)(it)

    return stats.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of documents, learned from the labels outside the held-out fold."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
