"""Quality scores from document statistics: random Fourier features, ridge and isotonic calibration.

A few statistics of each whole text (shares of kinds of bytes, lengths and repetition of words and lines) are
standardised, brought to six standard deviations where they are farther from the mean, since the kernel tells nothing
apart out there, and mapped to random cosines whose inner products approximate a Gaussian kernel. Each partition
sums its part of the normal equations, the driver adds the parts, one matrix each, and solves for the ridge
weights. Pool-adjacent-violators on labelled rows that the ridge has not seen turns its output into a
probability. A score depends on nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, mapped, small_batches, staged, text_bytes

#: About how many labelled rows the fit uses at most: those with the smallest hashes of their ids.
MOST_LABELS = 20_000
FEATURES, RIDGE, SEED, CALIBRATION_SHARE = 384, 1e-3, 20, 5
#: Standard deviations that a statistic is from the mean at most.
FARTHEST = 6.0
#: Partitions of the labelled rows; each sends one matrix to the driver.
FIT_PARTS = 8

_KINDS = np.zeros((256, 9))
for _k, _bytes in enumerate([range(97, 123), range(65, 91), range(48, 58), [32], [10], b".,;:'\"-?()", b"!", b"#*$%&@^~=+<>_/\\[]{}`", b"|"]):
    _KINDS[list(_bytes), _k] = 1
_HIGH = np.arange(256) >= 128
STATISTICS = 20


def statistics_of(text: bytes) -> list[float]:
    """The statistics of one text; all are finite, also for an empty one."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    shares = (counts @ _KINDS / n).tolist()
    words = text.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ln = max(1, len(lines))
    distinct = len(set(words))
    return [
        *shares,
        float(counts[_HIGH].sum()) / n,
        np.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        distinct / w,
        np.log1p(distinct) / np.log1p(w),
        sum(map(eq, words, words[1:])) / w,
        len(set(lines)) / ln,
        np.log1p(len(words) / ln),
        sum(x[-1:] in b".!?" for x in words) / w,
    ]



def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = np.array([statistics_of(t) for t in b.column("text").to_pylist()]).reshape(-1, STATISTICS)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), b.column("part"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "part", "x"])


@dataclass
class Model:
    """What scoring needs; ``steps`` and ``chances`` are the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    chances: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -FARTHEST, FARTHEST)
        cosines = np.cos(z @ self.waves + self.phase) * np.sqrt(2 / self.waves.shape[1])
        return np.concatenate([cosines, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.steps):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.steps, self.chances), 0, 1)


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the middle and the mean label of each block, both increasing."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, y in zip(raw[order], label[order], strict=True):
        blocks.append([r, y, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            r1, y1, n1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + r1, blocks[-1][1] + y1, blocks[-1][2] + n1]
    return np.array([r / n for r, _, n in blocks]), np.array([y / n for _, y, n in blocks])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", most: int = MOST_LABELS) -> Model:
    """Fit on rows with a 0/1 label (others are dropped; null texts are empty). The rows should be a bounded sample, see
    :func:`sample`; what reaches the driver is a matrix a partition and at most ``most`` calibration rows' statistics, those
    with the smallest hashes of their ids. Without labelled rows every score is 0.5; with labels of one kind only, every
    score is that label."""
    small_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"), F.col(label_col).cast("double").alias("label"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit("calibrate")), F.lit(CALIBRATION_SHARE)).cast("int").alias("part"),
    )
    kept = staged(rows.mapInArrow(_statistics, "doc_id long, label double, part int, x array<double>"))

    def summed(of, df: DataFrame) -> list[np.ndarray]:
        """The sum over all rows of the arrays that ``of`` makes of a batch; each partition sums its own."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    x = np.array(b.column("x").to_pylist())
                    part = of(x, np.array(b.column("label")))
                    total = part if total is None else [t + p for t, p in zip(total, part, strict=True)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(t, "<f8").tobytes()], pa.binary()) for t in total], names=[f"a{k}" for k in range(len(total))])

        n = len(of(np.zeros((1, STATISTICS)), np.zeros(1)))
        got = df.coalesce(FIT_PARTS).mapInArrow(run, ", ".join(f"a{k} binary" for k in range(n))).collect()
        return [np.sum([np.frombuffer(r[k], "<f8") for r in got], axis=0) for k in range(n)] if got else []

    learn, judge = kept.filter("part > 0"), kept.filter("part = 0")
    rng = np.random.default_rng(SEED)
    waves, phase = rng.normal(size=(STATISTICS, FEATURES)) / np.sqrt(STATISTICS), rng.uniform(0, 2 * np.pi, FEATURES)
    none = np.zeros(0)
    model = Model(np.zeros(STATISTICS), np.ones(STATISTICS), waves, phase, np.zeros(FEATURES + 1), none, none)
    moments = summed(lambda x, _: [np.array([len(x)]), x.sum(0), (x * x).sum(0)], learn)
    if not moments:
        return model
    n, s, q = moments
    model.mean = s / n[0]
    model.scale = np.maximum(np.sqrt(np.maximum(q / n[0] - model.mean**2, 0)), 1e-6)
    shaped = Model(model.mean, model.scale, waves, phase, model.weights, none, none)

    def equations(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        f = shaped.features(x)
        return [(f.T @ f).ravel(), f.T @ y]

    a, b = summed(equations, learn)
    d = FEATURES + 1
    model.weights = np.linalg.solve(a.reshape(d, d) + RIDGE * n[0] / FEATURES * np.eye(d), b)
    first = lambda df: df.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(most).select("x", "label").toArrow()
    seen = first(judge)
    if not seen.num_rows:
        seen = first(learn)
    model.steps, model.chances = isotonic(model.raw(np.array(seen.column("x").to_pylist())), np.array(seen.column("label")))
    return model


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELS) -> DataFrame:
    """The texts of about ``most`` labelled documents at most. Labels other than 0 and 1 are dropped; a document
    with several takes the larger; labels without a document have no effect. The labels taken are few by the
    bound, so they are broadcast."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("of_id")).agg(F.max(label_col).alias("label"))
    n = one.count()
    if n > most:
        one = one.filter(F.pmod(F.xxhash64("of_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    rows = docs.select(F.col(id_col).alias("of_id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(one), "of_id").select(F.col("of_id").alias("doc_id"), "text", "label")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``score`` (0 to 1) for each row of ``docs`` with its id as doc_id, or with ``columns``. A null text counts as
    empty; repeated rows get equal scores."""
    small_batches(docs.sparkSession)
    columns = columns or [id_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    (name,) = free(docs, "text_bytes")
    rows = docs.select(*[F.col(c) for c in columns], text_bytes(text_col).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            x = np.array([statistics_of(t) for t in b.column(name).to_pylist()]).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(m.scores(x), pa.float64())], names=[*columns, "score"])

    kind = rows.drop(name).schema.add("score", "double")
    out = rows.mapInArrow(run, kind)
    return out.withColumnRenamed(id_col, "doc_id") if columns == [id_col] else out


def keep(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns, whose names may be any; one pass, no
    shuffle. A null text counts as empty; repeated rows stay or go together; no rows give no rows."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    (name,) = free(docs, "text_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            x = np.array([statistics_of(t) for t in b.column(name).to_pylist()]).reshape(-1, STATISTICS)
            yield b.drop_columns([name]).filter(pa.array(m.scores(x) >= least))

    return mapped(docs.withColumn(name, text_bytes(text_col)), run, docs.schema)
