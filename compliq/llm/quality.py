"""Quality classifier: random Fourier features over document statistics, ridge by summed normal equations, isotonic calibration.

Each text is reduced, once, to a few statistics. Cosines of random projections of the standardized statistics approximate a Gaussian
kernel (Rahimi and Recht, 2007). Every partition of the labelled rows sums its part of the normal equations, per fold; the sums
are added ``FAN`` at a time, in rounds, until so few are left for the driver. Features are rounded to fixed point and sums are integers, so neither the order
of rows nor a task that runs twice changes a bit of the result. The ridge solution is fitted on all folds; for
calibration each row is scored by the solution without its fold, the scores are binned, and pool-adjacent-violators over the bins
gives a monotone map to probabilities.

All labelled rows that may be learned from are used; nothing is sampled.

Defined results: null text counts as empty; an empty text has statistics zero and is scored like any other; repeated rows score
alike; null labels or ids are no examples; an id with several labels has the largest; equal raw scores get equal scores; without labels everything scores 0.5, with labels of one kind about that kind;
an empty table gives an empty result; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from compliq.llm.common import held_out, materialize, table, text_of

FOLDS, BINS, FAN = 3, 1000, 16
#: Fixed point of statistics and of features. Sums of products of features are exact up to 2^31 rows.
POINT, FEATURE_POINT = 1 << 16, 1 << 16
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\x0b\x0c\r", b".,;:?'\"", b"!", b"|", b"#$%&*+=<>@^_~`", b"()[]{}/\\-"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 12
N_STATS = 13 + 11


def statistics(text: bytes) -> list[float]:
    """Shares of byte classes; lengths; how much words and lines repeat; how words begin and end."""
    n = len(text)
    if not n:
        return [0.0] * N_STATS
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = np.bincount(_CLASS, hist, 13) / n
    p = hist[hist > 0] / n
    words, lines = text.split(), text.split(b"\n")
    k = max(len(words), 1)
    kinds = len(set(words))
    twice = sum(map(eq, words, words[1:])) / k
    lens = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    return [
        *share, float(-(p * np.log2(p)).sum()), float(np.log1p(n)), float(np.log1p(k)), float(lens.mean()), float(lens.std()), float(lens.max()) ** 0.5,
        kinds / k, twice, len(set(lines)) / len(lines), float(np.log1p(len(lines))), sum(1 for w in words if w[-1] in b".!?") / k,
    ]


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([statistics(x.as_py()) for x in b.column("text")], pa.list_(pa.float64()))], names=["id", "x"])

    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, x array<double>")


class Kernel:
    """Standardization and the random projection."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, dims: int, width: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(size=(len(mean), dims)) / (width * np.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * np.pi, dims)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def solve(a: np.ndarray, c: np.ndarray, ridge: float) -> np.ndarray:
    penalty = np.full(len(c), ridge)
    penalty[-1] = 1e-6  # the intercept is free
    return np.linalg.solve(a + np.diag(penalty), c)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centre and value of each pool, ascending. ``y``: sums of labels, ``n``: rows."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, n, strict=True):
        pools.append([a * c, b, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.01) / (p[2] + 0.02) for p in pools])


def _stack(xs) -> np.ndarray:
    return np.array([np.asarray(x, float) for x in xs]).reshape(len(xs), N_STATS)


def quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: Column | None = None,
    dims: int = 128, width: float = 0.7, ridge: float = 0.3,
) -> DataFrame:
    """One row per document: id, score in 0..1."""
    spark = docs.sparkSession
    stats = materialize(document_statistics(docs, id_col=id_col, text_col=text_col))
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("double").alias("y"), (F.lit(True) if learn is None else learn).alias("may"))
    known = known.where("may and id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    fold = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("fold")), F.lit(FOLDS)).cast("int")
    rows = materialize(stats.join(known, "id").select("x", "y", fold.alias("fold")))
    fixed = [F.round(F.element_at("x", i + 1) * POINT).cast("decimal(38,0)") for i in range(N_STATS)]
    facts = rows.agg(F.count(F.lit(1)), *[F.sum(c) for c in fixed], *[F.sum((c * c).cast("decimal(38,0)")) for c in fixed]).first()
    if not facts[0]:
        return stats.select(F.col("id").alias(id_col), F.lit(0.5).alias("score"))
    mean = np.array([float(s) / facts[0] / POINT for s in facts[1 : N_STATS + 1]])
    square = [(int(q) * facts[0] - int(s) ** 2) / (facts[0] * POINT) ** 2 for s, q in zip(facts[1 : N_STATS + 1], facts[N_STATS + 1 :], strict=True)]
    kernel = Kernel(mean, np.sqrt(np.maximum(square, 0)), dims, width)
    size = dims + 1

    def normal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, c = np.zeros((FOLDS, size, size), np.int64), np.zeros((FOLDS, size), np.int64)
        for pdf in frames:
            for i in range(0, len(pdf), 4096):  # sums of so few products are exact in doubles
                part = pdf.iloc[i : i + 4096]
                z, y, fold = np.rint(kernel(_stack(part["x"])) * FEATURE_POINT), part["y"].to_numpy(), part["fold"].to_numpy()
                for f in range(FOLDS):
                    here = z[fold == f]
                    a[f] += (here.T @ here).astype(np.int64)
                    c[f] += (here.T @ y[fold == f]).astype(np.int64)
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "sums": [np.concatenate([a.ravel(), c.ravel()]).tobytes()]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "sums": [np.sum([np.frombuffer(s, np.int64) for s in pdf["sums"]], axis=0).tobytes()]})

    sums = materialize(rows.mapInPandas(normal, "part long, sums binary"))
    while sums.count() > FAN:  # a task adds at most FAN of them
        sums = materialize(sums.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInPandas(add, "part long, sums binary"))
    total = np.sum([np.frombuffer(r["sums"], np.int64) for r in sums.collect()], axis=0)  # at most FAN rows
    total = total / float(FEATURE_POINT) ** 2
    a, c = total[: FOLDS * size * size].reshape(FOLDS, size, size), total[FOLDS * size * size :].reshape(FOLDS, size) * FEATURE_POINT
    weights = solve(a.sum(axis=0), c.sum(axis=0), ridge)
    without = np.array([solve(a.sum(axis=0) - a[f], c.sum(axis=0) - c[f], ridge) for f in range(FOLDS)])

    def outside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            raw = (kernel(_stack(pdf["x"])) * without[pdf["fold"].to_numpy()]).sum(axis=1)
            yield pd.DataFrame({"bin": np.clip(((raw + 1) / 3 * BINS).astype(int), 0, BINS - 1), "y": pdf["y"].to_numpy()})

    binned = rows.mapInPandas(outside, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").toPandas()  # at most BINS rows
    centres, values = isotonic((binned["bin"].to_numpy() + 0.5) / BINS * 3 - 1, binned["y"].to_numpy(), binned["n"].to_numpy(float))
    shared = spark.sparkContext.broadcast((kernel, weights, centres, values))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernel, weights, centres, values = shared.value
        for pdf in frames:
            raw = kernel(_stack(pdf["x"])) @ weights
            # a hundredth of the raw score keeps the order within a pool
            score = 0.99 * np.interp(raw, centres, values) + 0.01 * np.clip(raw, 0, 1)
            yield pd.DataFrame({"id": pdf["id"], "score": np.round(np.clip(score, 0, 1), 9)})  # what a batch's shape does to the last bits goes

    kind = docs.schema[id_col].dataType.simpleString()
    return stats.mapInPandas(score, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all of ``documents``; learns from the labelled rows outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality(docs, labels, learn=~held_out(labels["doc_id"]))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


SQL: dict[str, str] = {}
