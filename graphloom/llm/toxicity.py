"""Toxicity: a classifier chain of linear models over hashed words and word prefixes.

Categories are predicted one after another; each model also gets the probabilities of all earlier categories.  For training, those come
out of fold: the labelled rows are split into `folds` by a hash of the id, and a row's earlier probabilities are from the model that has not seen it.
The final models are fitted on all labelled rows.

A document's features are counts, over its distinct white-space chunks (lower case, outer marks stripped), of the chunk and of its 4- to 7-character
prefixes, hashed.  A category keeps the features whose document frequency differs between the classes by a chi-square of at least `chi`.
As counts over chunks add up, a document's log-odds are sums of one number a chunk, which workers remember up to a bound.

Fitting uses a bounded sample of labelled rows: the `max_rows` ids of smallest hash.  The models (three arrays of `dim` numbers) are the only thing
that is sent to executors.  Null or empty texts have the intercepts alone.  Repeated rows are scored each for itself.  With no label row of a
class, that category's probability is that class's smoothed rate.  A probability of exactly `THRESHOLD` counts as toxic.  An empty table gives no rows; extra columns
stay in the input row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: In chain order: name, and the condition on the labels table.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("severe", "toxic = 1 and quality = 0"))
DIM, FOLDS, MAX_ROWS, CHI, THRESHOLD = 1 << 20, 4, 8_000, 14.0, 0.5
MARKS = ".,;:!?\"'()[]{}#*$%&|<>-"


def chunk_features(chunk: str, dim: int) -> list[int]:
    word = chunk.strip(MARKS)
    if not word:
        return []
    return [zlib.crc32(word.encode()) % dim] + [zlib.crc32(word[:n].encode(), n) % dim for n in range(4, 8) if len(word) >= n]


def document_features(text: str | None, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and their counts over distinct chunks."""
    found = [f for c in set((text or "").lower().split()) for f in chunk_features(c, dim)]
    return np.unique(np.array(found, np.int64), return_counts=True)


class Sample:
    """Labelled rows as sparse counts."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], dim: int):
        self.n, self.dim = len(rows), dim
        self.at = np.repeat(np.arange(self.n), [len(f) for f, _ in rows])
        self.col = np.concatenate([f for f, _ in rows]) if rows else np.zeros(0, np.int64)
        self.val = np.concatenate([c for _, c in rows]).astype(float) if rows else np.zeros(0)

    def fit(self, y: np.ndarray, extra: np.ndarray, use: np.ndarray, chi: float, steps: int = 250) -> tuple[np.ndarray, np.ndarray, float]:
        """Weights of features, weights of extra columns, intercept; from the rows of `use`."""
        n, pos = int(use.sum()), float(y[use].sum())
        w, v, b = np.zeros(self.dim), np.zeros(extra.shape[1]), float(np.log((pos + 0.5) / (n - pos + 0.5)))
        if pos == 0 or pos == n:
            return w, v, b
        on = use[self.at]
        df = np.bincount(self.col[on], minlength=self.dim).astype(float)
        a = np.bincount(self.col[on], y[self.at[on]], self.dim)  # documents of the class with the feature
        det = a * (n - pos - df + a) - (df - a) * (pos - a)
        with np.errstate(divide="ignore", invalid="ignore"):
            stat = np.nan_to_num(n * det**2 / (df * (n - df) * pos * (n - pos)))
        kept = np.flatnonzero((stat >= chi) & (df >= 3))
        place = np.full(self.dim, -1)
        place[kept] = np.arange(len(kept))
        on &= place[self.col] >= 0
        rank = np.cumsum(use) - 1
        at, col, val = rank[self.at[on]], place[self.col[on]], np.minimum(self.val[on], 3)
        x, t = extra[use], y[use]
        u, speed, speed_v, speed_b = np.zeros(len(kept)), np.full(len(kept), 1e-6), np.full(len(v), 1e-6), 1e-6
        for _ in range(steps):
            z = np.bincount(at, val * u[col], n) + x @ v + b
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - t
            gu, gv, gb = np.bincount(col, val * g[at], len(kept)) + 0.5 * u, x.T @ g + 1.0 * v, g.sum()
            speed, speed_v, speed_b = speed + gu**2, speed_v + gv**2, speed_b + gb**2
            u, v, b = u - 0.5 * gu / np.sqrt(speed), v - 0.5 * gv / np.sqrt(speed_v), b - 0.5 * gb / np.sqrt(speed_b)
        w[kept] = u
        return w, v, float(b)

    def scores(self, model: tuple[np.ndarray, np.ndarray, float], extra: np.ndarray) -> np.ndarray:
        w, v, b = model
        return np.bincount(self.at, self.val * w[self.col], self.n) + extra @ v + b


def squash(z: np.ndarray) -> np.ndarray:
    """Probabilities, as the chain hands them on."""
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(sample: Sample, labels: np.ndarray, fold: np.ndarray, folds: int, chi: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    models, extra = [], np.zeros((sample.n, 0))
    for k in range(labels.shape[1]):
        y, out = labels[:, k].astype(float), np.zeros(sample.n)
        models.append(sample.fit(y, extra, np.ones(sample.n, bool), chi))
        for f in range(folds):
            held = fold == f
            if held.any():
                out[held] = squash(sample.scores(sample.fit(y, extra, ~held, chi), extra))[held] if (~held).any() else 0.5
        extra = np.column_stack([extra, out])
    return models


def train(docs: DataFrame, labels: DataFrame, *, categories: Sequence[tuple[str, str]] = CATEGORIES, dim: int = DIM, folds: int = FOLDS, max_rows: int = MAX_ROWS, chi: float = CHI) -> list[tuple[np.ndarray, np.ndarray, float]]:
    names = [n for n, _ in categories]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.expr(e), F.lit(False)).alias(n) for n, e in categories]).where("doc_id is not null")
    known = known.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [document_features(t, dim) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            cols = [b.column(b.schema.get_field_index(c)) for c in ["doc_id", *names]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([f.astype("<i4").tobytes() for f, _ in own], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in own], pa.binary())], names=["doc_id", *names, "f", "c"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.BooleanType()) for n in names), T.StructField("f", T.BinaryType()), T.StructField("c", T.BinaryType())])
    got = sorted({(r["doc_id"], bytes(r["f"]), bytes(r["c"]), *(r[n] for n in names)) for r in rows.mapInArrow(features, schema).toLocalIterator()})
    sample = Sample([(np.frombuffer(f, "<i4").astype(np.int64), np.frombuffer(c, "<i4")) for _, f, c, *_ in got], dim)
    fold = np.array([zlib.crc32(str(r[0]).encode()) % folds for r in got], int)
    return fit_chain(sample, np.array([r[3:] for r in got], bool).reshape(len(got), len(names)), fold, folds, chi)


def score(docs: DataFrame, models: list[tuple[np.ndarray, np.ndarray, float]], *, categories: Sequence[tuple[str, str]] = CATEGORIES, dim: int = DIM, remembered: int = 300_000) -> DataFrame:
    """The input row as struct __row with p_<category> beside it.  No shuffle."""
    spark, names = docs.sparkSession, [n for n, _ in categories]
    used = np.unique(np.concatenate([np.flatnonzero(w) for w, _, _ in models]))  # a few thousand features at most
    shared = spark.sparkContext.broadcast((used, np.stack([w[used] for w, _, _ in models]), [v for _, v, _ in models], [b for _, _, b in models]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, w, v, b = shared.value
        place = dict(zip(used.tolist(), range(len(used)), strict=True))
        none: tuple = ()
        memory: dict[str, tuple] = {}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            z = np.empty((len(texts), len(b)))
            for k, text in enumerate(texts):
                if len(memory) > remembered:
                    memory.clear()
                chunks = set((text or "").lower().split())
                for c in [c for c in chunks if c not in memory]:  # a difference with the keys would walk through all of them
                    memory[c] = tuple(p for f in chunk_features(c, dim) if (p := place.get(f)) is not None) or none
                hits = [p for c in chunks if (m := memory[c]) for p in m]
                count = np.minimum(np.bincount(hits, minlength=len(used)), 3) if hits else None
                own = w @ count if count is not None else np.zeros(len(b))
                p = np.zeros(0)
                for j in range(len(b)):
                    z[k, j] = own[j] + p @ v[j] + b[j]
                    p = np.append(p, squash(z[k, j]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(squash(z[:, j])) for j in range(len(b)))], names=["__row", *(f"p_{n}" for n in names)])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__row"), "text")
    schema = T.StructType([rows.schema["__row"], *(T.StructField(f"p_{n}", T.DoubleType()) for n in names)])
    return rows.mapInArrow(apply, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return rows.select("__row.doc_id", *[F.round(f"p_{n}", 6).alias(f"p_{n}") for n, _ in CATEGORIES], (F.col("p_toxic") >= THRESHOLD).alias("toxic"))
