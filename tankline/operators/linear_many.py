"""Linear classifiers with hinge, logistic or modified Huber loss and l1, l2 or elastic-net
penalty (ML-15), any number of settings and folds fitted side by side.

One-vs-rest accelerated proximal gradient descent: each step is one distributed pass in which every
block of rows adds its part of the loss gradients of all models (setting x class), Spark
sums them, and the driver takes the step and applies the penalty. Only weights (models x
features) live on the driver. Blocks (rows of one fold as bytes) are made once per call and kept by
the executors; a block's margins under all models that learn from its fold are one product of
matrices. Nothing is random, so a fit can be repeated exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.operators.kmeans_many import total_of
from tankline.session import spread

ELASTIC_L1 = 0.15       # share of l1 in the elastic net (the reference's library default)
HINGE_CORNER = 0.05     # the hinge's corner is rounded over this margin (it shifts the loss by 0.025 at most)
PACKED = 4096           # rows of a block
MARGINS = 65_536        # margins at hand at once: they stay in a core's cache between the steps of a slope
LOSSES = ("hinge", "log_loss", "modified_huber")


@dataclass(frozen=True)
class Setting:
    loss: str = "hinge"
    alpha: float = 1e-4
    penalty: str = "l2"
    leave_out: int | None = None    # fold that is not learned from


def loss_slope(kind: str, m: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Derivative of the loss in the margin, in place if ``out`` is ``m``."""
    if kind == "hinge":
        out = np.subtract(1, m, out=out)
        out /= HINGE_CORNER
        np.clip(out, 0.0, 1.0, out=out)
        return np.negative(out, out=out)
    if kind == "log_loss":
        out = np.clip(m, -500, 500, out=out)
        np.exp(out, out=out)
        out += 1
        return np.divide(-1, out, out=out)
    if kind == "modified_huber":
        out = np.subtract(1, m, out=out)
        np.clip(out, 0.0, 2.0, out=out)
        out *= -2
        return out
    raise ValueError(kind)


def _curvature(kind: str) -> float:
    return {"hinge": 1.0 / HINGE_CORNER, "log_loss": 0.25, "modified_huber": 2.0}[kind]


def narrow(df: DataFrame, features: str = "features", label: str = "label", fold: str | None = None) -> DataFrame:
    """What the fits read, checkpointed once: x with a constant 1, class y, weight w, fold f."""
    return spread(_columns(df, features, label, fold).checkpoint(eager=True))


def _columns(df: DataFrame, features: str, label: str, fold: str | None) -> DataFrame:
    w = F.col("weight") if "weight" in df.columns else F.lit(1.0)
    f = F.col(fold).cast("int") if fold else F.lit(-1)
    return df.select(F.concat(vector_to_array(features), F.array(F.lit(1.0))).alias("x"), F.col(label).cast("int").alias("y"),
                     w.cast("double").alias("w"), f.alias("f"))


def packed(data: DataFrame) -> DataFrame:
    """Blocks of the rows of ``narrow``, of one fold ``f`` each: ``n`` rows with ``y`` and ``w`` as bytes. Of the
    features, columns that hold only 0 and 1 in the block (marked in ``k``) are bits ``z``, the others
    doubles ``x``, column by column: a one-hot column takes an eighth of a byte per row instead of eight."""
    if "z" in data.columns:
        return data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for every in batches:
            for f, b in every.groupby("f", sort=False, dropna=False):
                for at in range(0, len(b), PACKED):
                    p = b.iloc[at : at + PACKED]
                    x = np.stack(p["x"].to_numpy()).astype(float).T
                    bit = ((x == 0) | (x == 1)).all(axis=1)
                    yield pd.DataFrame({"f": [None if pd.isna(f) else int(f)], "n": [len(p)], "k": [bit.tobytes()],
                                        "z": [np.packbits(x[bit].astype(bool), axis=1).tobytes()], "x": [x[~bit].tobytes()],
                                        "y": [p["y"].to_numpy(float).tobytes()], "w": [p["w"].to_numpy(float).tobytes()]})

    return data.mapInPandas(run, "f int, n int, k binary, z binary, x binary, y binary, w binary")


def _blocks(batches: Iterator[pd.DataFrame]):
    """(features by rows, classes, weights, fold or None) of every block."""
    for b in batches:
        for r in b.itertuples(index=False):
            bit = np.frombuffer(r.k, bool)
            x = np.empty((len(bit), r.n))
            x[~bit] = np.frombuffer(r.x).reshape(-1, r.n)
            if bit.any():
                x[bit] = np.unpackbits(np.frombuffer(r.z, np.uint8).reshape(int(bit.sum()), -1), axis=1, count=r.n)
            yield x, np.frombuffer(r.y), np.frombuffer(r.w), None if pd.isna(r.f) else int(r.f)


def blocks(df: DataFrame, features: str = "features", label: str = "label", fold: str | None = None) -> DataFrame:
    """The blocks of the rows that ``narrow`` gives, checkpointed as blocks: the vectors themselves are
    never written."""
    p = packed(_columns(df, features, label, fold)).checkpoint(eager=True)
    return spread(p, rows=p.agg(F.sum("n")).first()[0] or 0)


def fit_many(data: DataFrame, settings: Sequence[Setting], classes: Sequence[int], steps: int = 100) -> np.ndarray:
    """Weights (setting, class, feature), the intercept last (it is not penalised)."""
    data = packed(data).persist(StorageLevel.MEMORY_AND_DISK)  # a lost block is made again from the checkpoint
    d = data.select(F.length("k").alias("d")).first()["d"]
    n_models = len(settings)
    folds = sorted({s.leave_out for s in settings if s.leave_out is not None})
    losses = np.array([s.loss for s in settings])

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, total = np.zeros((d, d)), np.zeros(len(folds) + 1)
        for x, _, w, f in _blocks(batches):
            g += (x * w) @ x.T
            total += w.sum() * np.array([True, *[f != k for k in folds]])
        yield pd.DataFrame({"v": [np.concatenate([g.ravel(), total]).tobytes()]})

    def summed(fn, size: int) -> np.ndarray:
        return total_of(data.mapInPandas(fn, "v binary"), size)  # models x classes x features numbers

    first = summed(gram, d * d + 1 + len(folds))
    total = first[d * d]
    weight = np.array([total if s.leave_out is None else first[d * d + 1 + folds.index(s.leave_out)] for s in settings])
    top = float(np.linalg.eigvalsh(first[: d * d].reshape(d, d) / total).max())
    step = np.array([1.0 / (_curvature(s.loss) * top + s.alpha) for s in settings])
    theta = ahead = np.zeros((n_models, len(classes), d))
    pace = 1.0
    for _ in range(steps):
        now = ahead

        def gradient(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            g = np.zeros_like(now)
            for x, y, w, f in _blocks(batches):
                sign = np.where(y == np.array(classes, float)[:, None], 1.0, -1.0)
                of = {loss: np.flatnonzero((losses == loss) & [s.leave_out is None or s.leave_out != f for s in settings]) for loss in LOSSES}
                for loss, at in of.items():
                    step = max(256, MARGINS // max(1, len(at) * len(classes)))
                    for i in range(0, len(w) if len(at) else 0, step):
                        rows = slice(i, i + step)
                        m = (now[at].reshape(-1, d) @ x[:, rows]).reshape(len(at), len(classes), -1)
                        m *= sign[:, rows]
                        loss_slope(loss, m, out=m)
                        m *= sign[:, rows] * w[rows]
                        g[at] += (m.reshape(len(at) * len(classes), -1) @ x[:, rows].T).reshape(len(at), -1, d)
            yield pd.DataFrame({"v": [g.tobytes()]})

        g = summed(gradient, theta.size).reshape(theta.shape) / weight[:, None, None]
        new = np.empty_like(theta)
        for i, s in enumerate(settings):
            l1 = {"l1": 1.0, "l2": 0.0, "elasticnet": ELASTIC_L1}[s.penalty]
            v = ahead[i] - step[i] * g[i]
            body = v[:, :-1]
            body = np.sign(body) * np.maximum(np.abs(body) - step[i] * s.alpha * l1, 0) / (1 + step[i] * s.alpha * (1 - l1))
            new[i] = np.hstack([body, v[:, -1:]])
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (pace - 1) / faster * (new - theta)
        theta, pace = new, faster
    data.unpersist()
    return theta


def predict(df: DataFrame, theta: np.ndarray, classes: Sequence[int], features: str = "features") -> DataFrame:
    """``prediction`` by the class with the largest score; ``theta`` is (class, feature)."""
    x = F.concat(vector_to_array(features), F.array(F.lit(1.0)))

    def score(c: int):
        return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in theta[c]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    best = F.array_max(F.array(*[F.struct(score(i).alias("s"), F.lit(-i).alias("i")) for i in range(len(classes))]))
    return df.withColumn("prediction", F.get(F.array(*[F.lit(float(c)) for c in classes]), -best["i"]))


def cross_validate(df: DataFrame, settings: Sequence[Setting], folds: int, classes: Sequence[int], fold: str = "fold") -> DataFrame:
    """ML-16: accuracy on the left-out folds for every setting, all fits and all scores in
    shared passes. Columns: loss, alpha, penalty, mean_score."""
    data = blocks(df, fold=fold)
    runs = [Setting(s.loss, s.alpha, s.penalty, k) for s in settings for k in range(folds)]
    theta = fit_many(data, runs, classes)

    def right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ok, n = np.zeros(len(runs)), np.zeros(len(runs))
        for x, y, _, f in _blocks(batches):
            at = np.flatnonzero([s.leave_out == f for s in runs])
            score = (theta[at].reshape(-1, theta.shape[2]) @ x).reshape(len(at), len(classes), -1)
            ok[at] += (np.array(classes)[score.argmax(axis=1)] == y).sum(axis=1)
            n[at] += len(y)
        yield pd.DataFrame({"v": [np.concatenate([ok, n]).tobytes()]})

    ok, n = total_of(packed(data).mapInPandas(right, "v binary"), 2 * len(runs)).reshape(2, -1)
    got = {i: ok[i] / n[i] for i in range(len(runs)) if n[i]}
    rows = [(s.loss, float(s.alpha), s.penalty, float(np.mean([got[j] for j in range(i * folds, (i + 1) * folds) if j in got])))
            for i, s in enumerate(settings)]
    return df.sparkSession.createDataFrame(rows, "loss string, alpha double, penalty string, mean_score double")
