"""Many Gaussian mixtures over one table, side by side (CL-13, CL-14): every covariance type and number
of components shares the passes over the rows.

Each step of expectation maximisation is one distributed pass: every block of rows adds, for all
mixtures that have not settled, its log-likelihood and per component the weight, the weighted
sum and the weighted products of its rows; Spark adds these up and the driver, which holds only
parameters, takes the step. Mixtures start from the labels of K-means fits, which share their
passes too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankline.operators import kmeans_many as KM

COVARIANCES = ("full", "tied", "diag", "spherical")
FLOOR = 1e-6            # added to every variance
ROWS = 512              # rows whose shares of all components are at hand at once: they stay in a core's cache


@dataclass
class Mixture:
    """``covariance`` is (k, d, d), (d, d), (k, d) or (k,) by type; ``settled`` once the mean
    log-likelihood moves by less than the tolerance."""
    k: int
    kind: str
    weight: np.ndarray
    mean: np.ndarray
    covariance: np.ndarray
    log_likelihood: float = -np.inf
    iterations: int = 0
    settled: bool = False

    def matrices(self) -> np.ndarray:
        """(k, d, d) covariance matrices."""
        d = self.mean.shape[1]
        if self.kind == "full":
            return self.covariance
        if self.kind == "tied":
            return np.broadcast_to(self.covariance, (self.k, d, d))
        variance = self.covariance if self.kind == "diag" else np.repeat(self.covariance[:, None], d, axis=1)
        return np.stack([np.diag(v) for v in variance])

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """(rows, k): log of component weight times density."""
        out = np.empty((len(x), self.k))
        for c, m in enumerate(self.matrices()):
            low = np.linalg.cholesky(m)
            z = np.linalg.solve(low, (x - self.mean[c]).T)
            out[:, c] = np.log(self.weight[c]) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out

    def parameters(self) -> int:
        k, d = self.k, self.mean.shape[1]
        return (k - 1) + k * d + {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[self.kind]


def log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1)
    return top + np.log(np.exp(a - top[:, None]).sum(axis=1))


def terms(x: np.ndarray) -> np.ndarray:
    """(1 + d + d * d, rows): 1, the coordinates and their products."""
    d = x.shape[1]
    return np.vstack([np.ones((1, len(x))), x.T, (x.T[:, None, :] * x.T[None, :, :]).reshape(d * d, len(x))])


class Densities:
    """The components of some mixtures side by side: what depends on parameters only is taken once."""

    def __init__(self, models: Sequence[Mixture]):
        self.ends = np.cumsum([m.k for m in models])
        d = models[0].mean.shape[1]
        low = [np.linalg.cholesky(c) for m in models for c in m.matrices()]
        self.root = np.vstack([np.linalg.inv(l) for l in low])                          # (components * d, d)
        mean = np.vstack([m.mean for m in models])
        self.shift = np.einsum("cij,cj->ci", self.root.reshape(-1, d, d), mean).reshape(-1, 1)
        with np.errstate(divide="ignore"):
            self.const = np.log(np.concatenate([m.weight for m in models])) - np.array([np.log(np.diag(l)).sum() for l in low]) - 0.5 * d * np.log(2 * np.pi)
        self.d = d

    def joint(self, x: np.ndarray) -> np.ndarray:
        """(components, rows): log of component weight times density."""
        z = self.root @ x.T
        z -= self.shift
        z *= z
        out = z.reshape(-1, self.d, len(x)).sum(axis=1)
        out *= -0.5
        out += self.const[:, None]
        return out

    def expect(self, x: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
        """Per mixture the ``sums`` of the rows by their shares, and the rows' log-likelihood."""
        joint, t = self.joint(x), terms(x)
        likelihood = []
        for a, b in zip([0, *self.ends], self.ends):
            part = joint[a:b]
            top = part.max(axis=0)
            part -= top
            np.exp(part, out=part)
            total = part.sum(axis=0)
            part /= total
            likelihood.append(float((top + np.log(total)).sum()))
        s = joint @ t.T
        return [s[a:b] for a, b in zip([0, *self.ends], self.ends)], likelihood


def sums(x: np.ndarray, share: np.ndarray) -> np.ndarray:
    """(k, 1 + d + d * d): weights, weighted sums and weighted products of rows."""
    return share.T @ terms(x).T


def maximised(kind: str, s: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, covariance) from the sums."""
    n = s[:, 0] + 10 * np.finfo(float).eps
    mean = s[:, 1 : 1 + d] / n[:, None]
    product = s[:, 1 + d :].reshape(-1, d, d)
    if kind == "tied":
        cov = (product.sum(axis=0) - (n[:, None, None] * mean[:, :, None] * mean[:, None, :]).sum(axis=0)) / n.sum() + FLOOR * np.eye(d)
    else:
        full = product / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        variance = np.maximum(np.diagonal(full, axis1=1, axis2=2), 0) + FLOOR
        cov = full + FLOOR * np.eye(d) if kind == "full" else variance if kind == "diag" else variance.mean(axis=1)
    return n / n.sum(), mean, cov


def fit_many(df: DataFrame, settings: Sequence[tuple[int, str]], seed: int = 1, iterations: int = 100, tol: float = 1e-3,
             features: str = "features") -> list[Mixture]:
    """Mixtures for the (components, covariance type) pairs; ``log_likelihood`` is that of the final
    parameters."""
    data = KM.narrow(df, features)
    first = data.select(F.size("a").alias("d")).first()
    if first is None:
        raise ValueError("no rows to fit")
    d = first["d"]
    ks = sorted({k for k, _ in settings})
    starts = dict(zip(ks, KM.fit_many(data, [KM.Fit(k, seed) for k in ks])))
    blocks = KM.packed(data, d).select("n", "x").persist(StorageLevel.MEMORY_AND_DISK)  # a lost block is made again from the checkpoint

    def total(fn, size: dict[int, int]) -> dict[int, np.ndarray]:
        out = {i: np.zeros(n) for i, n in size.items()}
        for r in blocks.mapInPandas(fn, "m int, pos int, v double").groupBy("m", "pos").agg(F.sum("v").alias("v")).collect():
            out[r["m"]][r["pos"]] = r["v"]  # mixtures x components x products
        return out

    def emit(acc: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
        for i, v in acc.items():
            yield pd.DataFrame({"m": np.full(len(v), i, np.int32), "pos": np.arange(len(v), dtype=np.int32), "v": v})

    width = 1 + d + d * d

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for b in batches:
            for r in b.itertuples(index=False):
                x = np.frombuffer(r.x).reshape(r.n, d)
                for at in range(0, r.n, ROWS):
                    yield x[at : at + ROWS]

    def by_label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = {k: np.zeros(len(m.centers) * width) for k, m in starts.items()}
        for x in rows(batches):
            for k, m in starts.items():
                acc[k] += sums(x, np.eye(len(m.centers))[KM._assign(x, m)[0]]).ravel()
        yield from emit(acc)

    hard = total(by_label, {k: len(m.centers) * width for k, m in starts.items()})
    models = []
    for k, kind in settings:
        s = hard[k].reshape(-1, width)
        models.append(Mixture(len(s), kind, *maximised(kind, s, d)))
    n = hard[ks[0]].reshape(-1, width)[:, 0].sum()
    last: dict[int, float] = {}
    while True:
        live = [i for i, m in enumerate(models) if not m.settled]
        if not live:
            blocks.unpersist()
            return models

        def expect(batches: Iterator[pd.DataFrame], live=live) -> Iterator[pd.DataFrame]:
            acc = {i: np.zeros(models[i].k * width + 1) for i in live}
            of = Densities([models[i] for i in live])
            for x in rows(batches):
                for i, s, ll in zip(live, *of.expect(x)):
                    acc[i][:-1] += s.ravel()
                    acc[i][-1] += ll
            yield from emit(acc)

        got = total(expect, {i: models[i].k * width + 1 for i in live})
        for i in live:
            m, v = models[i], got[i]
            m.log_likelihood = float(v[-1])
            mean = m.log_likelihood / n
            # the parameters that gave this likelihood are kept once it hardly moves
            if (i in last and abs(mean - last[i]) < tol) or m.iterations >= iterations:
                m.settled = True
                continue
            last[i] = mean
            m.weight, m.mean, m.covariance = maximised(m.kind, v[:-1].reshape(-1, width), d)
            m.iterations += 1


def labels_of(models: Sequence[Mixture], features: Column) -> Column:
    """Array of the likeliest component under every mixture, in one pass."""
    models = list(models)

    @F.pandas_udf("array<int>")
    def of(a: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=object)
        x, of = np.stack(a.to_numpy()), Densities(models)
        joint = of.joint(x)
        return pd.Series(list(np.column_stack([joint[p:q].argmax(axis=0) for p, q in zip([0, *of.ends], of.ends)]).astype(np.int32)), dtype=object)

    return of(vector_to_array(features))
