"""Many K-means fits over one table, side by side.

Restarts, values of k, bootstrap replicates, months and feature subsets are all fits
over the same rows. Fitting them one by one costs a chain of small jobs per fit; here
every Lloyd step of all unfinished fits is one distributed pass: ``mapInPandas`` assigns
each block of rows to the centres of every fit and emits partial sums, Spark adds them up
per (fit, coordinate), and the driver holds only the centres. Blocks are made once per call
(coordinates, hashes and weights as bytes) and kept by the executors, so that a pass neither reads
files nor builds an object per row.

Seeding is exact k-means++ in one pass per centre: a row is drawn with probability
proportional to weight x squared distance as the smallest ``-log(u) / (w d^2)`` (an
exponential race), with ``u`` from a hash of (row, seed, round). Every draw is a pure
function of the rows, so lost tasks repeat the same fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankline.session import spread

FEATURES = "features"
_U = np.uint64
DISTANCES = 65_536  # distances to one centre held at once: they stay in a core's cache
FIRST = 256         # rows of a block that are drawn from before the others, so that these have a key to beat
_SLACK = 1 + 1e-9   # for what bounds and distances are rounded by
PACKED = 8192       # rows of a block
GATHERED = 4_000_000    # numbers that a pass sends to the driver at most; beyond that Spark adds them up first


@dataclass(frozen=True)
class Fit:
    """One fit: ``weight`` indexes the array of row weights, ``group`` selects the rows of one
    group, ``dims`` the coordinates that count (None: all)."""
    k: int
    seed: int
    init: str = "k-means++"
    max_iter: int = 300
    weight: int | None = None
    group: str | None = None
    dims: tuple[int, ...] | None = None


@dataclass
class Centers:
    fit: Fit
    centers: np.ndarray
    cost: float = float("inf")
    iterations: int = 0
    mask: np.ndarray = field(default=None, repr=False)

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802  as pyspark.ml names it
        return list(self.centers)

    def transform(self, df: DataFrame, features: str = FEATURES, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, labels_of([self], F.col(features))[0])


def _assign(x: np.ndarray, m: Centers) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared distance) of every row."""
    y = x * m.mask
    d = (y * y).sum(axis=1)[:, None] - 2 * (y @ m.centers.T) + (m.centers * m.centers).sum(axis=1)
    best = d.argmin(axis=1)
    return best, np.maximum(d[np.arange(len(x)), best], 0)


def labels_of(models: Sequence[Centers], features: Column) -> Column:
    """Array of the labels under every model, in one pass."""
    models = list(models)

    @F.pandas_udf("array<int>")
    def of(a: pd.Series) -> pd.Series:
        x = np.stack(a.to_numpy()) if len(a) else np.zeros((0, len(models[0].mask)))
        return pd.Series(list(np.column_stack([_assign(x, m)[0] for m in models]).astype(np.int32)), dtype=object)

    return of(vector_to_array(features))


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """(0, 1) numbers from row hashes."""
    x = h ^ _U((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return (((x ^ (x >> _U(31))) >> _U(12)).astype(float) + 0.5) * 2.0**-52


def packed(data: DataFrame, d: int) -> DataFrame:
    """Blocks of the rows of ``narrow``, of one group each: number ``n``, coordinates ``x``, hashes ``h`` and,
    if given, weights ``w`` as bytes (of type ``kind``), and the group ``g``."""
    if "x" in data.columns:
        return data
    weighted, grouped = "w" in data.columns, "g" in data.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for every in batches:
            for group, b in every.groupby("g", sort=False, dropna=False) if grouped else [(None, every)]:
                for at in range(0, len(b), PACKED):
                    part = b.iloc[at : at + PACKED]
                    x = np.stack(part["a"].to_numpy()).reshape(len(part), d).astype(float)
                    out = {"n": [len(part)], "x": [x.tobytes()], "h": [part["h"].to_numpy(np.int64).tobytes()]}
                    if weighted:
                        w = np.stack(part["w"].to_numpy())
                        w = w.astype(float) if w.dtype == object else w
                        out |= {"w": [w.tobytes()], "kind": [w.dtype.str]}
                    if grouped:
                        out["g"] = [None if pd.isna(group) else group]
                    yield pd.DataFrame(out)

    return data.mapInPandas(run, "n int, x binary, h binary" + (", w binary, kind string" if weighted else "") + (", g string" if grouped else ""))


def _blocks(batches: Iterator[pd.DataFrame], d: int):
    """(coordinates, hashes, weights or None, group or None) of every block."""
    for b in batches:
        for r in b.itertuples(index=False):
            w = np.frombuffer(r.w, r.kind).reshape(r.n, -1) if "w" in b else None
            yield np.frombuffer(r.x).reshape(r.n, d), np.frombuffer(r.h, np.uint64), w, r.g if "g" in b else None


def _weight(m: Centers, n: int, w) -> np.ndarray:
    return np.ones(n) if m.fit.weight is None else w[:, m.fit.weight].astype(float)


def _seed_pass(data: DataFrame, models: list[Centers], step: int, d: int) -> None:
    """Draw the next centre of every fit that wants one."""
    live = [i for i, m in enumerate(models) if len(m.centers) < m.fit.k]
    data = packed(data, d)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[float, np.ndarray]] = {}
        for x, h, w, g in _blocks(batches, d):
            own = [i for i in live if models[i].fit.group is None or models[i].fit.group == g]
            for at, p in _weighed(models, own, w):
                y, hs = (x, h) if p is None else (x[p > 0], h[p > 0])
                p = np.ones(len(x)) if p is None else p[p > 0].astype(float)
                norm = (y * y).sum(axis=1)
                for i in at:
                    m = models[i]
                    far = len(m.centers) > 0 and m.fit.init == "k-means++"
                    # at least the weight times squared distance of every row
                    most = p * (2 * (norm + (m.centers * m.centers).sum(axis=1).min())) * _SLACK if far else p * _SLACK
                    # the first few rows give a key to beat: -log(u) is at least 1 - u, so most rows need neither log nor distance
                    for rows in (slice(0, FIRST), slice(FIRST, None)):
                        u = _uniform(hs[rows], m.fit.seed * 1009 + step + 1)
                        may = np.flatnonzero(1 - u <= best[i][0] * most[rows]) if i in best else np.arange(len(u))
                        if not len(may):
                            continue
                        z, q = y[rows][may], p[rows][may]
                        if len(m.centers):
                            dist = _assign(z, m)[1]
                            q = q * (dist if m.fit.init == "k-means++" else dist > 1e-12)
                        with np.errstate(divide="ignore"):
                            key = np.where(q > 0, -np.log(u[may]) / q, np.inf)
                        j = int(key.argmin())
                        if np.isfinite(key[j]) and (i not in best or key[j] < best[i][0]):
                            best[i] = (float(key[j]), z[j])
        if best:
            yield pd.DataFrame({"m": list(best), "key": [v[0] for v in best.values()], "a": [v[1] for v in best.values()]})

    got = (data.mapInPandas(run, "m int, key double, a array<double>").groupBy("m")
           .agg(F.min_by("a", "key").alias("a")).collect())  # one row per fit
    for r in got:
        m = models[r["m"]]
        m.centers = np.vstack([m.centers, np.array(r["a"]) * m.mask])
    for i in live:  # fewer different rows than centres
        if len(models[i].centers) <= step:
            models[i].fit = Fit(**{**models[i].fit.__dict__, "k": max(1, len(models[i].centers))})


def _alike(models: list[Centers], live: list[int]) -> list[list[int]]:
    """Fits with equally many centres over the same coordinates and rows: they share their steps."""
    out: dict[tuple, list[int]] = {}
    for i in live:
        f = models[i].fit
        out.setdefault((f.k, f.dims, f.group, f.weight is None), []).append(i)
    return list(out.values())


def total_of(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of the arrays of ``size`` numbers that the tasks of a pass return as bytes ``v``. They are
    gathered where they are few, otherwise Spark adds them up per number."""
    total = np.zeros(size)
    if parts.rdd.getNumPartitions() * size <= GATHERED:
        for r in parts.collect():
            total += np.frombuffer(r["v"])
        return total

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for v in b["v"]:
                yield pd.DataFrame({"pos": np.arange(size, dtype=np.int32), "v": np.frombuffer(v)})

    for r in parts.mapInPandas(each, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect():  # ``size`` rows
        total[r["pos"]] = r["v"]
    return total


def _weighed(models: list[Centers], which: Sequence[int], w):
    """(fits, weights of a block's rows or None) per column of weights: fits that share one share its rows."""
    of: dict = {}
    for i in which:
        of.setdefault(models[i].fit.weight, []).append(i)
    for column, fits in of.items():
        yield fits, None if column is None else np.ascontiguousarray(w[:, column])


def _step(c: np.ndarray, y: np.ndarray, one: np.ndarray, norm: np.ndarray, p: np.ndarray | None) -> np.ndarray:
    """Of fits with centres ``c`` (k, fits, coordinates) over rows ``y`` (coordinates, rows): per fit what
    ``_lloyd_pass`` adds up; ``one`` has the weights and weighted coordinates of the rows."""
    k, n, d = c.shape
    far = (c * c).sum(axis=2)
    low = (-2 * c[0]) @ y
    low += far[0][:, None]
    own = np.empty((k, n, y.shape[1]))
    best = np.zeros(low.shape, np.int16)
    for j in range(1, k):  # ties: the first centre
        dist = (-2 * c[j]) @ y
        dist += far[j][:, None]
        np.copyto(best, j, where=dist < low)
        np.minimum(low, dist, out=low)
    for j in range(k):
        np.equal(best, j, out=own[j])
    low += norm
    np.maximum(low, 0, out=low)
    sums = (own.reshape(k * n, -1) @ one).reshape(k, n, d + 1)
    return np.column_stack([sums.transpose(1, 2, 0).reshape(n, -1), low.sum(axis=1) if p is None else low @ p])


def _lloyd_pass(data: DataFrame, models: list[Centers], live: list[int], d: int) -> dict[int, np.ndarray]:
    """Per fit: for each centre the weight and the weighted sum of its rows, then the cost."""
    parts = _alike(models, live)
    data = packed(data, d)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = [np.zeros((len(part), models[part[0]].fit.k * (d + 1) + 1)) for part in parts]
        for x, _, w, g in _blocks(batches, d):
            for part, s in zip(parts, acc):
                m = models[part[0]]
                if m.fit.group is not None and m.fit.group != g:
                    continue
                k, place = m.fit.k, {i: n for n, i in enumerate(part)}
                for own, p in _weighed(models, part, w):
                    y, p = (x, None) if p is None else (x[p > 0], p[p > 0].astype(float))
                    y = y * m.mask
                    one, norm = np.column_stack([np.ones(len(y)), y]), (y * y).sum(axis=1)
                    if p is not None:
                        one *= p[:, None]
                    many = max(1, DISTANCES // max(1, len(y)))
                    for at in range(0, len(own), many):
                        some = own[at : at + many]
                        c = np.stack([models[i].centers for i in some], axis=1)     # (k, fits, coordinates)
                        for first in range(0, len(y), DISTANCES):
                            rows = slice(first, first + DISTANCES)
                            s[[place[i] for i in some]] += _step(c, y[rows].T, one[rows], norm[rows], None if p is None else p[rows])
        yield pd.DataFrame({"v": [np.concatenate([s.ravel() for s in acc]).tobytes()]})

    sizes = [(len(part), models[part[0]].fit.k * (d + 1) + 1) for part in parts]
    total = total_of(data.mapInPandas(run, "v binary"), sum(n * m for n, m in sizes))
    out, at = {}, 0
    for part, (n, m) in zip(parts, sizes):
        out |= dict(zip(part, total[at : at + n * m].reshape(n, m)))
        at += n * m
    return out


def narrow(df: DataFrame, features: str = FEATURES, weights: Column | None = None, group: Column | None = None) -> DataFrame:
    """What the fits read, checkpointed once: coordinates ``a``, row hash ``h`` and, if given,
    the array of weights ``w`` and the group ``g``."""
    extra = [] if weights is None else [weights.alias("w")]
    extra += [] if group is None else [group.cast("string").alias("g")]
    a = df.select(vector_to_array(features).alias("a"), *extra)
    return spread(a.withColumn("h", F.xxhash64("a", F.monotonically_increasing_id())).checkpoint(eager=True), "h")


def fit_many(data: DataFrame, fits: Sequence[Fit], tol: float = 1e-4) -> list[Centers]:
    """Fit all of ``fits`` on a table of ``narrow``; ``tol`` is relative to the mean variance
    of the coordinates, as in the reference."""
    first = data.select(F.size("a").alias("d")).first()
    if first is None:
        raise ValueError("no rows to cluster")
    d = first["d"]
    var = data.agg(*[F.var_pop(F.col("a")[i]).alias(str(i)) for i in range(d)]).first()
    var = np.array([float(v or 0.0) for v in var])
    models = []
    data = packed(data, d).persist(StorageLevel.MEMORY_AND_DISK)  # a lost block is made again from the checkpoint
    for f in fits:
        mask = np.ones(d) if f.dims is None else np.isin(np.arange(d), f.dims).astype(float)
        models.append(Centers(f, np.zeros((0, d)), mask=mask))
    for step in range(max(f.k for f in fits)):
        if any(len(m.centers) < m.fit.k for m in models):
            _seed_pass(data, models, step, d)
    limit = [tol * float((var * m.mask).sum() / m.mask.sum()) for m in models]
    live, last = list(range(len(models))), []
    while live or last:
        sums = _lloyd_pass(data, models, sorted(live + last), d)
        for i in last:
            models[i].cost = float(sums[i][-1])
        still = []
        for i in live:
            m, s = models[i], sums[i]
            k = m.fit.k
            m.cost, m.iterations = float(s[-1]), m.iterations + 1
            weight, total = s[:k], s[k:-1].reshape(d, k).T
            new = np.where(weight[:, None] > 0, total / np.maximum(weight, 1e-300)[:, None], m.centers)
            shift = float(((new - m.centers) ** 2).sum())
            if shift > 0:
                m.centers = new
                still.append((i, shift > limit[i] and m.iterations < m.fit.max_iter))
        live = [i for i, more in still if more]
        # fits that have settled are in one more pass for the cost at their last centres
        last = [i for i, more in still if not more]
    data.unpersist()
    return models


def best(models: Sequence[Centers]) -> Centers:
    """The fit with the lowest cost; ties go to the lowest seed."""
    return min(models, key=lambda m: (m.cost, m.fit.seed))
