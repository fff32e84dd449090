"""Dense algebra on rows that Spark has already reduced: one small matrix per row, or one bounded tile.

These run inside ``mapInPandas`` / ``applyInPandas``.  The module is pickled by value, so executors need only numpy
and pandas.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEW_DIMS = 8        # up to here direct differences cost no more than products
CLOSE = 1e-5        # of the squared lengths


def unpack(flat, k: int) -> np.ndarray:
    """Symmetric matrix from its upper triangle, row by row."""
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = np.asarray(flat, dtype=float)
    return m + np.triu(m, 1).T


def least_squares(n: int, mean: np.ndarray, cov: np.ndarray):
    """Coefficients (intercept first) and (X'X)^-1 from centered moments of [y, x1..xk]."""
    my, mx = mean[0], mean[1:]
    sxx, sxy = cov[1:, 1:] * n, cov[1:, 0] * n
    inner = np.linalg.pinv(sxx, rcond=1e-13, hermitian=True)
    slope = inner @ sxy
    beta = np.concatenate([[my - mx @ slope], slope])
    cross = -inner @ mx
    inv = np.empty((len(mx) + 1, len(mx) + 1))
    inv[0, 0] = 1.0 / n + mx @ inner @ mx
    inv[0, 1:] = inv[1:, 0] = cross
    inv[1:, 1:] = inner
    return beta, inv


def variance_inflation(cov: np.ndarray) -> list:
    """Diagonal of the inverse correlation matrix; one column gives 1, an exactly dependent one gives null."""
    k = cov.shape[0]
    if k < 2:
        return [1.0] * k
    sd = np.sqrt(np.diag(cov))
    if (sd == 0).any():
        return [None] * k
    corr = cov / np.outer(sd, sd)
    try:
        if np.linalg.cond(corr) > 1e13:
            return [None] * k
        return [float(v) for v in np.diag(np.linalg.inv(corr))]
    except np.linalg.LinAlgError:
        return [None] * k


def fitted(n: int, mean: np.ndarray, cov: np.ndarray) -> tuple:
    """Coefficients, (X'X)^-1, fit and inflation from the moments of [y, x1..xk]."""
    beta, inv = least_squares(n, mean, cov)
    ssr = max(n * (cov[0, 0] - beta[1:] @ cov[1:, 0]), 0.0)
    tss = n * cov[0, 0]
    r2 = 1.0 - ssr / tss if tss > 0 else None
    df = n - len(mean)
    adj = 1.0 - (1.0 - r2) * (n - 1) / df if r2 is not None and df > 0 else None
    return (n, beta.tolist(), inv.ravel().tolist(), r2, adj, math.sqrt(ssr / df) if df > 0 else None,
            variance_inflation(cov[1:, 1:]), mean.tolist())


FITTED = ["n", "beta", "inv", "r2", "adj_r2", "resid_std", "vif", "means"]


def solver(keys: list[str], k: int):
    """Moment rows to coefficient rows."""
    def run(batches):
        for pdf in batches:
            rows = [(*[getattr(r, c) for c in keys], *fitted(int(r.n), np.asarray(r.means, dtype=float), unpack(r.cov, k + 1)))
                    for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[*keys, *FITTED])
    return run


def cube_solver(keys: list[str], k: int, controls: int):
    """Sums over products of [1, x1..xk, y] (standardized) to coefficient rows with the HAC meat.

    The last k - controls regressors are replaced by their residuals on the first ones if there are controls.
    """
    pairs = [(i, j) for i in range(k + 2) for j in range(i, k + 2)]
    place = {q: at for at, q in enumerate(pairs)}
    p = len(pairs) - 1
    y_first = [k, *range(k)]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                sums, center, scale = (np.asarray(c, dtype=float) for c in (r.sums, r.center, r.scale))
                second = unpack(sums[:p + 1], k + 2)
                n = int(round(second[0, 0]))
                mean = second[0, 1:] / n
                cov = second[1:, 1:] / n - np.outer(mean, mean)
                order = np.ix_(y_first, y_first)
                beta, _ = least_squares(n, mean[y_first], cov[order])
                error = np.concatenate([-beta, [1.0]])          # of y against [1, x]
                score = np.zeros((k + 1, p))
                for a in range(k + 1):
                    for b in range(k + 2):
                        score[a, place[min(a, b), max(a, b)]] += error[b]
                meat = score @ unpack(sums[p + 1:], p) @ score.T
                units = np.diag([1.0, *scale[:k]])
                units[1:, 0] = center[:k]
                meat = units @ meat @ units.T * scale[k] ** 2
                mean, cov = mean * scale + center, cov * np.outer(scale, scale)
                if controls:
                    c = slice(0, controls)
                    gamma = np.linalg.pinv(cov[c, c], rcond=1e-13, hermitian=True) @ cov[c, controls:k]
                    left = np.eye(k + 2)
                    left[1:controls + 1, controls + 1:k + 1] = -gamma
                    left[0, controls + 1:k + 1] = mean[c] @ gamma - mean[controls:k]
                    meat = left[:k + 1, :k + 1].T @ meat @ left[:k + 1, :k + 1]
                    cov = left[1:, 1:].T @ cov @ left[1:, 1:]
                    mean = mean.copy()
                    mean[controls:k] = 0.0
                rows.append((*[getattr(r, c) for c in keys], *fitted(n, mean[y_first], cov[order]),
                             meat[np.triu_indices(k + 1)].tolist()))
            yield pd.DataFrame(rows, columns=[*keys, *FITTED, "meat"])
    return run


def normal_p(t: float) -> float:
    return math.erfc(abs(t) / math.sqrt(2.0))


Z95 = 1.959963984540054     # fixed value: two-sided 95% normal quantile


def sandwich(keys: list[str], names: list[str]):
    """Coefficients and score cross products to one row per estimate, intercept first."""
    k = len(names) + 1

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                inv = np.asarray(r.inv, dtype=float).reshape(k, k)
                cov = inv @ unpack(r.meat, k) @ inv
                for i, name in enumerate(["const", *names]):
                    b, v = float(r.beta[i]), float(cov[i, i])
                    se = math.sqrt(v) if v > 0 else None
                    t = b / se if se else None
                    vif = None if i == 0 else r.vif[i - 1]
                    total = None if i == 0 else float(r.means[i]) * int(r.n)
                    rows.append((*[getattr(r, c) for c in keys], name, b, se, t,
                                 None if t is None else normal_p(t),
                                 None if se is None else b - Z95 * se, None if se is None else b + Z95 * se,
                                 None if vif is None or not np.isfinite(vif) else float(vif),
                                 total, None if total is None else b * total,
                                 int(r.n), r.r2, r.adj_r2, r.resid_std))
            yield pd.DataFrame(rows, columns=[*keys, "factor", "beta", "std_err", "t_stat", "p_value", "ci_low",
                                              "ci_high", "vif", "factor_move", "contribution", "n", "r2", "adj_r2",
                                              "resid_std"])
    return run


def sandwiched(keys: list[str], names: list[str]):
    """Moment rows with score cross products to one row per estimate, as ``solver`` and ``sandwich`` one after the other."""
    solve, finish = solver(keys, len(names)), sandwich(keys, names)

    def run(batches):
        for pdf in batches:
            yield from finish(coef.assign(meat=pdf["meat"].to_numpy()) for coef in solve([pdf]))
    return run


def projections(keys: list[str], n_controls: int, n_targets: int):
    """Regress every target on [1, controls]; coefficients per target, flattened."""
    def run(batches):
        for pdf in batches:
            out = []
            for n, means, flat in zip(pdf["n"], pdf["means"], pdf["cov"]):
                means, cov = np.asarray(means, dtype=float), unpack(flat, n_controls + n_targets)
                ctrl = list(range(n_controls))
                gamma = []
                for j in range(n_controls, n_controls + n_targets):
                    pick = [j, *ctrl]
                    gamma.extend(least_squares(int(n), means[pick], cov[np.ix_(pick, pick)])[0].tolist())
                out.append(gamma)
            yield pdf[keys].assign(gamma=out)
    return run


def _principal(mean, cov, n, k, ddof):
    """Standard deviations, eigenvalues and signed eigenvectors of the correlation matrix, largest first."""
    cov = cov * (n / (n - ddof)) if n > ddof else cov
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    sd = np.where(sd > 0, sd, 1.0)
    val, vec = np.linalg.eigh(cov / np.outer(sd, sd))
    order = np.argsort(val)[::-1]
    val, vec = np.clip(val[order], 0, None), vec[:, order]
    peak = vec[np.abs(vec).argmax(axis=0), np.arange(vec.shape[1])]
    return sd, val, vec * np.where(peak < 0, -1.0, 1.0)


def components(keys: list[str], names: list[str], k: int, ddof: int = 0, subsets: dict | None = None):
    """Moment rows to principal components of the correlation matrix.

    One output row per (component, name): loading, eigenvalue, share of variance, and the scaler.  A zero standard
    deviation counts as one; each component's largest absolute loading is positive.  ``subsets`` fits one model per
    named subset of the columns; columns outside it load zero.
    """
    plans = {None: list(range(len(names)))} if subsets is None else {
        c: [names.index(f) for f in fs] for c, fs in subsets.items()}
    extra = [] if subsets is None else ["config"]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                n, mean, cov = int(r.n), np.asarray(r.means, dtype=float), unpack(r.cov, len(names))
                for config, pick in plans.items():
                    sd, val, vec = _principal(mean[pick], cov[np.ix_(pick, pick)], n, k, ddof)
                    total = val.sum()
                    for c in range(min(k, len(pick))):
                        load, dev = np.zeros(len(names)), np.ones(len(names))
                        load[pick], dev[pick] = vec[:, c], sd
                        head = [getattr(r, x) for x in keys] + ([config] if extra else [])
                        for j, name in enumerate(names):
                            rows.append((*head, f"PC{c + 1}", name, float(load[j]), float(val[c]),
                                         float(val[c] / total) if total > 0 else None, float(mean[j]), float(dev[j]), n))
            yield pd.DataFrame(rows, columns=[*keys, *extra, "pc", "feature", "loading", "eigenvalue",
                                              "variance_ratio", "mean", "std", "n"])
    return run


def standard_vectors(days: list[int]):
    """Entity rows of (day numbers, returns) to calendar-length z-vectors: missing days zero, sample deviation.

    Entities without variance are dropped.
    """
    grid = np.asarray(days)

    def run(batches):
        for pdf in batches:
            ids, out = [], []
            for entity, day, ret in zip(pdf["entity"], pdf["day"], pdf["ret"]):
                x = np.zeros(len(grid))
                x[np.searchsorted(grid, np.asarray(day))] = np.asarray(ret, dtype=float)
                sd = x.std(ddof=1) if len(x) > 1 else 0.0
                if sd > 0:
                    ids.append(entity)
                    out.append((x - x.mean()) / sd)
            yield pd.DataFrame({"entity": pd.Series(ids, dtype=pdf["entity"].dtype), "z": out})
    return run


def entity_loadings(basis: np.ndarray, pcs: list[str]):
    """z-vectors times the scaled day basis: one row per entity and component."""
    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            load = np.stack([np.asarray(v, dtype=float) for v in pdf["z"]]) @ basis
            yield pd.DataFrame({"entity": np.repeat(pdf["entity"].to_numpy(), len(pcs)), "pc": pcs * len(pdf),
                                "loading": load.ravel()})
    return run


def gram_times(block: np.ndarray):
    """Z'(Z V) over the vectors of one partition, as cells of the day x columns result."""
    def run(batches):
        out = np.zeros(block.shape)
        for pdf in batches:
            if len(pdf):
                z = np.stack([np.asarray(v, dtype=float) for v in pdf["z"]])
                out += z.T @ (z @ block)
        i, j = np.indices(block.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": out.ravel()})
    return run


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances: by direct differences in few dimensions; in many by products, and pairs too close for these directly."""
    if a.shape[1] <= FEW_DIMS or not (np.isfinite(a).all() and np.isfinite(b).all()):
        out = np.zeros((a.shape[0], b.shape[0]))
        for j in range(a.shape[1]):
            diff = a[:, j][:, None] - b[:, j][None, :]
            out += diff * diff
        return np.sqrt(out)
    middle = b.mean(0)
    a, b = a - middle, b - middle
    size = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    out = size - 2 * (a @ b.T)
    i, j = np.nonzero(out < CLOSE * size)           # most of their digits are lost in the difference
    for lo in range(0, len(i), 1 << 14):
        diff = a[i[lo:lo + (1 << 14)]] - b[j[lo:lo + (1 << 14)]]
        out[i[lo:lo + (1 << 14)], j[lo:lo + (1 << 14)]] = (diff * diff).sum(1)
    return np.sqrt(out)
