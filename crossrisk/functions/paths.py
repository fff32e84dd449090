"""Windows over the price paths of entities, on Arrow batches that Spark has dealt by entity and sorted by entity and day.

An entity has one row per calendar day at most, so it fits into a task; the rows of many entities are worked on together and
never copied to the windows that contain them.  The module is pickled by value, so executors need only numpy and pyarrow.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 1 << 16    # rows of whole entities worked on at once
NO_DAY = -(1 << 31)     # a null day sorts first
SPAN = 1 << 33          # between the keys of two entities


def by_entity(kernel, keys=("entity",)):
    """Calls ``kernel`` with the rows of whole entities, as a table and the number of the entity of every row.

    ``keys`` name an entity; rows come sorted by them.
    """
    def run(batches):
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + len(batch)
            if n < BLOCK_ROWS:
                continue
            rows, who = numbered(held, keys)
            cut = int(np.searchsorted(who, who[-1]))
            if cut:
                yield from _batches(kernel(rows.slice(0, cut), who[:cut]))
            held = rows.slice(cut).to_batches()
            n = len(rows) - cut
        if n:
            yield from _batches(kernel(*numbered(held, keys)))
    return run


def _batches(made):
    return made if isinstance(made, list) else [made]


def numbered(batches, keys=("entity",)):
    rows = pa.Table.from_batches(batches).combine_chunks()
    new = np.zeros(max(len(rows) - 1, 0), dtype=bool)
    for key in keys:
        codes = rows[key].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
        codes = codes.indices.to_numpy(zero_copy_only=False)
        new |= codes[1:] != codes[:-1]
    return rows, np.concatenate([[0], np.cumsum(new)]).astype(np.int64)


def days_of(rows, who):
    """Sorted key of entity and day."""
    return who * SPAN + rows["date"].cast(pa.int32()).fill_null(NO_DAY).to_numpy().astype(np.int64)


def column(rows, name):
    """Values, zero for null, and which are not null."""
    data = rows[name].cast(pa.float64())
    return data.fill_null(0.0).to_numpy(), data.is_valid().to_numpy()


def nullable(values, known):
    return pa.array(values, pa.float64(), mask=~known)


def batch_of(columns: dict):
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns.values()],
                                      names=list(columns))


def trailing(n, values, width: int):
    """Sum of ``values`` over the last ``width`` rows of the entity; ``n`` numbers its rows from 1."""
    out = values.copy()
    for j in range(1, min(width, len(values))):
        out[j:] += np.where(n[j:] > j, values[:-j], 0)
    return out


def signals(rows, who, yearly: float):
    """Momentum, volatility and relative volume at every row."""
    key = days_of(rows, who)
    close, has_close = column(rows, "adj_close")
    volume, has_volume = column(rows, "volume")
    first = np.searchsorted(who, who)
    n = np.arange(len(who)) - first + 1
    with np.errstate(all="ignore"):
        prev = np.maximum(np.arange(len(who)) - 1, 0)
        has_ret = (n > 1) & has_close & has_close[prev] & (close[prev] != 0)
        ret = np.where(has_ret, close / np.where(close[prev] == 0, 1.0, close[prev]) - 1, 0.0)

        def momentum(days: int):
            at = np.searchsorted(key, key - days, "right") - 1
            then = close[np.maximum(at, 0)]
            known = (at >= first) & has_close[np.maximum(at, 0)] & ~(then <= 0) & (n >= 10) & has_close
            return nullable(np.where(known, close / then - 1, 0.0), known)

        count = trailing(n, has_ret.astype(np.int64), 60)
        mean = trailing(n, ret, 60) / count
        square = np.where(has_ret, (ret - mean) ** 2, 0.0)
        for j in range(1, min(60, len(who))):       # about the mean of the window that ends in the row
            square[j:] += np.where((n[j:] > j) & has_ret[:-j], (ret[:-j] - mean[j:]) ** 2, 0.0)
        has_vol = (n >= 30) & (count > 1)
        vol = np.sqrt(square / (count - 1)) * yearly
        c20, c60 = (trailing(n, has_volume.astype(np.int64), w) for w in (20, 60))
        v20, v60 = (trailing(n, volume, w) / c for w, c in ((20, c20), (60, c60)))
        has_rel = (n >= 60) & (c20 > 0) & (c60 > 0) & ~(v60 <= 0)
        return batch_of({
            "entity": rows["entity"], "date": rows["date"], "adj_close": nullable(close, has_close),
            "volume": nullable(volume, has_volume), "momentum_30d": momentum(30), "momentum_90d": momentum(90),
            "volatility_60d": nullable(np.where(has_vol, vol, 0.0), has_vol),
            "relative_volume": nullable(np.where(has_rel, v20 / v60, 0.0), has_rel)})


def drawdowns(close, has_close, lo, hi):
    """Largest fall from the running peak inside every slice of rows, and whether there is one."""
    order = np.argsort(lo - hi, kind="stable")
    start, size = lo[order], (hi - lo)[order]
    peak, worst = np.full(len(lo), -np.inf), np.full(len(lo), -np.inf)
    for j in range(int(size.max(initial=0))):       # rows of the longest slice, one per calendar day at most
        m = int(np.searchsorted(-size, -j))         # slices with more than j rows
        p, ok = close[start[:m] + j], has_close[start[:m] + j]
        peak[:m] = np.where(ok, np.maximum(peak[:m], p), peak[:m])
        ok &= peak[:m] != 0
        worst[:m] = np.where(ok, np.maximum(worst[:m], (peak[:m] - p) / peak[:m]), worst[:m])
    out = np.empty(len(lo))
    out[order] = worst
    return np.where(out == -np.inf, 0.0, out), out != -np.inf


def forward(rows, who, since, until, ends: dict, dd_end):
    """First and last prices and counts of every window [since, until] up to its ends, and its drawdown.

    The windows are those of all dates, as day numbers; an end below its ``since`` is none.
    """
    key = days_of(rows, who)
    close, has_close = column(rows, "adj_close")
    heads = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    base = (np.arange(len(heads)) * SPAN)[:, None]
    at = lambda days, side: np.searchsorted(key, (base + days).ravel(), side)
    lo, hi = at(since, "left"), at(until, "right")
    some = hi > lo
    entity, when = np.repeat(heads, len(since))[some], np.tile(since, len(heads))[some]
    lo, hi = lo[some], hi[some]
    stop = lambda end: np.clip(at(end, "right")[some], lo, hi)
    out = {"entity": rows["entity"].take(pa.array(entity)), "as_of": pa.array(when.astype(np.int32)).cast(pa.date32()),
           "_first": nullable(close[lo], has_close[lo])}
    for name, end in ends.items():
        e = stop(end)
        out[f"_last_{name}"] = nullable(close[np.maximum(e - 1, lo)], (e > lo) & has_close[np.maximum(e - 1, lo)])
        out[f"_n_{name}"] = pa.array(e - lo, pa.int64())
    e = stop(dd_end)
    with np.errstate(all="ignore"):
        fall, known = drawdowns(close, has_close, lo, e)
    return batch_of(out | {"_mdd": nullable(fall, known), "_n_dd": pa.array(e - lo, pa.int64())})


def running(start, size, step: int, cols, ok):
    """Counts, means and central co-moments of ``cols`` from the first row of every block up to each of its rows.

    Blocks begin at ``start`` and go up (``step`` 1) or down (-1); rows that are not ``ok`` count nothing.  One update for the
    j-th rows of all blocks, so a column that is constant so far has a variance of exactly zero.
    """
    k, pairs = len(cols), [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    n, mean, co = np.zeros(len(start)), np.zeros((k, len(start))), np.zeros((len(pairs), len(start)))
    out_n, out_mean, out_co = np.zeros(len(ok)), np.zeros((k, len(ok))), np.zeros((len(pairs), len(ok)))
    for j in range(int(size.max(initial=0))):
        m = int(np.searchsorted(-size, -j))         # blocks with more than j rows
        at = start[:m] + step * j
        good = ok[at]
        n[:m] += good
        gap = np.where(good, cols[:, at] - mean[:, :m], 0.0)
        mean[:, :m] += gap / np.maximum(n[:m], 1)
        left = np.where(good, cols[:, at] - mean[:, :m], 0.0)
        for q, (a, b) in enumerate(pairs):
            co[q, :m] += gap[a] * left[b]
        out_n[at], out_mean[:, at], out_co[:, at] = n[:m], mean[:, :m], co[:, :m]
    return out_n, out_mean, out_co / np.maximum(out_n, 1)


def window_parts(who, cols, ok, window: int):
    """Counts, means and population co-moments over the last ``window`` rows of the entity.

    The rows of an entity are cut into blocks; a window is what is left of one block and the start of the next, merged in
    central form.
    """
    at = np.arange(len(who))
    place = at - np.searchsorted(who, who)
    start = np.flatnonzero(place % window == 0)
    size = np.diff(np.append(start, len(who)))
    n, mean, cov = running(start, size, 1, cols, ok)
    rest = running(start + size - 1, size, -1, cols, ok)
    more = np.flatnonzero((place >= window) & (place % window < window - 1))
    n_rest, mean_rest, cov_rest = (a[..., more - window + 1] for a in rest)
    total = n[more] + n_rest
    share = np.where(total > 0, n_rest / np.maximum(total, 1), 0.0)
    gap = mean_rest - mean[:, more]
    q = 0
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            cov[q, more] = cov[q, more] * (1 - share) + cov_rest[q] * share + gap[i] * gap[j] * share * (1 - share)
            q += 1
    mean[:, more] += gap * share
    n[more] = total
    return n, mean, cov


def columns(rows, names):
    """Values of several columns, zero where one of them is null, and the rows that have all."""
    parts = [column(rows, c) for c in names]
    ok = np.logical_and.reduce([known for _, known in parts])
    return np.array([np.where(ok, values, 0.0) for values, _ in parts]), ok


def lists(values):
    """One list per row from an array of columns by rows."""
    flat = np.ascontiguousarray(values.T).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(values.shape[1] + 1) * len(values), pa.int32()), pa.array(flat))


def windowed(rows, who, names, window: int):
    """``rows`` with counts, means and co-moments of ``names`` over the last ``window`` rows."""
    cols, ok = columns(rows, names)
    n, mean, cov = window_parts(who, cols, ok, window)
    return batch_of({c: rows[c] for c in rows.column_names} | {
        "_n": pa.array(n.astype(np.int64)), "_means": lists(mean), "_cov": lists(cov)})


def rolled(rows, who, keep, names, window: int):
    """Intercept and slopes of the first of ``names`` on the others in every full window, as ``kernels.least_squares`` has them."""
    cols, ok = columns(rows, names)
    n, mean, cov = window_parts(who, cols, ok, window)
    full = np.flatnonzero(n == window)
    k, mean, cov = len(names) - 1, mean[:, full], cov[:, full] * window
    if k == 1:
        slope = np.where(cov[2] != 0, cov[1] / np.where(cov[2] != 0, cov[2], 1.0), 0.0)[None]
    else:
        pairs = {q: at for at, q in enumerate((i, j) for i in range(k + 1) for j in range(i, k + 1))}
        inner = np.array([[cov[pairs[min(i, j), max(i, j)]] for j in range(1, k + 1)] for i in range(1, k + 1)])
        inner = np.linalg.pinv(inner.transpose(2, 0, 1), rcond=1e-13, hermitian=True)
        slope = np.einsum("nij,jn->in", inner, cov[1:k + 1])
    first = mean[0] - (mean[1:] * slope).sum(axis=0)
    taken = pa.array(full)
    return batch_of({c: rows[c].take(taken) for c in keep} | {"beta": lists(np.concatenate([first[None], slope]))})


def one_factor_fits(rows, who, keys, y, xs: dict, lags: int, least: int):
    """Moments of ``y`` and every single column of ``xs``, with the cross products of the HAC scores, per entity.

    Rows without either value are left out first; entities with fewer than ``least`` others have no row.  Sums are about the
    entity's first value, so a constant column has a variance of exactly zero.
    """
    out = []
    for name, x in xs.items():
        cols, ok = columns(rows, [y, x])
        at = np.flatnonzero(ok & ~np.isnan(cols).any(axis=0))
        entity, (v, w) = who[at], cols[:, at]
        heads = np.flatnonzero(np.concatenate([[True], entity[1:] != entity[:-1]])) if len(at) else at
        size = np.diff(np.append(heads, len(at)))
        total = lambda a: np.add.reduceat(a, heads) if len(heads) else np.zeros(0)  # noqa: E731, B023
        each = lambda a: np.repeat(a, size)  # noqa: E731, B023
        mean, central = [], []
        for a in (v, w):
            shifted = a - each(a[heads])
            m = total(shifted) / size
            mean.append(a[heads] + m)
            central.append(shifted - each(m))
        cov = [total(a * b) / size for a, b in ((central[0], central[0]), (central[0], central[1]), (central[1], central[1]))]
        slope = np.where(cov[2] != 0, cov[1] / np.where(cov[2] != 0, cov[2], 1.0), 0.0)
        e = v - (each(mean[0] - mean[1] * slope) + each(slope) * w)
        n = np.arange(len(at)) - each(heads)
        score, late = [e, w * e], [np.zeros(len(at)), np.zeros(len(at))]
        for lag in range(1, min(lags, len(at) - 1) + 1):
            for s, u in zip(score, late):
                u[lag:] += np.where(n[lag:] >= lag, s[:-lag], 0.0) * (1.0 - lag / (lags + 1))
        meat = [total(score[i] * score[j] + score[i] * late[j] + late[i] * score[j]) for i, j in ((0, 0), (0, 1), (1, 1))]
        keep = np.flatnonzero(size >= least)
        some = pa.array(at[heads[keep]], pa.int64())
        part = lambda many: lists(np.array(many)[:, keep])  # noqa: E731, B023
        out.append(batch_of({c: rows[c].take(some) for c in keys} | {
            "which": pa.array([name] * len(keep), pa.string()), "n": pa.array(size[keep], pa.int64()),
            "means": part(mean), "cov": part(cov), "meat": part(meat)}))
    return pa.Table.from_batches(out).combine_chunks().to_batches()
