"""Exact and likelihood-ratio tests of two groups of methylation counts, vectorised over loci."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))]) if n else np.zeros(1)


def fisher_two_sided(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Two-sided exact test of the tables (a, b; c, d): the sum of all tables no likelier than the observed one."""
    a, b, c, d = (np.asarray(x, np.int64) for x in (a, b, c, d))
    out = np.ones(len(a))
    if not len(a):
        return out
    lf = _log_factorials(int((a + b + c + d).max()))
    # Loci with like tables are computed once, the rest in blocks of bounded size.
    tables, back = np.unique(np.stack([a, b, c, d], 1), axis=0, return_inverse=True)
    p = np.ones(len(tables))
    a, b, c, d = tables.T
    m, n, k = a + c, b + d, a + b
    lo, hi = np.maximum(0, k - n), np.minimum(k, m)
    order = np.argsort(hi - lo, kind="stable")
    at = 0
    while at < len(order):
        width = int((hi - lo)[order[min(at + 4096, len(order)) - 1]]) + 1
        rows = order[at : at + max(1, min(4096, 4_000_000 // width))]
        at += len(rows)
        width = int((hi - lo)[rows].max()) + 1
        i = lo[rows, None] + np.arange(width)
        valid = i <= hi[rows, None]
        i = np.minimum(i, hi[rows, None])
        M, N, K = m[rows, None], n[rows, None], k[rows, None]
        const = lf[M] + lf[N] - lf[M + N] + lf[K] + lf[M + N - K]
        logp = const - lf[i] - lf[M - i] - lf[K - i] - lf[N - K + i]
        seen = np.take_along_axis(logp, (a[rows] - lo[rows])[:, None], 1)
        # A table as likely as the observed one counts, whatever the rounding of its logarithm.
        p[rows] = np.where(valid & (logp <= seen + 1e-9), np.exp(logp), 0.0).sum(1)
    return np.minimum(p, 1.0)[back.ravel()]


def fisher_counts(m1, c1, m2, c2, table: str = "totals") -> np.ndarray:
    """Fisher's test of two levels. 'totals' sets the counts against the coverages, 'standard' against the unmethylated counts."""
    m1, c1, m2, c2 = (np.asarray(x, np.int64) for x in (m1, c1, m2, c2))
    if table == "standard":
        c1, c2 = c1 - m1, c2 - m2
    elif table != "totals":
        raise ValueError("table is 'totals' or 'standard'")
    return fisher_two_sided(m1, c1, m2, c2)


def _evaluate(theta: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative beta-binomial log-likelihood and its gradient, for many loci at once.

    theta (loci, factors + 1) holds the logits of the level's factors and of the
    dispersion, x (loci, samples, factors) the design, y and n (loci, samples) the
    counts. Padding samples have n = 0 and add nothing.
    """
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        p = 1 / (1 + np.exp(-np.einsum("bsf,bf->bs", x, theta[:, :-1])))[..., None]
        phi = (1 / (1 + np.exp(-theta[:, -1])))[:, None, None]
        k = np.arange(max(1, int(n.max())), dtype=float)
        my, mu, mn = k < y[..., None], k < (n - y)[..., None], k < n[..., None]
        up, dn, dd = (1 - phi) * p + phi * k, (1 - phi) * (1 - p) + phi * k, 1 + phi * (k - 1)
        sums = lambda m, v: np.where(m, v, 0.0).sum(2)
        ll = (sums(my, np.log(up)) + sums(mu, np.log(dn)) - sums(mn, np.log(dd))).sum(1)
        slope = (sums(my, 1 / up) - sums(mu, 1 / dn)) * ((1 - phi) * p * (1 - p))[..., 0]
        g_level = np.einsum("bs,bsf->bf", slope, x)
        g_phi = (sums(my, (k - p) / up) + sums(mu, (k - (1 - p)) / dn) - sums(mn, (k - 1) / dd)).sum(1) * (phi * (1 - phi))[:, 0, 0]
    return -ll, -np.concatenate([g_level, g_phi[:, None]], 1)


def fit_beta_binomial(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Greatest log-likelihood of the beta-binomial regression per locus, by BFGS over all loci together.

    Starts at level logits 0 and dispersion logit -2.5. Logits are kept within
    +-30, where the likelihood is flat; NaN where it can't be evaluated.
    """
    B, P = len(y), x.shape[2] + 1
    theta = np.concatenate([np.zeros((B, P - 1)), np.full((B, 1), -2.5)], 1)
    f, g = _evaluate(theta, x, y, n)
    h = np.tile(np.eye(P), (B, 1, 1))
    live = np.isfinite(f) & np.isfinite(g).all(1)
    failed = ~live
    for _ in range(rounds):
        live &= np.abs(g).max(1) >= 1e-6
        i = np.flatnonzero(live)
        if not len(i):
            break
        step = -np.einsum("bij,bj->bi", h[i], g[i])
        slope = (step * g[i]).sum(1)
        uphill = slope > -1e-14
        h[i[uphill]] = np.eye(P)
        step[uphill] = -g[i[uphill]]
        slope = (step * g[i]).sum(1)
        t = np.minimum(1.0, 5 / np.maximum(np.abs(step).max(1), 1e-12))
        new, fn, gn = theta[i].copy(), f[i].copy(), g[i].copy()
        todo = np.arange(len(i))
        for _ in range(34):
            j = i[todo]
            trial = np.clip(theta[j] + t[todo, None] * step[todo], -30, 30)
            ft, gt = _evaluate(trial, x[j], y[j], n[j])
            good = np.isfinite(ft) & np.isfinite(gt).all(1) & (ft <= f[j] + 1e-4 * t[todo] * slope[todo])
            k = todo[good]
            new[k], fn[k], gn[k] = trial[good], ft[good], gt[good]
            todo = todo[~good]
            if not len(todo):
                break
            t[todo] /= 2
        s, q = new - theta[i], gn - g[i]
        sq = (s * q).sum(1)
        curve = sq > 1e-12
        c = i[curve]
        if len(c):
            sc, qc, r = s[curve], q[curve], 1 / sq[curve]
            left = np.eye(P) - r[:, None, None] * np.einsum("bi,bj->bij", sc, qc)
            h[c] = left @ h[c] @ left.transpose(0, 2, 1) + r[:, None, None] * np.einsum("bi,bj->bij", sc, sc)
        live[i[f[i] - fn < 1e-10]] = False
        theta[i], f[i], g[i] = new, fn, gn
    return np.where(failed, np.nan, -f)


def chi2_upper(x: float) -> float:
    """P(chi-square with 1 degree of freedom > x)."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def group_lrt(loci: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """p of the likelihood ratio of a level per group against one level, for loci of (group, m, coverage) samples.

    A fit that fails gives 1.0, which is never significant.
    """
    out = np.ones(len(loci))
    deep = [max((c for _, _, c in r), default=0) * max(1, len(r)) for r in loci]
    order = np.argsort(deep, kind="stable")  # like sizes together, so that little is padded
    at = 0
    while at < len(order):
        size = max(1, min(512, 1_000_000 // max(1, deep[order[min(at + 511, len(order) - 1)]])))
        block = order[at : at + size]
        at += size
        width = max(len(loci[i]) for i in block)
        x, y, n = np.zeros((len(block), width, 2)), np.zeros((len(block), width), int), np.zeros((len(block), width), int)
        x[..., 0] = 1
        for b, i in enumerate(block):
            for s, (g, m, c) in enumerate(loci[i]):
                x[b, s, 1], y[b, s], n[b, s] = g == 1, min(max(m, 0), max(c, 0)), max(c, 0)
        ratio = 2 * (fit_beta_binomial(x, y, n) - fit_beta_binomial(x[..., :1], y, n))
        out[block] = [chi2_upper(r) if r == r else 1.0 for r in ratio]
    return out


def fisher_expression(a: Column, b: Column, c: Column, d: Column, log_factorials: Column) -> Column:
    """The same test as a native expression over an array of log-factorials (for counts within its length)."""
    m, n, k = a + c, b + d, a + b
    lf = lambda x: F.element_at(log_factorials, x.cast("int") + 1)
    const = lf(m) + lf(n) - lf(m + n) + lf(k) + lf(m + n - k)
    logp = lambda i: const - lf(i) - lf(m - i) - lf(k - i) - lf(n - k + i)
    seen = logp(a) + 1e-9
    span = F.sequence(F.greatest(k - n, F.lit(0)).cast("long"), F.least(k, m).cast("long"))
    return F.least(F.aggregate(span, F.lit(0.0), lambda acc, i: acc + F.when(logp(i) <= seen, F.exp(logp(i))).otherwise(0.0)), F.lit(1.0))
