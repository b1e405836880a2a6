"""Expectation maximisation of one key's series to a tolerance, in numpy.

A key's training series has at most one row per calendar day (see ``functions.windows``), so
Spark deals the keys over tasks and every key stops by itself when its mean log likelihood
settles. The hidden chain is smoothed with products of k x k matrices: a series is cut into
about sqrt(n) blocks that advance side by side, so a pass costs about 2 sqrt(n) array steps.
"""

import numpy as np

REG = 1e-6              # added to the diagonal of a covariance
FLOOR = 1e-4            # prior count of every transition
TOL, MAX_ROUNDS = 1e-6, 500


def moments(x, g):
    """(weights, means, covariances) of rows x under responsibilities g."""
    s = g.sum(axis=0) + 1e-12
    mean = g.T @ x / s[:, None]
    cov = np.einsum("nk,na,nb->kab", g, x, x) / s[:, None, None] - mean[:, :, None] * mean[:, None, :]
    return s / len(x), mean, cov + REG * np.eye(x.shape[1])


def log_density(x, mean, cov):
    """log N(x | mean_k, cov_k) as (n, k)."""
    d = x[:, None, :] - mean
    quad = np.einsum("nka,kab,nkb->nk", d, np.linalg.inv(cov), d)
    return -0.5 * (quad + np.linalg.slogdet(cov)[1] + x.shape[1] * np.log(2.0 * np.pi))


def softened(logp):
    """(rows of probabilities, log of their sums)."""
    top = logp.max(axis=1, keepdims=True)
    p = np.exp(logp - top)
    s = p.sum(axis=1, keepdims=True)
    return p / s, (top + np.log(s))[:, 0]


def mixture(x, g, tol=TOL, max_rounds=MAX_ROUNDS):
    """(weights, means, covariances, mean log likelihood, rounds) of a Gaussian mixture."""
    w, mean, cov = moments(x, g)
    before = -np.inf
    for rounds in range(1, max_rounds + 1):
        g, ll = softened(np.log(w) + log_density(x, mean, cov))
        w, mean, cov = moments(x, g)
        if abs(ll.mean() - before) < tol:
            break
        before = ll.mean()
    return w, mean, cov, ll.mean(), rounds


def blocks_of(steps):
    """Step matrices (n, k, k) as (blocks, length, k, k), filled up with unit matrices."""
    n, k, _ = steps.shape
    length = max(int(np.sqrt(n)), 1)
    out = np.broadcast_to(np.eye(k), (-(-n // length) * length, k, k)).copy()
    out[:n] = steps
    return out.reshape(-1, length, k, k)


def smoothed(pi, a, e):
    """(state probabilities, expected transitions, log likelihood) of a hidden chain.

    ``e`` (n, k) are likelihoods scaled by any factor of a row.
    """
    n, k = e.shape
    steps = a[None] * e[:, None, :]
    steps[0] = np.diag(e[0])
    b = blocks_of(steps)
    whole = np.broadcast_to(np.eye(k), (len(b), k, k))
    for t in range(b.shape[1]):
        whole = whole @ b[:, t]
        whole = whole / whole.sum(axis=(1, 2), keepdims=True)
    into, out = np.empty((len(b), k)), np.empty((len(b), k))
    v = pi
    for i in range(len(b)):
        into[i] = v
        v = v @ whole[i]
        v = v / v.sum()
    v = np.ones(k)
    for i in range(len(b) - 1, -1, -1):
        out[i] = v
        v = whole[i] @ v
        v = v / v.sum()
    ahead, back, scale = np.empty(b.shape[:2] + (k,)), np.empty(b.shape[:2] + (k,)), np.empty(b.shape[:2])
    v = into
    for t in range(b.shape[1]):
        v = np.einsum("bi,bij->bj", v, b[:, t])
        scale[:, t] = v.sum(axis=1)
        v = v / scale[:, t, None]
        ahead[:, t] = v
    v = out
    for t in range(b.shape[1] - 1, -1, -1):
        back[:, t] = v
        v = np.einsum("bij,bj->bi", b[:, t], v)
        v = v / v.sum(axis=1, keepdims=True)
    ahead, back, scale = ahead.reshape(-1, k)[:n], back.reshape(-1, k)[:n], scale.ravel()[:n]
    g = ahead * back
    g = g / g.sum(axis=1, keepdims=True)
    pair = ahead[:-1, :, None] * steps[1:] * back[1:, None, :]
    pair = pair / pair.sum(axis=(1, 2), keepdims=True)
    return g, pair.sum(axis=0), np.log(scale).sum()


def hidden_chain(x, g, tol=TOL, max_rounds=MAX_ROUNDS):
    """Baum-Welch: (start, transitions, weights, means, covariances, mean log likelihood, rounds)."""
    w, mean, cov = moments(x, g)
    pi, k = w / w.sum(), g.shape[1]
    a = np.full((k, k), 0.1 / max(k - 1, 1))
    np.fill_diagonal(a, 0.9)
    before = -np.inf
    for rounds in range(1, max_rounds + 1):
        logp = log_density(x, mean, cov)
        top = logp.max(axis=1, keepdims=True)
        g, moves, ll = smoothed(pi, a, np.exp(logp - top) + 1e-30)
        ll = (ll + top.sum()) / len(x)
        w, mean, cov = moments(x, g)
        pi = (g[0] + FLOOR) / (1 + k * FLOOR)
        a = (moves + FLOOR) / (moves + FLOOR).sum(axis=1, keepdims=True)
        if abs(ll - before) < tol:
            break
        before = ll
    return pi, a, w, mean, cov, ll, rounds


def quantile_groups(v, k):
    """Responsibilities that put a row into its quantile group of v."""
    cuts = np.quantile(v, np.arange(1, k) / k)
    return np.eye(k)[np.searchsorted(cuts, v, side="left")]
