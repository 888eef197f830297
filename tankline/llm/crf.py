"""Linear-chain conditional random field for batches of sequences (numpy, inside tasks).

All sequences of a batch are laid end to end; a sequence start resets the chain. The
positions are cut into equal blocks whose transfer matrices are computed side by side,
so forward-backward takes about ``3 * sqrt(n)`` vector steps for ``n`` positions,
however the batch is split into sequences.
"""

from __future__ import annotations

import numpy as np


RESCALE = 4     # steps between rescalings, far from what a float holds


def _norm(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, lengths: np.ndarray, edges: bool = False):
    """``emit`` (n, k) log scores, ``trans`` (k, k), ``start`` (k,), ``lengths`` of the sequences
    (zeros allowed). Returns the (n, k) state marginals; with ``edges`` also the summed (k, k)
    marginals of neighbouring states and the summed log partition functions."""
    n, k = emit.shape
    if n == 0:
        return (emit.copy(), np.zeros((k, k)), 0.0) if edges else emit.copy()
    lengths = lengths[lengths > 0]
    first = np.zeros(n, bool)
    first[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = True
    size = max(8, int(np.sqrt(n)))
    blocks = -(-n // size)
    pad = blocks * size - n
    top = emit.max(axis=1, keepdims=True)
    e = np.concatenate([np.exp(emit - top), np.ones((pad, k))]).reshape(blocks, size, k)
    r = np.concatenate([first, np.ones(pad, bool)]).reshape(blocks, size)
    tm, tt = trans.max(), start.max()
    t, s = np.exp(trans - tm), np.exp(start - tt)
    any_r = r.any(axis=0)
    # transfer matrix of each block
    p = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(size):
        q = (p.reshape(-1, k) @ t).reshape(blocks, k, k)
        if any_r[i]:
            q[r[:, i]] = p[r[:, i]].sum(axis=2, keepdims=True) * s
        p = q * e[:, i, None, :]
        if i % RESCALE == RESCALE - 1 or i == size - 1:
            p /= p.max(axis=(1, 2), keepdims=True) + 1e-300
    # messages at the block borders
    fwd, bwd = np.empty((blocks, k)), np.empty((blocks, k))
    v = np.full(k, 1.0 / k)
    for b in range(blocks):
        fwd[b] = v
        v = v @ p[b]
        v = v / v.sum()
    v = np.full(k, 1.0 / k)
    for b in range(blocks - 1, -1, -1):
        bwd[b] = v
        v = p[b] @ v
        v = v / v.sum()
    alpha, scale = np.empty((blocks, size, k)), np.empty((blocks, size))
    a = fwd
    for i in range(size):
        q = a @ t
        if any_r[i]:
            q[r[:, i]] = s
        q = q * e[:, i]
        if edges or i % RESCALE == RESCALE - 1:
            z = q.sum(axis=1, keepdims=True)
            a, scale[:, i] = q / z, z[:, 0]
        else:
            a = q
        alpha[:, i] = a
    beta = np.empty((blocks, size, k))
    bt = bwd
    for i in range(size - 1, -1, -1):
        beta[:, i] = bt
        q = (e[:, i] * bt) @ t.T
        if any_r[i]:
            q[r[:, i]] = 1.0
        bt = _norm(q) if i % RESCALE == 0 else q
    alpha, beta = alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n]
    gamma = _norm(alpha * beta)
    if not edges:
        return gamma
    at = np.flatnonzero(~first)
    xi = alpha[at - 1][:, :, None] * t * (e.reshape(-1, k)[at] * beta[at])[:, None, :]
    xi /= xi.sum(axis=(1, 2), keepdims=True)
    log_z = np.log(scale.reshape(-1)[:n]).sum() + top.sum() + tm * len(at) + tt * first.sum()
    return gamma, xi.sum(axis=0), log_z


def fit(emission, gradient, theta: np.ndarray, k: int, gold: np.ndarray, lengths: np.ndarray, l2: float = 1e-3,
        steps: int = 150, rate: float = 0.1):
    """Maximise the conditional likelihood of ``gold`` states by Adam (all positions per step,
    no randomness). ``emission(theta)`` gives (n, k) scores, ``gradient(d)`` maps d(score) to
    d(theta). Returns (theta, trans, start)."""
    n = len(gold)
    lengths = lengths[lengths > 0]
    first = np.zeros(n, bool)
    first[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = True
    hot = np.eye(k)[gold]
    at = np.flatnonzero(~first)
    pairs = np.zeros((k, k))
    np.add.at(pairs, (gold[at - 1], gold[at]), 1)
    p = len(theta)
    x = np.concatenate([theta, np.zeros(k * k + k)])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        trans, start = x[p : p + k * k].reshape(k, k), x[p + k * k :]
        gamma, xi, _ = marginals(emission(x[:p]), trans, start, lengths, edges=True)
        g = np.concatenate([gradient(hot - gamma), (pairs - xi).ravel(), (hot - gamma)[first].sum(axis=0)]) / n - l2 * x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return x[:p], x[p : p + k * k].reshape(k, k), x[p + k * k :]
