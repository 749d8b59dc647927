"""Numpy kernels of the time-parallel hidden-Markov scan: transfer matrices of chunks, their products, and chunks finished
from what enters and leaves them. Log space throughout; matrices go from the state before a chunk to the state at its end."""

from __future__ import annotations

import numpy as np

TINY = 1e-300


def log(p) -> np.ndarray:
    return np.log(np.clip(np.asarray(p, float), TINY, None))


def lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + np.squeeze(top, axis)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of (..., K, K) matrices in the log semiring."""
    return lse(a[..., :, :, None] + b[..., None, :, :], -2)


def most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in the max-plus semiring."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(-2)


def transfers(log_b: np.ndarray, lengths: np.ndarray, first: np.ndarray, log_start: np.ndarray, log_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both transfer matrices of every chunk of a padded batch (B, T, K); a first chunk has the start in every row."""
    into = np.where(first[:, None, None], log_start[None, None, :], log_a[None])
    total = into + log_b[:, 0][:, None, :]
    best = total.copy()
    for t in range(1, log_b.shape[1]):
        on = (t < lengths)[:, None, None]
        step = log_a[None] + log_b[:, t][:, None, :]
        total = np.where(on, times(total, step), total)
        best = np.where(on, most(best, step), best)
    return total, best


def product(total: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of a run of matrices (M, K, K), left to right."""
    a, b = total[0], best[0]
    for x, y in zip(total[1:], best[1:]):
        a, b = times(a, x), most(b, y)
    return a, b


def spread(total: np.ndarray, best: np.ndarray, alpha: np.ndarray, beta: np.ndarray, s_in: int, s_out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What enters and leaves each member of a run whose own entry (alpha, s_in) and exit (beta, s_out) are known."""
    m, k = len(total), total.shape[1]
    alphas, betas = np.empty((m, k)), np.empty((m, k))
    for i in range(m):
        alphas[i] = alpha
        alpha = lse(alpha[:, None] + total[i], 0)
        alpha = alpha - alpha.max()
    for i in range(m - 1, -1, -1):
        betas[i] = beta
        beta = lse(total[i] + beta[None, :], 1)
        beta = beta - beta.max()
    # states at the borders: a path over the members with both ends fixed
    delta, back = np.full(k, -np.inf), np.zeros((m, k), np.int64)
    delta[s_in] = 0.0
    for i in range(m):
        scores = delta[:, None] + best[i]
        back[i], delta = scores.argmax(0), scores.max(0)
    outs, state = np.empty(m, np.int64), s_out
    for i in range(m - 1, -1, -1):
        outs[i] = state
        state = back[i, state]
    return alphas, betas, np.append(s_in, outs[:-1]), outs


def finish(log_b, lengths, first, log_start, log_a, alpha, beta, s_in, s_out) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filtered, smoothed (B, T, K) and best path (B, T) of chunks, from what enters and leaves each of them."""
    size, steps, k = log_b.shape
    forward, backward = np.empty_like(log_b), np.zeros_like(log_b)
    forward[:, 0] = np.where(first[:, None], log_start[None], lse(alpha[:, :, None] + log_a[None], 1)) + log_b[:, 0]
    delta = np.where(first[:, None], log_start[None], log_a[s_in]) + log_b[:, 0]
    back = np.zeros(log_b.shape, np.int64)
    for t in range(1, steps):
        forward[:, t] = lse(forward[:, t - 1][:, :, None] + log_a[None], 1) + log_b[:, t]
        scores = delta[:, :, None] + log_a[None]
        back[:, t], delta = scores.argmax(1), scores.max(1) + log_b[:, t]
    for t in range(steps - 1, -1, -1):
        later = beta if t == steps - 1 else lse(log_a[None] + (log_b[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where((t == lengths - 1)[:, None], beta, later)
    path, state, rows = np.empty((size, steps), np.int64), s_out.copy(), np.arange(size)
    for t in range(steps - 1, -1, -1):
        if t + 1 < steps:
            state = np.where(t + 1 < lengths, back[rows, t + 1, state], state)
        path[:, t] = state
    own = lambda x: np.exp(x - lse(x, -1)[..., None])
    return own(forward), own(forward + backward), path
