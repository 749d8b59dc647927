"""Numpy kernels of Gaussian hidden Markov models for one batch of sequences.

Shipped to the workers by value.  Each kernel treats a padded batch
(sequences x time x features) and loops over time only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

TINY = 1e-300
# of probabilities that a scale has been multiplied into
LEAST = 1e-307
# sequences and padded steps handled at once: bound the arrays of a task
CHUNK = 512
STEPS = 500_000
# models x sequences whose recursions go side by side, and sequences of a batch that is gathered from several
WIDTH = 3072
SIDE_STEPS = 600_000
GATHERED = 1024
# vectors of a run of steps, and its steps at most
RUN = 1 << 12
LONGEST_RUN = 32
# features whose products are held beside them
FEW_FEATURES = 3
# logarithms of densities within which products with probabilities keep their precision
SAFE = 600.0
# probabilities that count as out of reach
OUT_OF_REACH = 1e-40


def chunks(sequences: list) -> list[list]:
    """Runs of sequences whose padded steps (number x longest) stay bounded; order is kept."""
    out: list[list] = []
    longest = 0
    for s in sequences:
        longest = max(longest, len(s))
        if not out or len(out[-1]) == CHUNK or (len(out[-1]) + 1) * longest > STEPS:
            out.append([])
            longest = len(s)
        out[-1].append(s)
    return out


def pad(sequences: list) -> tuple[np.ndarray, np.ndarray]:
    """(B, T, D) values and (B,) lengths."""
    lengths = np.array([len(s) for s in sequences])
    dim = len(sequences[0][0]) if lengths[0] else 1
    out = np.zeros((len(sequences), lengths.max(), dim))
    for i, s in enumerate(sequences):
        out[i, : lengths[i]] = np.asarray([np.asarray(r, dtype=float) for r in s])
    return out, lengths


def log_emissions(x: np.ndarray, means: np.ndarray, covars: np.ndarray) -> np.ndarray:
    """Gaussian log densities (B, T, K); covars (K, D) diagonal or (K, D, D) full."""
    dim = x.shape[-1]
    out = np.empty((*x.shape[:-1], len(means)))
    for k, mean in enumerate(means):
        delta = x - mean
        if covars.ndim == 2:
            var = covars[k]
            out[..., k] = -0.5 * (dim * np.log(2 * np.pi) + np.log(var).sum() + (delta**2 / var).sum(-1))
        else:
            low = np.linalg.cholesky(covars[k])
            solved = np.linalg.solve(low, delta.reshape(-1, dim).T).T.reshape(delta.shape)
            logdet = 2 * np.log(np.diag(low)).sum()
            out[..., k] = -0.5 * (dim * np.log(2 * np.pi) + logdet + (solved**2).sum(-1))
    return out


def logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    return np.log(np.exp(a - top).sum(axis=axis)) + np.squeeze(top, axis)


def forward(log_b: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    log_a = np.log(np.clip(trans, TINY, None))
    alpha = np.empty_like(log_b)
    alpha[:, 0] = np.log(np.clip(start, TINY, None)) + log_b[:, 0]
    for t in range(1, log_b.shape[1]):
        alpha[:, t] = logsumexp(alpha[:, t - 1, :, None] + log_a, 1) + log_b[:, t]
    return alpha


def backward(log_b: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    log_a = np.log(np.clip(trans, TINY, None))
    beta = np.zeros_like(log_b)
    for t in range(log_b.shape[1] - 2, -1, -1):
        step = logsumexp(log_a[None] + (log_b[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where((t < lengths - 1)[:, None], step, 0.0)
    return beta


def normalized(log_p: np.ndarray) -> np.ndarray:
    return np.exp(log_p - logsumexp(log_p, -1)[..., None])


def last(alpha: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return alpha[np.arange(len(lengths)), lengths - 1]


def viterbi(log_b: np.ndarray, start: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    log_a = np.log(np.clip(trans, TINY, None))
    size, steps, _ = log_b.shape
    delta = np.log(np.clip(start, TINY, None)) + log_b[:, 0]
    back = np.zeros(log_b.shape, dtype=np.int64)
    ends = np.where((lengths == 1)[:, None], delta, -np.inf)
    for t in range(1, steps):
        scores = delta[:, :, None] + log_a
        back[:, t] = scores.argmax(1)
        delta = scores.max(1) + log_b[:, t]
        ends = np.where((lengths - 1 == t)[:, None], delta, ends)
    path = np.zeros((size, steps), dtype=np.int64)
    rows = np.arange(size)
    current = ends.argmax(1)
    for t in range(steps - 1, -1, -1):
        # padding after the end of a sequence keeps its final state
        current = np.where(t < lengths - 1, back[rows, min(t + 1, steps - 1), current], current)
        path[:, t] = current
    return path


def statistics(x: np.ndarray, lengths: np.ndarray, params: dict) -> dict:
    """Expected sufficient statistics and log-likelihood, summed over the batch."""
    means, covars = np.asarray(params["means"]), np.asarray(params["covars"])
    start, trans = np.asarray(params["start"]), np.asarray(params["trans"])
    log_b = log_emissions(x, means, covars)
    alpha, beta = forward(log_b, start, trans), backward(log_b, trans, lengths)
    total = logsumexp(last(alpha, lengths), 1)
    valid = np.arange(x.shape[1])[None] < lengths[:, None]
    gamma = np.where(valid[..., None], np.exp(alpha + beta - total[:, None, None]), 0.0)
    xi = np.zeros((len(means), len(means)))
    log_a = np.log(np.clip(trans, TINY, None))
    for t in range(x.shape[1] - 1):
        step = np.exp(
            alpha[:, t, :, None] + log_a + (log_b[:, t + 1] + beta[:, t + 1])[:, None, :] - total[:, None, None]
        )
        xi += np.where((t + 1 < lengths)[:, None, None], step, 0.0).sum(0)
    flat_g, flat_x = gamma.reshape(-1, len(means)), x.reshape(-1, x.shape[-1])
    if covars.ndim == 2:
        second = flat_g.T @ flat_x**2
    else:
        second = np.einsum("nk,ni,nj->kij", flat_g, flat_x, flat_x)
    return {
        "start": gamma[:, 0].sum(0), "trans": xi, "weight": flat_g.sum(0), "first": flat_g.T @ flat_x,
        "second": second, "ll": float(total.sum()), "n": int(lengths.sum()), "sequences": len(lengths),
    }


def pack(stats: dict) -> np.ndarray:
    return np.concatenate([np.ravel(stats[k]) for k in ("start", "trans", "weight", "first", "second")] + [
        np.array([stats["ll"], stats["n"], stats["sequences"]], dtype=float)
    ])


def packed_size(params: dict, dim: int) -> int:
    """Length of ``pack`` for a model of these parameters."""
    k = len(params["means"])
    return k + k * k + k + k * dim + int(np.size(params["covars"])) + 3


def unpack(flat: np.ndarray, k: int, dim: int, full: bool) -> dict:
    shapes = {"start": (k,), "trans": (k, k), "weight": (k,), "first": (k, dim), "second": (k, dim, dim) if full else (k, dim)}
    out, pos = {}, 0
    for name, shape in shapes.items():
        size = int(np.prod(shape))
        out[name] = flat[pos : pos + size].reshape(shape)
        pos += size
    out["ll"], out["n"], out["sequences"] = flat[pos], flat[pos + 1], flat[pos + 2]
    return out


def maximize(stats: dict, full: bool, min_covar: float, sticky: float = 0.0) -> dict:
    """Parameters from summed statistics; ``sticky`` is a prior weight on staying."""
    weight = np.maximum(stats["weight"], 1e-12)
    k = len(weight)
    start = stats["start"] / max(stats["start"].sum(), TINY)
    counts = stats["trans"] + (np.eye(k) * max(sticky - 1.0, 0.0))
    sums = counts.sum(1, keepdims=True)
    trans = np.where(sums > 0, counts / np.where(sums > 0, sums, 1.0), 1.0 / k)
    means = stats["first"] / weight[:, None]
    if full:
        outer = np.einsum("ki,kj->kij", means, means)
        values, axes = np.linalg.eigh(stats["second"] / weight[:, None, None] - outer)
        covars = np.einsum("kia,ka,kja->kij", axes, np.maximum(values, min_covar), axes)
    else:
        covars = np.maximum(stats["second"] / weight[:, None] - means**2, min_covar)
    return {"start": start, "trans": trans, "means": means, "covars": covars}


# ---------------------------------------------------------------------------
# many models of one number of states on the same batch: arrays (time x states x models x sequences), sequences by falling
# length. A batch is cut into runs of steps that stay in the caches; a run is as wide as the sequences that reach it, so that
# nearly all arithmetic goes over whole arrays


def ordered(values: np.ndarray, lengths: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """What the passes read of a padded batch, sequences by falling length: (time x (1 + features) x sequences, sequences still
    running at each step) of every run of steps, with ones before the features and, of few features, their products behind them;
    the lengths; the least and largest values."""
    order = np.argsort(-lengths, kind="stable")
    values, lengths = np.asarray(values, float)[order], lengths[order]
    size, steps, dim = values.shape
    running = (lengths[None] > np.arange(steps)[:, None]).sum(1).tolist()
    run = max(1, min(steps, RUN // max(size, RUN // LONGEST_RUN)))
    pairs = _all_pairs(dim) if dim <= FEW_FEATURES else []
    runs = []
    for first in range(0, steps, run):
        end, n = min(first + run, steps), running[first]
        x = np.ones((end - first, dim + 1 + len(pairs), n))
        x[:, 1 : dim + 1] = values[:n, first:end].transpose(1, 2, 0)
        for i, (c, e) in enumerate(pairs):
            np.multiply(x[:, c + 1], x[:, e + 1], out=x[:, dim + 1 + i])
        runs.append((x, running[first:end]))
    return runs, lengths, np.concatenate([np.ones((2, 1)), [values.min((0, 1)), values.max((0, 1))]], 1)


def gathered(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
    """``ordered`` batches of bounded size that hold all sequences of (vectors below each other, lengths) parts, like lengths together."""
    rows, lengths = (np.concatenate(p) for p in zip(*parts))
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    out, at = [], 0
    while at < len(order):
        longest = int(lengths[order[at]])
        own = order[at : at + max(1, min(GATHERED, STEPS // longest))]
        inside = np.arange(longest)[None] < lengths[own][:, None]
        values = np.zeros((len(own), longest, rows.shape[1]))
        values[inside] = rows[(first[own][:, None] + np.arange(longest))[inside]]
        out.append(ordered(values, lengths[own]))
        at += len(own)
    return out


def _whitened(params: dict) -> tuple[np.ndarray, np.ndarray]:
    """(states x features x (offset, weights), constant per state): a log density is the constant minus the sum of the squares of
    the state's rows applied to (1, features)."""
    means, covars = np.asarray(params["means"], float), np.asarray(params["covars"], float)
    d = means.shape[1]
    if covars.ndim == 2:
        weights, logdet = np.eye(d) / np.sqrt(covars)[:, None, :], np.log(covars).sum(1)
    else:
        low = np.linalg.cholesky(covars)
        weights, logdet = np.linalg.inv(low), 2 * np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1)
    weights = weights * np.sqrt(0.5)
    return np.concatenate([-(weights @ means[:, :, None]), weights], 2), -0.5 * (d * np.log(2 * np.pi) + logdet)


def _far(rows: np.ndarray, const: np.ndarray, ends: np.ndarray) -> bool:
    """Whether densities of values between the ``ends`` (ones first) may leave the range of doubles: then each step's are taken
    relative to the largest one."""
    bounds = np.stack([rows * ends[0], rows * ends[1]])
    squares = np.maximum(bounds.max(0).sum(-1) ** 2, bounds.min(0).sum(-1) ** 2).sum(-1)
    return not (squares + const.max() - const).max() < SAFE


def _array(room: dict, name: str, *shape: int) -> np.ndarray:
    """An array in memory that is used again by later calls; its values are what these have left."""
    size = math.prod(shape)
    if name not in room or len(room[name]) < size:
        room[name] = np.empty(size)
    return room[name][:size].reshape(shape)


def _statistics_many(batch: tuple, at: list, params: list[dict], room: dict) -> list[dict]:
    """``statistics`` of every model over an ``ordered`` batch, by scaled recursions: forward filter, and back from each smoothed
    posterior through the prediction of its step."""
    runs, lengths, ends = batch
    size, width = len(lengths), ends.shape[1]
    many, k, deep = len(params), len(params[0]["means"]), max(map(len, at))
    weights, const, far = np.zeros((deep, k, many, width)), np.empty((many, k)), False
    for m, (a, p) in enumerate(zip(at, params)):
        columns = [0, *(i + 1 for i in a)]
        own, const[m] = _whitened(p)
        far |= _far(own, const[m], ends[:, columns])
        weights[: len(a), :, m, columns] = own.transpose(1, 0, 2)
    weights = weights.reshape(-1, width)
    # densities without their constants: these go into the transitions
    top = const.max(1)
    given = np.exp(const - top[:, None])
    clipped = lambda name: np.clip(np.stack([np.asarray(p[name], float) for p in params]), TINY, None)
    trans = np.maximum(clipped("trans") * given[:, None, :], LEAST)
    start = np.ascontiguousarray(np.maximum(clipped("start") * given, LEAST).T)[:, :, None]
    into = np.concatenate([trans.transpose(0, 2, 1), np.ones((many, 1, k))], 1)  # the last row sums the states
    # states that are all but out of reach: every step is scaled at once, otherwise with the next one
    hard = min(trans.min(), start.min()) < OUT_OF_REACH
    far |= hard
    total = top * float(lengths.sum())
    alphas = _array(room, "alpha", k * many * sum(x.shape[0] * x.shape[2] for x, _ in runs))
    filtered, used = [], 0
    before = None
    for x, running in runs:
        steps, _, n = x.shape
        alpha = alphas[used : used + steps * k * many * n].reshape(steps, k, many, n)
        filtered.append(alpha)
        used += alpha.size
        squares = _array(room, "squares", steps, len(weights), n)
        np.matmul(weights, x[:, :width], out=squares)
        np.multiply(squares, squares, out=squares)
        squares = squares.reshape(steps, deep, -1)
        flat = alpha.reshape(steps, -1)
        np.negative(squares[:, 0], out=flat)
        for i in range(1, deep):
            flat -= squares[:, i]
        if far:
            largest = alpha.max(1)
            alpha -= largest[:, None]
            for t, live in enumerate(running):
                total += largest[t, :, :live].sum(1)
        np.exp(flat, out=flat)
        ahead, by = _array(room, "ahead", k + 1, many, n), _array(room, "by", steps, many, n)
        stacked, into_ahead = alpha.transpose(0, 2, 1, 3), ahead.transpose(1, 0, 2)
        for t in range(steps):
            now = alpha[t]
            if t or before is not None:
                np.matmul(into, stacked[t - 1] if t else before[:, :, :n], out=into_ahead)
                now *= ahead[:k]
                now *= np.divide(1.0, ahead[k], out=None if hard or not t else by[t - 1])
            else:
                now *= start
            if hard:
                now *= np.divide(1.0, now.sum(0), out=by[t])
        if not hard:
            np.divide(1.0, alpha[-1].sum(0), out=by[-1])
        if running[-1] < n:
            for t, live in enumerate(running):
                by[t, :, live:] = 1.0
        total -= np.log(by, out=by).sum((0, 2))
        before = stacked[-1]
    held = runs[0][0].shape[1]  # with products, if the batch has them
    pairs = _all_pairs(width - 1) if held > width else sorted({(min(pair), max(pair)) for a, p in zip(at, params) for pair in _pairs(a, p)})
    first, second, moves = np.zeros((k * many, held)), np.zeros((k * many, len(pairs))), np.zeros((many, k, k))
    into = np.ascontiguousarray(into[:, :k])
    after = None
    for r in range(len(runs) - 1, -1, -1):
        (x, running), alpha = runs[r], filtered[r]
        steps, _, n = x.shape
        gamma, ratio, beta = _array(room, f"gamma{r % 2}", steps, k, many, n), _array(room, "ratio", steps, k, many, n), _array(room, "ahead", k, many, n)
        stacked, ratios, betas = alpha.transpose(0, 2, 1, 3), ratio.transpose(0, 2, 1, 3), beta.transpose(1, 0, 2)
        # posteriors at the last step: of sequences that go on, from the run behind
        on = 0
        if after is not None:
            on = after.shape[2]
            np.multiply(after, alpha[-1, :, :, :on], out=gamma[-1, :, :, :on])
            gamma[-1, :, :, :on] /= gamma[-1, :, :, :on].sum(0)  # rounding does not add up over long sequences
        _ended(gamma[-1], alpha[-1], on, running[-1])
        if steps > 1:  # predictions, which turn into smoothed posteriors / predictions
            np.matmul(into, stacked[:-1], out=ratios[1:])
        for t in range(steps - 1, 0, -1):
            follows = ratio[t]
            np.divide(gamma[t], follows, out=follows)
            np.matmul(trans, ratios[t], out=betas)
            np.multiply(beta, alpha[t - 1], out=gamma[t - 1])
            if running[t] < running[t - 1]:
                _ended(gamma[t - 1], alpha[t - 1], running[t], running[t - 1])
        if steps > 1:
            moves += np.matmul(stacked[:-1], ratios[1:].swapaxes(2, 3)).sum(0)
        if r:
            ago = filtered[r - 1][-1, :, :, :n].transpose(1, 0, 2)
            np.matmul(into, ago, out=ratios[0])
            np.divide(gamma[0], ratio[0], out=ratio[0])
            moves += np.matmul(ago, ratios[0].swapaxes(1, 2))
            np.matmul(trans, ratios[0], out=betas)
            after = beta
        # sums over the vectors of the run
        posterior = gamma.reshape(steps, k * many, n)
        first += np.matmul(posterior, x.swapaxes(1, 2)).sum(0)
        if held == width:
            products = _array(room, "products", steps, len(pairs), n)
            for i, (c, e) in enumerate(pairs):
                np.multiply(x[:, c + 1], x[:, e + 1], out=products[:, i])
            second += np.matmul(posterior, products.swapaxes(1, 2)).sum(0)
    if held > width:
        first, second = first[:, :width], first[:, width:]
    begins, first, second = gamma[0].sum(2), first.reshape(k, many, width), second.reshape(k, many, -1)
    out = []
    for m, (a, p) in enumerate(zip(at, params)):
        own = second[:, m, [pairs.index((min(pair), max(pair))) for pair in _pairs(a, p)]]
        if np.ndim(p["covars"]) == 3:
            square = np.empty((k, len(a), len(a)))
            i, j = np.triu_indices(len(a))
            square[:, i, j] = square[:, j, i] = own
            own = square
        out.append({"start": begins[:, m], "trans": trans[m] * moves[m], "weight": first[:, m, 0], "first": first[:, m, [i + 1 for i in a]], "second": own,
                    "ll": float(total[m]), "n": int(lengths.sum()), "sequences": size})
    return out


def _ended(gamma: np.ndarray, alpha: np.ndarray, on: int, running: int) -> None:
    """Smoothed posteriors of a step for sequences that end there (from ``on`` to ``running``), none behind their end."""
    gamma[:, :, on:running] = alpha[:, :, on:running] / alpha[:, :, on:running].sum(0)
    gamma[:, :, running:] = 0.0


def _all_pairs(dim: int) -> list[tuple[int, int]]:
    return [(c, e) for c in range(dim) for e in range(c, dim)]


def _pairs(columns: Sequence[int], params: dict) -> list[tuple[int, int]]:
    """Columns whose products are summed: each with itself, or all of the upper triangle."""
    return [(c, e) for i, c in enumerate(columns) for e in columns[i:]] if np.ndim(params["covars"]) == 3 else [(c, c) for c in columns]


def side_by_side(size: int, steps: int) -> int:
    """Models whose recursions run in one set of arrays over a batch of ``size`` sequences: the arrays stay bounded."""
    return max(1, min(WIDTH // size, SIDE_STEPS // (size * steps)))


def statistics_many(values: np.ndarray, lengths: np.ndarray, at: list, params: list[dict]) -> list[dict | None]:
    """One entry per model; None where a model's covariances cannot be used."""
    return statistics_of(ordered(values, lengths), at, params, {})


def statistics_of(batch: tuple, at: list, params: list[dict], room: dict) -> list[dict | None]:
    """``statistics_many`` over an ``ordered`` batch; ``room`` holds memory that calls use in turn."""
    usable = []
    for p in params:
        covars = np.asarray(p["covars"])
        try:
            usable.append(bool(np.isfinite(covars).all() and (np.linalg.cholesky(covars) is not None if covars.ndim == 3 else (covars > 0).all())))
        except np.linalg.LinAlgError:
            usable.append(False)
    # models of like numbers of features go together
    live = sorted((i for i, u in enumerate(usable) if u), key=lambda i: len(at[i]))
    found: list[dict | None] = [None] * len(params)
    runs, lengths, _ = batch
    group = side_by_side(len(lengths), sum(len(x) for x, _ in runs))
    for first in range(0, len(live), group):
        own = live[first : first + group]
        for i, stats in zip(own, _statistics_many(batch, [list(at[i]) for i in own], [params[i] for i in own], room)):
            found[i] = stats
    return found


def add_statistics(sums: dict, batch: tuple, models: list[tuple], room: dict) -> None:
    """Adds to ``sums`` the packed statistics of (name, positions, params) models of one number of states over one ``ordered`` batch."""
    found = statistics_of(batch, [at for _, at, _ in models], [p for _, _, p in models], room)
    for (name, at, params), stats in zip(models, found):
        # a model whose covariances cannot be used fails alone: its sums are not finite
        flat = pack(stats) if stats else np.full(packed_size(params, len(at)), np.nan)
        sums[name] = sums[name] + flat if name in sums else flat


def by_states(models: list[tuple]) -> list[list[tuple]]:
    """(name, positions, params) models of the same number of states together: they go through the recursions side by side."""
    out: dict[int, list[tuple]] = {}
    for m in models:
        out.setdefault(len(m[2]["means"]), []).append(m)
    return list(out.values())


# ---------------------------------------------------------------------------
# passes of the fit

RUNNING, CONVERGED, FAILED = "running", "converged", "failed"
PARAMS = ("start", "trans", "means", "covars")


def advance(flat: np.ndarray, before: float, params: dict, tolerance: float, min_covar: float, sticky: float, last: bool) -> tuple[float, int, str, dict]:
    """(likelihood, rows, verdict, next parameters) from the summed statistics of one pass; ``before`` is the likelihood of the
    pass before it (minus infinity for the first). The last pass only scores, so do failed and converged ones."""
    full = np.ndim(params["covars"]) == 3
    parts = unpack(flat, *np.shape(params["means"]), full)
    ll = float(parts["ll"])
    if not np.isfinite(ll):
        return ll, 0, FAILED, params
    converged = ll - before < tolerance
    if converged or last:
        return ll, int(parts["n"]), CONVERGED if converged else RUNNING, params
    return ll, int(parts["n"]), RUNNING, maximize(parts, full, min_covar, sticky)


def passes(batches: Sequence[tuple], models: list[tuple], most: int, ends: bool, tolerance: float, min_covar: float) -> list[tuple]:
    """Up to ``most`` passes of (name, positions, params, sticky, before) models over all sequences, given as ``ordered`` batches:
    (name, likelihoods, rows, verdict, params) each. ``ends``: the last of the passes only scores."""
    live = {m[0]: m for m in models}
    seen: dict[str, list[float]] = {name: [] for name in live}
    out, room = {}, {}
    for step in range(most):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for own in by_states([m[:3] for m in live.values()]):
                add_statistics(sums, batch, own, room)
        for name, flat in sums.items():
            _, at, params, sticky, before = live[name]
            ll, n, verdict, params = advance(flat, before, params, tolerance, min_covar, sticky, ends and step == most - 1)
            seen[name].append(ll)
            live[name] = (name, at, params, sticky, ll)
            out[name] = (name, seen[name], n or (out[name][2] if name in out else 0), verdict, params)
            if verdict != RUNNING:
                del live[name]
    return list(out.values())


def flat_params(params: dict) -> np.ndarray:
    return np.concatenate([np.ravel(params[k]) for k in PARAMS])


def params_of(flat: np.ndarray, like: dict) -> dict:
    """The inverse of ``flat_params`` for parameters of the shapes of ``like``."""
    out, pos = {}, 0
    for k in PARAMS:
        shape = np.shape(like[k])
        size = int(np.prod(shape))
        out[k] = flat[pos : pos + size].reshape(shape)
        pos += size
    return out
