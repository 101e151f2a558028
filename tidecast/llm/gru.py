"""A gated recurrent language model in numpy with a class-factored softmax.

Word ids lie in ``side`` classes of ``side`` members by frequency; the
probability of a word is that of its class times its share in the class, so a
step costs two short softmaxes.  The side grows with the counted words (see
``side_for``).  Training runs truncated backpropagation over windows of a token
stream in parallel lanes and carries the state from window to window; scoring
carries it through a whole document.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 24
LEAST_SIDE = 32
VOCABULARY = LEAST_SIDE ** 2    # the smallest vocabulary, with the two below
END, UNKNOWN = 0, 1             # ids of the end of a text and of words outside the vocabulary
LANES, MOST_LANES = 32, 512     # of training: more lanes where a stream has STEPS windows for each
WINDOW, STEPS = 16, 256
RATE = 0.004                    # with LANES lanes; grows as the root of their number
SCORE_LANES, SCORE_WINDOW = 512, 16

Params = dict[str, np.ndarray]


def side_for(distinct: int) -> int:
    """Classes, and members of a class, for so many different words: the vocabulary is their
    square root, so that weights sent to every task stay small (40 MB for 10^10 words)."""
    return max(LEAST_SIDE, int(np.ceil(distinct ** 0.25)))


def shapes(side: int) -> dict[str, tuple[int, ...]]:
    return {"x": (side * side, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "n": (HIDDEN,), "c": (HIDDEN, side),
            "cb": (side,), "w": (side, HIDDEN, side), "wb": (side, side)}


def initial(counts: np.ndarray, seed: int = 1) -> Params:
    """Small random weights; the output starts from the ids' counts (the square of a side), as a unigram model."""
    rng = np.random.default_rng(seed)
    side = int(round(len(counts) ** 0.5))
    p = {k: (rng.normal(size=s) * 0.1).astype(np.float32) for k, s in shapes(side).items()}
    p["n"][:] = 0
    p["x"][:, HIDDEN:2 * HIDDEN] += 1.0  # at first most of the state is kept
    share = (counts + 0.5).reshape(side, side)
    p["cb"] = np.log(share.sum(1) / share.sum()).astype(np.float32)
    p["wb"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
    return p


def flat(p: Params) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p.values()])


def shaped(values: np.ndarray, like: Params) -> Params:
    """The weights of ``flat`` as views of ``values``."""
    cuts = np.cumsum([x.size for x in like.values()])[:-1]
    return {k: part.reshape(x.shape) for (k, x), part in zip(like.items(), np.split(values, cuts), strict=True)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def states(p: Params, inputs: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The state after each step, [steps, lanes, HIDDEN], from inputs [steps, lanes] and the
    state ``h`` before; a lane starts anew where its input is END."""
    out = np.empty((*inputs.shape, HIDDEN), np.float32)
    for t, ids in enumerate(inputs):
        if (ended := ids == END).any():
            h = np.where(ended[:, None], h.dtype.type(0), h)
        x, g = p["x"][ids], h @ p["u"]
        gate = _sigmoid(x[:, :2 * HIDDEN] + g[:, :2 * HIDDEN])
        r, z = gate[:, :HIDDEN], gate[:, HIDDEN:]
        m = g[:, 2 * HIDDEN:] + p["n"]
        new = np.tanh(x[:, 2 * HIDDEN:] + r * m)
        if keep is not None:
            keep.append((h, gate, m, new))
        h = new + z * (h - new)
        out[t] = h
    return out


def _exp_total(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x (less each row's maximum where exp could overflow), exp(x) and the rows' sums."""
    if len(x) and x.max() >= 60:
        x = x - x.max(axis=-1, keepdims=True)
    e = np.exp(x)
    return x, e, e @ np.ones(x.shape[-1], x.dtype)  # much faster than a sum over short rows


def log_probability(p: Params, h: np.ndarray, targets: np.ndarray, grads: Params | None = None):
    """Natural log-probabilities of ``targets`` [n] in the states ``h`` [n, HIDDEN]; with
    ``grads`` also adds the output weights' gradients of the summed loss and returns that of h."""
    classes, _, members = p["w"].shape
    order = np.argsort(targets, kind="stable")  # the rows of a class lie together
    h, targets = h[order], targets[order]
    cls, member = np.divmod(targets, members)
    rows = np.arange(len(targets))
    by_class = h @ p["c"] + p["cb"]
    dh = None
    by_class, d, total = _exp_total(by_class)
    out = (by_class[rows, cls] - np.log(total)).astype(np.float64)
    if grads is not None:
        d /= total[:, None]
        d[rows, cls] -= 1
        grads["c"] += h.T @ d
        grads["cb"] += np.ones(len(d), d.dtype) @ d
        dh = d @ p["c"].T
    cuts = np.searchsorted(cls, np.arange(classes + 1)).tolist()
    for c, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a == b:
            continue
        mine, wanted, inner = h[a:b], member[a:b], rows[:b - a]
        within, d, total = _exp_total(mine @ p["w"][c] + p["wb"][c])
        out[a:b] += within[inner, wanted] - np.log(total)
        if grads is not None:
            d /= total[:, None]
            d[inner, wanted] -= 1
            grads["w"][c] += mine.T @ d
            grads["wb"][c] += np.ones(len(d), d.dtype) @ d
            dh[a:b] += d @ p["w"][c].T
    back = np.empty_like(order)
    back[order] = rows
    out = out[back]
    dh = dh[back] if dh is not None else None
    return (out, dh) if grads is not None else out


def window_gradients(p: Params, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray,
                     grads: Params | None = None) -> tuple[Params, float, np.ndarray]:
    """Gradients of the summed loss of one window (added to ``grads``), the loss, and the state after it."""
    kept: list = []
    after = states(p, inputs, h, kept)
    grads = grads or {k: np.zeros_like(v) for k, v in p.items()}
    logs, dh_out = log_probability(p, after.reshape(-1, HIDDEN), targets.ravel(), grads)
    dh_out = dh_out.reshape(after.shape)
    back = np.zeros_like(h)
    dx = np.empty((*inputs.shape, 3 * HIDDEN), p["u"].dtype)  # by gate: r, z, new
    dg = np.empty_like(dx)
    for t in range(len(inputs) - 1, -1, -1):
        before, gate, m, new = kept[t]
        r, z = gate[:, :HIDDEN], gate[:, HIDDEN:]
        dh = dh_out[t] + back
        carried = dh * z
        dnew = dx[t, :, 2 * HIDDEN:]
        np.multiply(dh - carried, 1 - new * new, out=dnew)
        np.multiply(dnew, m, out=dx[t, :, :HIDDEN])
        np.multiply(dh, before - new, out=dx[t, :, HIDDEN:2 * HIDDEN])
        dx[t, :, :2 * HIDDEN] *= gate * (1 - gate)
        dg[t, :, :2 * HIDDEN] = dx[t, :, :2 * HIDDEN]
        np.multiply(dnew, r, out=dg[t, :, 2 * HIDDEN:])
        back = dg[t] @ p["u"].T
        back += carried
        back[inputs[t] == END] = 0
    dx, dg = dx.reshape(-1, 3 * HIDDEN), dg.reshape(-1, 3 * HIDDEN)
    grads["u"] += np.concatenate([k[0] for k in kept]).T @ dg
    grads["n"] += np.ones(len(dg), dg.dtype) @ dg[:, 2 * HIDDEN:]
    ids = inputs.ravel()
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
    grads["x"][ids[order][first]] += np.add.reduceat(dx[order], first, axis=0)
    return grads, -float(logs.sum()), after[-1]


def train(p: Params, stream: np.ndarray) -> Params:
    """One pass of truncated backpropagation over a stream of ids (texts end with END), by Adam."""
    lanes = min(MOST_LANES, max(LANES, len(stream) // (WINDOW * STEPS)), max(1, len(stream) // WINDOW))
    length = len(stream) // lanes
    if not length:
        return p
    rate = RATE * max(1.0, lanes / LANES) ** 0.5
    targets = stream[:lanes * length].reshape(lanes, length).T
    before = np.r_[END, stream[:-1]][:lanes * length].reshape(lanes, length).T
    values = flat(p)
    p = shaped(values, p)  # views: one update changes all weights
    first, second, g, size = (np.zeros_like(values) for _ in range(4))
    grads = shaped(g, p)
    h, step = np.zeros((lanes, HIDDEN), np.float32), 0
    windows = [(before[t:t + WINDOW], targets[t:t + WINDOW]) for t in range(0, length, WINDOW)]
    if lanes * length < len(stream):  # the few ids beyond equal lanes follow the last lane
        windows.append((stream[lanes * length - 1:-1, None], stream[lanes * length:, None]))
    for inputs, wanted in windows:
        g[:] = 0
        _, _, h = window_gradients(p, inputs, wanted, h[-inputs.shape[1]:], grads)
        step += 1
        g *= 1 / wanted.size
        np.clip(g, -0.5, 0.5, out=g)
        first *= 0.9
        first += np.multiply(g, 0.1, out=size)
        g *= g
        g *= 0.01
        second *= 0.99
        second += g
        np.sqrt(second, out=size)
        size *= 1 / (1 - 0.99 ** step) ** 0.5
        size += 1e-6
        np.divide(first, size, out=size)
        size *= rate / (1 - 0.9 ** step)
        values -= size
    return p


def score(p: Params, texts: list[np.ndarray]) -> np.ndarray:
    """The natural log-probability of every text (ids, END last), its state carried from its
    first to its last word; texts of like length run in parallel lanes."""
    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    for start in range(0, len(order), SCORE_LANES):
        group = order[start:start + SCORE_LANES]
        lengths = np.array([len(texts[i]) for i in group])
        h = np.zeros((len(group), HIDDEN), np.float32)
        for t in range(0, int(lengths[0]), SCORE_WINDOW):
            live = int((lengths > t).sum())  # longest first: ended lanes are at the back
            steps = int(min(SCORE_WINDOW, lengths[0] - t))
            targets = np.full((steps, live), END, np.int64)
            before = np.full((steps, live), END, np.int64)
            for lane in range(live):
                text = texts[group[lane]]
                part = text[t:t + steps]
                targets[:len(part), lane] = part
                before[1:len(part), lane] = part[:-1]
                before[0, lane] = text[t - 1] if t else END
            after = states(p, before, h[:live])
            h = after[-1]
            valid = np.arange(t, t + steps)[:, None] < lengths[:live]
            logs = log_probability(p, after[valid], targets[valid])
            out[group[:live]] += np.bincount(np.nonzero(valid)[1], weights=logs, minlength=live)
    return out
