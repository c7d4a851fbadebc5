"""A character BiLSTM with CRF transitions in numpy: training by Adam, emissions of windows, decoding of stretches."""

import numpy as np

#: Characters by class; the network sees classes only. 0 is outside a text.
_MARKS = " @.-+()_%:/#=,;[]"
CLASSES = 6 + len(_MARKS)


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    wide = (points >= 0xFF01) & (points <= 0xFF5E)  # full-width forms are read as what they stand for
    points = np.where(wide, points - np.uint32(0xFEE0), points)
    table = np.full(256, 5, np.int64)  # others
    table[48:58], table[97:123], table[65:91], table[9:14] = 1, 2, 3, 4
    for i, c in enumerate(_MARKS):
        table[ord(c)] = 6 + i
    return np.where(points < 256, table[np.minimum(points, 255)], 5)


def _lse(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Weights as a dict of arrays; `tags` classes per character."""

    def __init__(self, tags: int, hidden: int = 16, embed: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden, self.tags = hidden, tags
        self.w = {"embed": draw(CLASSES, embed), "out": draw(2 * hidden, tags), "out_b": np.zeros(tags, np.float32), "trans": np.zeros((tags, tags), np.float32)}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # remember at first
            self.w |= {f"x{d}": draw(embed, 4 * hidden), f"h{d}": draw(hidden, 4 * hidden), f"b{d}": bias}

    def _run(self, x, d, keep):
        """Hidden states (n, steps, hidden) of one direction; with `keep`, also what the way back needs."""
        n, steps, h = x.shape[0], x.shape[1], self.hidden
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        gates_in = x @ self.w[f"x{d}"] + self.w[f"b{d}"]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, held = np.empty((n, steps, h), np.float32), []
        for t in order:
            z = gates_in[:, t] + state @ self.w[f"h{d}"]
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before = (state, cell)
            cell = f * cell + i * g
            tc = np.tanh(cell)
            state = o * tc
            out[:, t] = state
            if keep:
                held.append((t, i, f, o, g, tc, *before))
        return out, held

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        x = self.w["embed"][ids]
        return np.concatenate([self._run(x, d, False)[0] for d in "fb"], axis=2) @ self.w["out"] + self.w["out_b"]

    def gradient(self, ids: np.ndarray, gold: np.ndarray):
        """Gradients of the mean negative log likelihood of the gold tags."""
        n, steps = ids.shape
        w, h = self.w, self.hidden
        x = w["embed"][ids]
        runs = {d: self._run(x, d, True) for d in "fb"}
        states = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        scores = states @ w["out"] + w["out_b"]
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[:, 0] = scores[:, 0]
        for t in range(1, steps):
            alpha[:, t] = scores[:, t] + _lse(alpha[:, t - 1, :, None] + w["trans"], 1)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = _lse(w["trans"] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        total = _lse(alpha[:, -1], 1)
        ds = np.exp(alpha + beta - total[:, None, None])
        rows, cols = np.arange(n)[:, None], np.arange(steps)
        ds[rows, cols, gold] -= 1
        pairs = alpha[:, :-1, :, None] + w["trans"] + (scores + beta)[:, 1:, None, :] - total[:, None, None, None]
        trans = np.exp(pairs).sum(axis=(0, 1))
        np.subtract.at(trans, (gold[:, :-1], gold[:, 1:]), 1)
        ds /= n * steps
        grad = {"trans": trans / (n * steps), "out": np.einsum("nth,ntk->hk", states, ds), "out_b": ds.sum((0, 1))}
        dstates = ds @ w["out"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            dout = dstates[:, :, k * h : (k + 1) * h]
            dstate, dcell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            dz_all = np.empty((n, steps, 4 * h), np.float32)
            dh = np.zeros_like(w[f"h{d}"])
            for t, i, f, o, g, tc, state, cell in reversed(runs[d][1]):
                dstate = dstate + dout[:, t]
                dcell = dcell + dstate * o * (1 - tc * tc)
                dz = dz_all[:, t]
                dz[:, :h] = dcell * g * i * (1 - i)
                dz[:, h : 2 * h] = dcell * cell * f * (1 - f)
                dz[:, 2 * h : 3 * h] = dstate * tc * o * (1 - o)
                dz[:, 3 * h :] = dcell * i * (1 - g * g)
                dh += state.T @ dz
                dstate, dcell = dz @ w[f"h{d}"].T, dcell * f
            grad |= {f"h{d}": dh, f"x{d}": np.einsum("nte,ntk->ek", x, dz_all), f"b{d}": dz_all.sum((0, 1))}
            dx += dz_all @ w[f"x{d}"].T
        grad["embed"] = np.zeros_like(w["embed"])
        np.add.at(grad["embed"], ids, dx)
        return grad

    def fit(self, ids: np.ndarray, gold: np.ndarray, steps: int = 420, batch: int = 64, rate: float = 0.02, seed: int = 11):
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(ids), min(batch, len(ids)))
            grad = self.gradient(ids[rows], gold[rows])
            now = rate * (1 - step / (steps + 1)) + 1e-3
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.w[k] = (self.w[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def decode(self, scores: list[np.ndarray], allowed: np.ndarray) -> list[np.ndarray]:
        """The best tags of every stretch of emissions; transitions that are not `allowed` are never taken."""
        trans = np.where(allowed, self.w["trans"], -1e4)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
        order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
        first = 0
        while first < len(order):
            longest = len(scores[order[first]]) * 5 // 4 + 16  # stretches of about one length together
            last = first
            while last < len(order) and last - first < 512 and len(scores[order[last]]) <= longest:
                last += 1
            part = order[first:last]
            lengths = np.array([len(scores[i]) for i in part])
            steps = int(lengths.max())
            padded = np.zeros((len(part), steps, self.tags), np.float32)
            for row, i in enumerate(part):
                padded[row, : lengths[row]] = scores[i]
            best, back = padded[:, 0], np.zeros((len(part), steps, self.tags), np.int8)
            best = best + np.where(allowed[0], 0, -1e4)  # as after an outside character
            ends = np.where((lengths == 1)[:, None], best, 0)
            for t in range(1, steps):
                paths = best[:, :, None] + trans
                back[:, t] = paths.argmax(axis=1)
                best = paths.max(axis=1) + padded[:, t]
                ends = np.where((lengths == t + 1)[:, None], best, ends)
            tags = np.zeros((len(part), steps), np.int64)
            at = ends.argmax(axis=1)
            rows = np.arange(len(part))
            for t in range(steps - 1, -1, -1):
                inside = t < lengths
                tags[:, t] = np.where(inside, at, 0)
                at = np.where(inside & (t > 0), back[rows, t, at], at)
            for row, i in enumerate(part):
                out[i] = tags[row, : lengths[row]]
            first = last
        return out
