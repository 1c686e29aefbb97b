"""A bidirectional gated recurrent network over bytes, in numpy.

Every position gets a class from the states of both directions; probabilities of a
segment are pooled from its positions. Trained by backpropagation through time with
Adam; the same seed and data give the same weights.
"""

from __future__ import annotations

import numpy as np

PAD = 0


def _squash(x: np.ndarray) -> None:
    """The logistic function in place; the exponential is several times faster than tanh."""
    with np.errstate(over="ignore"):
        np.negative(x, out=x)
        np.exp(x, out=x)
        x += 1
        np.reciprocal(x, out=x)


class ByteTagger:
    """Both directions run side by side: axis 0 of their parameters and states is the
    direction, and the backward one reads the bytes from the end."""

    def __init__(self, classes: int, hidden: int = 32, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        s = 1 / np.sqrt(hidden)
        self.classes, self.hidden = classes, hidden
        drawn = [(rng.normal(0, 0.3, (256, 3 * hidden)), rng.uniform(-s, s, (hidden, 3 * hidden))) for _ in range(2)]
        self.p = {
            "x": np.stack([x for x, _ in drawn]).astype(np.float32),
            "b": np.zeros((2, 3 * hidden), np.float32),
            "u": np.stack([u for _, u in drawn]).astype(np.float32),
            "c": np.zeros((2, 1, hidden), np.float32),
            "w": rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, classes)).astype(np.float32),
            "o": np.zeros(classes, np.float32),
        }
        self.moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.steps = 0

    def states(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x (T, B) bytes, mask (T, B, 1) -> (T, B, 2 H); a padded place keeps the state before it."""
        t_len, n = x.shape
        h_len = self.hidden
        inputs = np.empty((t_len, 2, n, 3 * h_len), self.p["x"].dtype)
        inputs[:, 0] = self.p["x"][0][x] + self.p["b"][0]
        inputs[:, 1] = self.p["x"][1][x[::-1]] + self.p["b"][1]
        both = np.stack([mask, mask[::-1]], 1)
        h = np.zeros((2, n, h_len), inputs.dtype)
        out = np.empty((t_len, 2, n, h_len), inputs.dtype)
        u, c = self.p["u"], self.p["c"]
        for t in range(t_len):
            hu = h @ u
            zr = inputs[t, :, :, : 2 * h_len] + hu[:, :, : 2 * h_len]
            _squash(zr)
            z, r = zr[:, :, :h_len], zr[:, :, h_len:]
            un = hu[:, :, 2 * h_len :] + c
            new = r * un
            new += inputs[t, :, :, 2 * h_len :]
            new *= 2
            _squash(new)
            new *= 2
            new -= 1
            if keep is not None:
                keep.append((both[t], h, z, r, un, new))
            step = new - h
            step *= 1 - z
            step *= both[t]
            h = np.add(h, step, out=out[t])
        return np.concatenate([out[:, 0], out[::-1, 1]], 2)

    def _learn(self, x: np.ndarray, keep: list, dout: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the recurrent parameters from those of the states."""
        t_len, n = x.shape
        h_len = self.hidden
        u = self.p["u"]
        back = u.transpose(0, 2, 1)
        d = np.stack([dout[:, :, :h_len], dout[::-1, :, h_len:]], 1)
        dh = np.zeros((2, n, h_len), u.dtype)
        dx = np.empty((t_len, 2, n, 3 * h_len), u.dtype)
        du, dc = np.zeros_like(u), np.zeros_like(self.p["c"])
        dhu = np.empty((2, n, 3 * h_len), u.dtype)
        for t in range(t_len - 1, -1, -1):
            mask, h, z, r, un, new = keep[t]
            dh = dh + d[t]
            dm = dh * mask
            keepz = 1 - z
            dnew = dm * keepz
            dh -= dnew
            dnew *= 1 - new * new
            dhu[:, :, :h_len] = dm * (h - new) * z * keepz
            dun = np.multiply(dnew, r, out=dhu[:, :, 2 * h_len :])
            dhu[:, :, h_len : 2 * h_len] = dnew * un * r * (1 - r)
            dx[t, :, :, : 2 * h_len] = dhu[:, :, : 2 * h_len]
            dx[t, :, :, 2 * h_len :] = dnew
            du += h.transpose(0, 2, 1) @ dhu
            dc += dun.sum(1, keepdims=True)
            dh += dhu @ back
        table = np.zeros_like(self.p["x"])
        for way in (0, 1):
            flat = dx[:, way].reshape(-1, 3 * h_len)
            byte = (x if way == 0 else x[::-1]).reshape(-1)
            order = np.argsort(byte, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(byte[order]) > 0])
            table[way, byte[order][starts]] = np.add.reduceat(flat[order], starts)
        return {"x": table, "b": dx.sum((0, 2)), "u": du, "c": dc}

    def log_probs(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        states = self.states(x, mask, keep)
        scores = states @ self.p["w"] + self.p["o"]
        scores -= scores.max(2, keepdims=True)
        return scores - np.log(np.exp(scores).sum(2, keepdims=True)), states

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(loss, gradients) of a batch; label (B,) holds for every position of a sequence."""
        keep: list = []
        logp, states = self.log_probs(x, mask, keep)
        n = mask.sum()
        each = np.arange(x.shape[1])
        d = np.exp(logp)
        d[:, each, label] -= 1
        d *= mask / n
        loss = -float((logp[:, each, label] * mask[:, :, 0]).sum() / n)
        grads = {"w": states.reshape(-1, states.shape[2]).T @ d.reshape(-1, self.classes), "o": d.sum((0, 1))}
        return loss, grads | self._learn(x, keep, d @ self.p["w"].T)

    def step(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray, rate: float) -> float:
        """One Adam step on a batch."""
        loss, grads = self.gradients(x, mask, label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        self.steps += 1
        for k, g in grads.items():
            g = g * scale
            m, v = self.moments.get(k, (np.zeros_like(g), np.zeros_like(g)))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.moments[k] = (m, v)
            self.p[k] -= (rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-8)).astype(np.float32)
        return loss

    def pooled(self, segments: list[bytes], window: int = 192, most: int = 32_768) -> np.ndarray:
        """Class probabilities of each segment: the mean log-probability of its positions,
        normalised. Long segments are read in windows that share the pool."""
        parts = [(i, s[k : k + window]) for i, s in enumerate(segments) for k in range(0, max(len(s), 1), window)]
        parts.sort(key=lambda q: len(q[1]))
        total = np.zeros((len(segments), self.classes), np.float64)
        count = np.zeros(len(segments))
        at = 0
        while at < len(parts):
            n = 1
            while at + n < len(parts) and (n + 1) * len(parts[at + n][1]) <= most:
                n += 1
            chunk = parts[at : at + n]
            at += n
            x, mask = batch([s for _, s in chunk])
            logp, _ = self.log_probs(x, mask)
            sums = (logp * mask).sum(0)
            who = np.array([i for i, _ in chunk])
            np.add.at(total, who, sums)
            np.add.at(count, who, mask.sum((0, 2)))
        # Neighbouring positions say much the same: a fifth of them counts as evidence.
        s = total / np.maximum(count, 1)[:, None] * np.maximum(1, count / 5)[:, None]
        s -= s.max(1, keepdims=True)
        e = np.exp(s)
        return e / e.sum(1, keepdims=True)

    def weights(self) -> dict[str, np.ndarray]:
        return dict(self.p)

    @classmethod
    def from_weights(cls, w: dict[str, np.ndarray]) -> ByteTagger:
        net = cls(w["o"].shape[0], w["c"].shape[2])
        net.p = dict(w)
        return net


def batch(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Segments as (T, B) bytes and their (T, B, 1) mask."""
    longest = max(1, max(map(len, segments), default=1))
    x = np.zeros((len(segments), longest), np.uint8)
    mask = np.zeros((len(segments), longest), np.float32)
    for i, s in enumerate(segments):
        x[i, : len(s)] = np.frombuffer(s, np.uint8)
        mask[i, : len(s)] = 1
    return np.ascontiguousarray(x.T), np.ascontiguousarray(mask.T)[:, :, None]


def train(segments: list[bytes], labels: list[int], classes: int, steps: int, size: int = 256, crop: int = 72, rate: float = 0.012, seed: int = 1, hidden: int = 32, net: ByteTagger | None = None) -> ByteTagger:
    """Fit on random crops; classes are drawn equally often, so rare ones are learnt too."""
    net = net or ByteTagger(classes, hidden, seed)
    rng = np.random.default_rng(seed)
    y = np.array(labels)
    by_class = [np.flatnonzero(y == c) for c in range(classes)]
    there = [c for c in range(classes) if len(by_class[c])]
    for i in range(steps):
        drawn = rng.choice(there, size)
        pick = np.array([by_class[c][rng.integers(len(by_class[c]))] for c in drawn])
        crops = []
        for k in pick:
            s = segments[k]
            start = int(rng.integers(0, max(1, len(s) - crop + 1)))
            crops.append(s[start : start + crop])
        x, mask = batch(crops)
        net.step(x, mask, drawn, rate * min(1.0, (i + 1) / 20) * (0.08 + 0.92 * (1 - i / steps)))
    return net
