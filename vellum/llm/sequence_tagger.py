"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding.

Labels are 0 (outside) and, for kind k, 2k + 1 (begins) and 2k + 2 (goes on). Sequences have one length;
shorter ones are padded with character 0, which is outside.
"""

from __future__ import annotations

import numpy as np

NEVER = -1e4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Embeddings, two LSTMs and a CRF over ``labels`` labels."""

    def __init__(self, characters: int, kinds: int, embed: int = 12, hidden: int = 24, seed: int = 6):
        rng, labels = np.random.default_rng(seed), 2 * kinds + 1
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.hidden, self.labels = hidden, labels
        forget = np.tile(np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]), (2, 1, 1))
        self.p = {"embed": rng.normal(0, 0.3, (characters, embed)).astype(np.float32), "out": draw(2 * hidden, labels), "out_b": np.zeros(labels, np.float32), "trans": np.zeros((labels, labels), np.float32)}
        # the first of two is the forward direction's
        self.p |= {"x": np.stack([draw(embed, 4 * hidden), draw(embed, 4 * hidden)]), "h": np.stack([draw(hidden, 4 * hidden), draw(hidden, 4 * hidden)]), "b": forget.astype(np.float32)}
        # a kind goes on only behind itself; nothing begins by going on
        self.allowed = np.zeros((labels, labels), np.float32)
        for going in range(2, labels, 2):
            self.allowed[:, going] = NEVER
            self.allowed[[going - 1, going], going] = 0
        self.begin = np.array([0.0] + [0.0, NEVER] * kinds, np.float32)

    def _lstm(self, ids: np.ndarray, kept: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States, (steps, directions, rows, hidden), of (steps, rows) characters, the second direction's in reading order; and the inputs alike. ``kept`` takes what going back needs."""
        both = np.stack([ids, ids[::-1]], axis=1)
        x, H = self.p["embed"][both], self.hidden
        out = np.empty((*both.shape, H), x.dtype)
        h = c = np.zeros((2, both.shape[2], H), x.dtype)
        gates = x @ self.p["x"] + self.p["b"]
        for t, z in enumerate(gates):
            z += h @ self.p["h"]
            s, g = _sigmoid(z[:, :, : 3 * H]), np.tanh(z[:, :, 3 * H :])
            i, f, o, before = s[:, :, :H], s[:, :, H : 2 * H], s[:, :, 2 * H :], c
            c = f * c + i * g
            tc = np.tanh(c)
            h = out[t] = o * tc
            if kept is not None:
                kept.append((i, f, o, g, tc, before))
        return out, x

    def _scored(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both directions' states side by side in the order of the text, and the scores of labels."""
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
        return both, both @ self.p["out"] + self.p["out_b"]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Scores of labels, (steps, rows, labels), of (rows, steps) characters."""
        return self._scored(self._lstm(ids.T)[0])[1]

    def gradient(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of gold labels per row, and its gradient."""
        p, H, gold, kept = self.p, self.hidden, gold.T, []
        states, x = self._lstm(ids.T, kept)
        steps, _, rows, _ = states.shape
        both, s = self._scored(states)
        trans = p["trans"] + self.allowed
        # sums over paths, each step's brought to one so that nothing overflows
        most, jump = s.max(axis=2, keepdims=True), np.exp(trans)
        u = np.exp(s - most)
        alpha, beta, size = np.empty_like(u), np.ones_like(u), np.empty((steps, rows, 1), u.dtype)
        for t in range(steps):
            now = u[0] * np.exp(self.begin) if t == 0 else (alpha[t - 1] @ jump) * u[t]
            size[t] = now.sum(axis=1, keepdims=True)
            alpha[t] = now / size[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = (u[t + 1] * beta[t + 1] / size[t + 1]) @ jump.T
        total = (np.log(size) + most).sum(axis=0)[:, 0]
        ds = alpha * beta
        labels = self.labels
        d_trans = jump * (alpha[:-1].reshape(-1, labels).T @ (u * beta / size)[1:].reshape(-1, labels))
        np.add.at(d_trans, (gold[:-1].ravel(), gold[1:].ravel()), -1)
        at = np.arange(steps)[:, None], np.arange(rows)[None, :]
        gold_score = s[(*at, gold)].sum(0) + trans[gold[:-1], gold[1:]].sum(0)
        ds[(*at, gold)] -= 1
        ds /= rows
        g = {"trans": d_trans / rows, "out": both.reshape(-1, 2 * H).T @ ds.reshape(-1, labels), "out_b": ds.sum((0, 1))}
        back = ds @ p["out"].T
        part = np.stack([back[:, :, :H], back[::-1, :, H:]], axis=1)
        dz = np.empty((steps, 2, rows, 4 * H), x.dtype)
        dh = dc = np.zeros((2, rows, H), x.dtype)
        turned = p["h"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            i, f, o, c_in, tc, before = kept[t]
            dh = dh + part[t]
            dc = dc + dh * o * (1 - tc * tc)
            z = dz[t]
            z[:, :, :H], z[:, :, H : 2 * H] = dc * c_in * i * (1 - i), dc * before * f * (1 - f)
            z[:, :, 2 * H : 3 * H], z[:, :, 3 * H :] = dh * tc * o * (1 - o), dc * i * (1 - c_in * c_in)
            dh, dc = z @ turned, dc * f
        by_direction = lambda a: a.transpose(1, 0, 2, 3).reshape(2, -1, a.shape[3])
        flat = by_direction(dz)
        g["x"] = by_direction(x).transpose(0, 2, 1) @ flat
        g["h"] = by_direction(states[:-1]).transpose(0, 2, 1) @ by_direction(dz[1:])
        g["b"] = flat.sum(axis=1, keepdims=True)
        dx = dz @ p["x"].transpose(0, 2, 1)
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], np.stack([ids.T, ids.T[::-1]], axis=1).ravel(), dx.reshape(-1, dx.shape[3]))
        return float((total - gold_score).mean()), g

    def train(self, ids: np.ndarray, gold: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 1) -> list[float]:
        """Adam over the examples; mean losses by epoch."""
        rng, losses, step = np.random.default_rng(seed), [], 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for epoch in range(epochs):
            order, own = rng.permutation(len(ids)), []
            for first in range(0, len(order), batch):
                some = order[first : first + batch]
                loss, g = self.gradient(ids[some], gold[some])
                step += 1
                own.append(loss)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] = (self.p[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            losses.append(float(np.mean(own)))
        return losses

    def decode(self, ids: np.ndarray, lean: float = 0.0) -> np.ndarray:
        """The likeliest labels of (rows, steps) characters, with ``lean`` added to the score of each character in a span."""
        s, trans = self.scores(ids), self.p["trans"] + self.allowed
        s[:, :, 1:] += np.float32(lean)
        best, back = s[0] + self.begin, np.empty(s.shape, np.int8)
        for t in range(1, len(s)):
            through = best[:, :, None] + trans
            back[t] = through.argmax(1)
            best = through.max(1) + s[t]
        out = np.empty(ids.shape, np.int8)
        out[:, -1] = best.argmax(1)
        for t in range(len(s) - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(len(ids)), out[:, t]]
        return out


def spans_of(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the spans in a row of labels."""
    out, start = [], None
    for t, label in enumerate([*labels.tolist(), 0]):
        if start is not None and (label != labels[start] + 1):
            out.append(((int(labels[start]) - 1) // 2, start, t))
            start = None
        if label % 2:
            start = t
    return out
