"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, decoding."""

from __future__ import annotations

import numpy as np

#: Character ids: ASCII as it is, one id for all else, one for padding.
OTHER, PAD, VOCAB = 128, 129, 130


def char_ids(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), OTHER).astype(np.int16)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


class Tagger:
    """Both directions are computed together: parameters and states have a leading axis of two."""

    def __init__(self, tags: int, hidden: int = 16, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.hidden, self.tags = hidden, tags
        self.p = {
            "E": 0.3 * rng.standard_normal((2, VOCAB, 4 * hidden)).astype(np.float32), "U": w(2, hidden, 4 * hidden),
            "W": w(2 * hidden, tags), "b": np.zeros(tags, np.float32), "T": np.zeros((tags, tags), np.float32), "S": np.zeros(tags, np.float32),
        }
        self.p["E"][:, :, hidden : 2 * hidden] += 1.0  # forget gates start open

    def _states(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """(hidden states (2, length, rows, hidden) in each direction's own order, what the backward pass needs)."""
        h, n = self.hidden, len(x)
        both = np.stack([x.T, x[:, ::-1].T])  # 2, length, rows
        inputs = np.stack([self.p["E"][0][both[0]], self.p["E"][1][both[1]]])
        hid, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out, kept = np.empty((2, x.shape[1], n, h), np.float32), []
        for t in range(x.shape[1]):
            z = inputs[:, t] + hid @ self.p["U"]
            gates = _sigmoid(z)
            i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 3 * h :]
            g = np.tanh(z[..., 2 * h : 3 * h])
            before, prev = cell, hid
            cell = f * cell + i * g
            tc = np.tanh(cell)
            hid = o * tc
            out[:, t] = hid
            kept.append((i, f, g, o, before, tc, prev))
        return out, [both, kept]

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        out, kept = self._states(x)
        joined = np.concatenate([out[0], out[1][::-1]], axis=-1)  # length, rows, 2 hidden
        return joined @ self.p["W"] + self.p["b"], joined, kept

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood a row, and its gradients."""
        e, joined, (both, kept) = self.emissions(x)
        length, n, k = e.shape
        tr, y = self.p["T"], y.T
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = self.p["S"] + e[0]
        for t in range(1, length):
            alpha[t] = e[t] + _logsumexp(alpha[t - 1][:, :, None] + tr, 1)
        for t in range(length - 2, -1, -1):
            beta[t] = _logsumexp(tr[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsumexp(alpha[-1], 1)
        rows = np.arange(n)
        gold = self.p["S"][y[0]] + e[np.arange(length)[:, None], rows, y].sum(0) + tr[y[:-1], y[1:]].sum(0)
        de = np.exp(alpha + beta - z[:, None])
        pair = np.exp(alpha[:-1, :, :, None] + tr + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None])
        dt = pair.sum((0, 1))
        np.subtract.at(dt, (y[:-1].ravel(), y[1:].ravel()), 1)
        ds = de[0].sum(0) - np.bincount(y[0], minlength=k)
        de[np.arange(length)[:, None], rows, y] -= 1
        de /= n
        dj = de @ self.p["W"].T
        h = self.hidden
        dout = np.stack([dj[..., :h], dj[::-1, :, h:]])
        dh, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        dz = np.empty((2, length, n, 4 * h), np.float32)
        du = np.zeros_like(self.p["U"])
        ut = self.p["U"].transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            i, f, g, o, before, tc, prev = kept[t]
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            d = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - g * g), dh * tc * o * (1 - o)], axis=-1)
            dz[:, t] = d
            du += prev.transpose(0, 2, 1) @ d
            dh, dc = d @ ut, dc * f
        dE = np.zeros_like(self.p["E"])
        for s in range(2):
            np.add.at(dE[s], both[s].ravel(), dz[s].reshape(-1, 4 * h))
        grads = {"E": dE, "U": du, "W": joined.reshape(-1, 2 * h).T @ de.reshape(-1, k), "b": de.sum((0, 1)), "T": dt / n, "S": ds / n}
        return float((z - gold).mean()), grads

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, rows: int = 64, rate: float = 0.02, seed: int = 7) -> float:
        """Adam over random batches; returns the mean loss of the last tenth of the steps."""
        rng = np.random.default_rng(seed)
        m, v, last = {}, {}, []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), min(rows, len(x)))
            loss, grads = self.gradients(x[pick], y[pick])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / max(size, 1e-9))
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                now = rate * (1 - 0.9 * step / steps)
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            if step > steps * 0.9:
                last.append(loss)
        return float(np.mean(last)) if last else float("nan")

    def decode(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tags, marginals) of sequences of emissions (length, rows, tags): the best tags of each row (Viterbi), and the
        probability of each of them given the whole sequence (forward and backward sums)."""
        length, n, k = e.shape
        e, tr = e.astype(float), self.p["T"].astype(float)  # sums of long sequences are large
        score, back = self.p["S"] + e[0], np.empty((length, n, k), np.int8)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = score
        for t in range(1, length):
            tried = score[:, :, None] + tr
            back[t] = tried.argmax(1)
            score = tried.max(1) + e[t]
            alpha[t] = e[t] + _logsumexp(alpha[t - 1][:, :, None] + tr, 1)
        for t in range(length - 2, -1, -1):
            beta[t] = _logsumexp(tr[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        out = np.empty((n, length), np.int8)
        out[:, -1] = score.argmax(1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(n), out[:, t]]
        share = np.exp(alpha + beta - _logsumexp(alpha[-1], 1)[None, :, None])
        return out, np.take_along_axis(share.transpose(1, 0, 2), out[:, :, None].astype(int), 2)[:, :, 0]
