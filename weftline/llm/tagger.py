"""Character-level bidirectional LSTM with a CRF layer, in numpy."""

from __future__ import annotations

import numpy as np

EMBED, HIDDEN = 16, 24


def symbol_table() -> tuple[np.ndarray, int]:
    """Code point below 128 to symbol; letters by lower case, digits as one, marks singly. The last symbol stands for all other characters."""
    table, n = np.zeros(128, np.int64), 1  # 0 pads
    for c in range(128):
        ch = chr(c)
        if ch.isupper():
            continue
        if ch.isdigit() and ch != "0":
            table[c] = table[ord("0")]
            continue
        table[c] = n
        n += 1
    for c in range(65, 91):
        table[c] = table[c + 32]
    return table, n + 1


SYMBOLS, N_SYMBOLS = symbol_table()


def encode(points: np.ndarray) -> np.ndarray:
    return np.where(points < 128, SYMBOLS[np.minimum(points, 127)], N_SYMBOLS - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Tags of characters; ids of 0 (padding) only stand at the end of a row."""

    def __init__(self, tags: int, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        def draw(*s):
            return rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"emb": draw(N_SYMBOLS, EMBED), "out": draw(2 * HIDDEN, tags), "out_b": np.zeros(tags, np.float32), "move": np.zeros((tags, tags), np.float32), "first": np.zeros(tags, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": draw(EMBED, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1  # gates: in, forget, out, new

    def _run(self, gates: np.ndarray, d: str, mask: np.ndarray, trace: list | None) -> np.ndarray:
        n, length, h4 = gates.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, length, HIDDEN), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = gates[:, t] + h @ self.p[f"h{d}"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            c2 = f * c + i * g
            m = mask[:, t, None]
            tc = np.tanh(c2)
            if trace is not None:
                trace.append((t, h, c, i, f, o, g, tc))
            c, h = np.where(m, c2, c), np.where(m, o * tc, h)
            out[:, t] = h
        return out

    def scores(self, ids: np.ndarray, traces: dict | None = None) -> np.ndarray:
        mask, parts = ids > 0, []
        for d in "fb":
            gates = (self.p["emb"] @ self.p[f"x{d}"] + self.p[f"b{d}"])[ids]
            trace = traces.setdefault(d, []) if traces is not None else None
            parts.append(self._run(gates, d, mask, trace))
        both = np.concatenate(parts, axis=2)
        if traces is not None:
            traces["both"] = both
        return both @ self.p["out"] + self.p["out_b"]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Best tag sequence of each row."""
        return self.best_path(self.scores(ids), ids > 0)

    def best_path(self, s: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The tags of greatest score and moves in each row of s (rows, places, tags); 0 outside the mask, which ends rows early."""
        move = self.p["move"]
        n, length, k = s.shape
        best, back = s[:, 0] + self.p["first"], np.zeros((n, length, k), np.int8)
        for t in range(1, length):
            ways = best[:, :, None] + move[None]
            inside = mask[:, t, None]
            back[:, t] = np.where(inside, ways.argmax(axis=1), np.arange(k))
            best = np.where(inside, ways.max(axis=1) + s[:, t], best)
        tags = np.zeros((n, length), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return np.where(mask, tags, 0)

    def _loss_slopes(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        traces: dict = {}
        s, mask, move = self.scores(ids, traces), ids > 0, self.p["move"]
        n, length, k = s.shape
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0] + self.p["first"]
        for t in range(1, length):
            a = _logsum(alpha[:, t - 1][:, :, None] + move[None], 1) + s[:, t]
            alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            b = _logsum(move[None] + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], b, beta[:, t + 1])
        total = _logsum(alpha[:, -1], 1)
        near = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        hot = np.eye(k, dtype=np.float32)[gold] * mask[:, :, None]
        ds = (near - hot) / n
        slopes = {key: np.zeros_like(v) for key, v in self.p.items()}
        slopes["first"] = ds[:, 0].sum(axis=0)
        picked = (s * hot).sum() + self.p["first"][gold[:, 0]].sum()
        for t in range(1, length):
            m = mask[:, t]
            pair = np.exp(alpha[:, t - 1][:, :, None] + move[None] + (s[:, t] + beta[:, t])[:, None, :] - total[:, None, None]) * m[:, None, None]
            slopes["move"] += pair.sum(axis=0) / n
            np.add.at(slopes["move"], (gold[m, t - 1], gold[m, t]), -1.0 / n)
            picked += move[gold[m, t - 1], gold[m, t]].sum()
        slopes["out"] = np.einsum("ntj,ntk->jk", traces["both"], ds)
        slopes["out_b"] = ds.sum(axis=(0, 1))
        dboth = ds @ self.p["out"].T
        for d, part in (("f", dboth[:, :, :HIDDEN]), ("b", dboth[:, :, HIDDEN:])):
            dh = dc = np.zeros((n, HIDDEN), np.float32)
            dgates = np.zeros((n, length, 4 * HIDDEN), np.float32)
            for t, h, c, i, f, o, g, tc in reversed(traces[d]):
                m = mask[:, t, None]
                dh = dh + part[:, t]
                keep_h, keep_c = np.where(m, 0, dh), np.where(m, 0, dc)
                dh, dc = np.where(m, dh, 0), np.where(m, dc, 0)
                dc2 = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dh * tc * o * (1 - o), dc2 * i * (1 - g * g)], axis=1)
                dgates[:, t] = dz
                slopes[f"h{d}"] += h.T @ dz
                dh, dc = dz @ self.p[f"h{d}"].T + keep_h, dc2 * f + keep_c
            flat_ids, flat = ids.ravel(), dgates.reshape(-1, 4 * HIDDEN)
            table = np.zeros((N_SYMBOLS, 4 * HIDDEN), np.float32)
            np.add.at(table, flat_ids, flat)
            slopes[f"b{d}"] = flat.sum(axis=0)
            slopes[f"x{d}"] = self.p["emb"].T @ table
            slopes["emb"] += table @ self.p[f"x{d}"].T
        return float((total.sum() - picked) / n), slopes

    def train(self, ids: np.ndarray, gold: np.ndarray, steps: int, batch: int = 48, rate: float = 0.012, seed: int = 4) -> list[float]:
        """Adam with clipped slopes; returns the loss of each step."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(ids), batch)
            loss, slopes = self._loss_slopes(ids[pick], gold[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in slopes.values()))
            scale, pace = min(1.0, 5.0 / (norm + 1e-9)), rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in slopes.items():
                g = g * scale
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.p[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return losses
