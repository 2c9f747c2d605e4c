"""Gated-attention multiple-instance learning in numpy: fit and score bags of passage vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Attention:
    """Encoder (w, b), gated attention (v, u, a) and output (c, d), over inputs scaled by mean and spread."""

    mean: np.ndarray
    spread: np.ndarray
    p: dict[str, np.ndarray]

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each bag [bags[i], bags[i + 1]) of rows of x; every bag has a row."""
        return _forward(self.p, np.clip((x - self.mean) / self.spread, -8, 8), bags)["y"]


def _sums(values: np.ndarray, bags: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, bags[:-1], axis=0)


def _forward(p: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ p["w"] + p["b"])
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = (t * s) @ p["a"]
    owner = np.repeat(np.arange(len(bags) - 1), np.diff(bags))
    top = np.maximum.reduceat(e, bags[:-1])
    raw = np.exp(e - top[owner])
    weight = raw / _sums(raw, bags)[owner]
    z = _sums(weight[:, None] * h, bags)
    return {"h": h, "t": t, "s": s, "weight": weight, "owner": owner, "z": z, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))}


def _backward(p: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray, f: dict[str, np.ndarray], slope: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients from slope, the loss's derivative by each bag's log-odds."""
    by_row = slope[f["owner"]]
    dz = by_row[:, None] * p["c"]
    gain = (dz * f["h"]).sum(1)
    mean_gain = _sums(f["weight"] * gain, bags)[f["owner"]]
    de = f["weight"] * (gain - mean_gain)
    dts = de[:, None] * p["a"]
    dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
    dh = f["weight"][:, None] * dz + dt @ p["v"].T + ds @ p["u"].T
    dh *= 1 - f["h"] ** 2
    return {"w": x.T @ dh, "b": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ slope, "d": slope.sum(keepdims=True)}


def fit_attention(x: np.ndarray, bags: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, rounds: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Attention:
    """Adam on the cross-entropy of whole documents, the classes weighted equally in part."""
    rng = np.random.default_rng(seed)
    mean, spread = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"w": draw(x.shape[1], hidden), "b": np.zeros(hidden), "v": draw(hidden, gate), "u": draw(hidden, gate), "a": draw(gate), "c": draw(hidden), "d": np.zeros(1)}
    if not len(y):
        p["c"] *= 0
        return Attention(mean, spread, p)
    scaled = np.clip((x - mean) / spread, -8, 8)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    balance = np.where(y > 0.5, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share)))
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for k in range(rounds):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            pick = np.sort(order[at : at + batch])
            sizes = np.diff(bags)[pick]
            rows = np.repeat(bags[pick] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            own = np.concatenate([[0], np.cumsum(sizes)])
            f = _forward(p, scaled[rows], own)
            grad = _backward(p, scaled[rows], own, f, (f["y"] - y[pick]) * balance[pick] / len(pick))
            step += 1
            speed = rate * (1 - k / rounds) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, g in grad.items():
                g = g + decay * p[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g**2
                p[name] = p[name] - speed * first[name] / (np.sqrt(second[name]) + 1e-8)
    return Attention(mean, spread, p)
