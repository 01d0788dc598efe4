"""A bidirectional gated recurrent network in numpy: forward pass, backpropagation through time, Adam."""

from __future__ import annotations

import numpy as np

F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru_weights(rng: np.random.Generator, name: str, inputs: int, hidden: int) -> dict[str, np.ndarray]:
    """Input, recurrent and bias weights of one direction; gates in the order update, reset, candidate."""
    draw = lambda n: (rng.standard_normal((n, 3 * hidden)) / np.sqrt(n)).astype(F32)
    return {f"{name}_w": draw(inputs), f"{name}_u": draw(hidden), f"{name}_b": np.zeros(3 * hidden, F32)}


def gru_states(xp: np.ndarray, u: np.ndarray, reverse: bool, keep: list | None = None) -> np.ndarray:
    """States [time, batch, hidden] for projected inputs [time, batch, 3 * hidden]; ``keep`` collects
    what the backward pass needs."""
    steps, batch, wide = xp.shape
    hidden = wide // 3
    h, out = np.zeros((batch, hidden), F32), np.empty((steps, batch, hidden), F32)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        hu = h @ u
        zr = sigmoid(xp[t, :, : 2 * hidden] + hu[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        n = np.tanh(xp[t, :, 2 * hidden :] + r * hu[:, 2 * hidden :])
        if keep is not None:
            keep.append((t, h, z, r, n, hu[:, 2 * hidden :]))
        h = n + z * (h - n)
        out[t] = h
    return out


def gru_back(d_out: np.ndarray, u: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of ``u``, through time."""
    d_xp = np.empty((*d_out.shape[:2], 3 * d_out.shape[2]), F32)
    d_u, d_h = np.zeros_like(u), np.zeros(d_out.shape[1:], F32)
    for t, h, z, r, n, hun in reversed(keep):
        d = d_h + d_out[t]
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (h - n) * z * (1 - z)
        d_r = d_n * hun * r * (1 - r)
        d_xp[t] = np.concatenate([d_z, d_r, d_n], 1)
        d_hu = np.concatenate([d_z, d_r, d_n * r], 1)
        d_u += h.T @ d_hu
        d_h = d * z + d_hu @ u.T
    return d_xp, d_u


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.w[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(F32)
