"""A bidirectional gated recurrent network over bytes, in numpy: training by backpropagation
through time, and labels of every position.

Arrays are feature-major: a state is (hidden, windows), so every gate is one contiguous block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PAD = 256


@dataclass(frozen=True)
class Network:
    """``tables``: input weights of both directions, (257, 3 * hidden); positions past the end have the
    number PAD, where states are zero; ``recurrent``: (3 * hidden, hidden) each; ``out``: (classes, 2 * hidden); ``bias``."""

    tables: tuple
    recurrent: tuple
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, self.out, self.bias]


def fresh(classes: int, hidden: int, seed: int, dtype=np.float32) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(dtype)
    return Network(tuple(draw(257, 3 * hidden, scale=0.3) for _ in "fb"), tuple(draw(3 * hidden, hidden, scale=0.3) for _ in "fb"),
                   draw(classes, 2 * hidden, scale=0.3), np.zeros(classes, dtype))


def _gates(inputs, state, recurrent):
    """Update and reset gates, candidate, and the recurrent part of the candidate."""
    hidden = len(state)
    back = recurrent @ state
    both = np.tanh((inputs[:2 * hidden] + back[:2 * hidden]) * inputs.dtype.type(0.5))
    both += 1
    both *= inputs.dtype.type(0.5)
    candidate = np.tanh(inputs[2 * hidden:] + both[hidden:] * back[2 * hidden:])
    return both, candidate, back[2 * hidden:]


def _sweep(table, recurrent, text, keep=None):
    """States after each position of ``text`` (steps, windows), in the order given."""
    hidden = recurrent.shape[1]
    states = np.zeros((len(text) + 1, hidden, text.shape[1]), table.dtype)
    for t, column in enumerate(text):
        both, candidate, back = _gates(np.ascontiguousarray(table[column].T), states[t], recurrent)
        np.subtract(states[t], candidate, out=states[t + 1])
        states[t + 1] *= both[:hidden]
        states[t + 1] += candidate
        if (past := column == PAD).any():                    # nothing has been read there
            states[t + 1][:, past] = 0
        if keep is not None:
            keep.append((both, candidate, back))
    return states


def position_probabilities(net: Network, text: np.ndarray) -> np.ndarray:
    """Class probabilities of every position: (classes, steps, windows) for text (steps, windows)."""
    hidden = net.recurrent[0].shape[1]
    steps, windows = text.shape
    ahead = _sweep(net.tables[0], net.recurrent[0], text)[1:]
    behind = _sweep(net.tables[1], net.recurrent[1], text[::-1])[:0:-1]
    scores = np.matmul(net.out[:, :hidden], ahead) + np.matmul(net.out[:, hidden:], behind) + net.bias[:, None]
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores.transpose(1, 0, 2)


def loss_and_gradient(net: Network, text: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy of every position that isn't PAD, and its gradient by parameter, going
    back through all steps of both directions."""
    hidden = net.recurrent[0].shape[1]
    orders = (text, text[::-1])
    kept: tuple = ([], [])
    states = [_sweep(net.tables[d], net.recurrent[d], orders[d], kept[d]) for d in (0, 1)]
    ahead, behind = states[0][1:], states[1][:0:-1]
    scores = np.matmul(net.out[:, :hidden], ahead) + np.matmul(net.out[:, hidden:], behind) + net.bias[:, None]
    scores -= scores.max(axis=1, keepdims=True)
    logs = scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))
    there = (text != PAD).astype(scores.dtype) / max(1, int((text != PAD).sum()))
    picked = np.arange(text.shape[1])
    loss = float(-(logs[:, label, picked] * there).sum())
    wrong = np.exp(logs)
    wrong[:, label, picked] -= 1
    wrong *= there[:, None, :]
    gradient = [np.zeros_like(p) for p in net.parameters()]
    gradient[5] += wrong.sum(axis=(0, 2))
    for d, seen in ((0, ahead), (1, behind)):
        part = slice(d * hidden, (d + 1) * hidden)
        gradient[4][:, part] += np.einsum("tcw,thw->ch", wrong, seen, optimize=True)
        outer = np.matmul(net.out[:, part].T, wrong)
        outer = outer if d == 0 else outer[::-1]
        carried = np.zeros_like(states[d][0])
        for t in range(len(text) - 1, -1, -1):
            both, candidate, back = kept[d][t]
            z, r, before = both[:hidden], both[hidden:], states[d][t]
            carried = (carried + outer[t]) * (orders[d][t] != PAD)
            inner = carried * (1 - z) * (1 - candidate * candidate)
            to_z, to_r = carried * (before - candidate) * z * (1 - z), inner * back * r * (1 - r)
            inputs = np.concatenate([to_z, to_r, inner])
            looped = np.concatenate([to_z, to_r, inner * r])
            np.add.at(gradient[d], orders[d][t], inputs.T)
            gradient[2 + d] += looped @ before.T
            carried = carried * z + net.recurrent[d].T @ looped
    return loss, gradient


def train(text: np.ndarray, label: np.ndarray, classes: int, hidden: int = 8, steps: int = 400, batch: int = 96,
          rate: float = 0.02, seed: int = 7) -> Network:
    """Fit a network to windows ``text`` (windows, steps) of bytes and PAD with one label each, by
    Adam with a rate that falls to nothing.  The same input gives the same network."""
    net, rng = fresh(classes, hidden, seed), np.random.default_rng(seed)
    params = net.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(text), batch)
        _, gradient = loss_and_gradient(net, np.ascontiguousarray(text[rows].T), label[rows])
        now = rate * (1 - (step - 1) / steps)
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradient))
        for p, g, m, v in zip(params, gradient, first, second):
            g = g / max(1.0, norm)
            m += (g - m) * 0.1
            v += (g * g - v) * 0.01
            p -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return net
