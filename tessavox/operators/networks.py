"""Small networks that can be trained: parameters as arrays, logits of a batch, gradients of the parameters.

A network takes batches (n, height, width) or (n, depth, height, width). Larger ones plug in by the same three members.
"""

from __future__ import annotations

import numpy as np


class Linear:
    """weight * v + bias for each voxel."""

    def __init__(self, weight: float = 1.0, bias: float = 0.0) -> None:
        self.parameters = {"weight": np.array(weight, np.float64), "bias": np.array(bias, np.float64)}

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, object]:
        return self.parameters["weight"] * x + self.parameters["bias"], x

    def backward(self, memo: object, d: np.ndarray) -> dict[str, np.ndarray]:
        return {"weight": (d * memo).sum(), "bias": d.sum()}


class Convolution:
    """Channels of 3 x 3 (or 3 x 3 x 3) neighbourhoods, cut off at zero, and a weighted sum of them. Outside a patch all is zero."""

    def __init__(self, kernel=None, offset=None, weight=None, bias: float = 0.0, channels: int = 4, dimensions: int = 2, seed: int = 0) -> None:
        size, rng = 3**dimensions, np.random.default_rng(seed)
        first = {"kernel": rng.normal(0, np.sqrt(2 / size), (channels, size)), "offset": np.zeros(channels), "weight": rng.normal(0, np.sqrt(2 / channels), channels)}
        given = {"kernel": kernel, "offset": offset, "weight": weight}
        self.parameters = {k: first[k] if v is None else np.array(v, np.float64) for k, v in given.items()} | {"bias": np.array(bias, np.float64)}
        self.dimensions = 2 if self.parameters["kernel"].shape[1] == 9 else 3

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, object]:
        p, axes = self.parameters, tuple(range(x.ndim - self.dimensions, x.ndim))
        padded = np.pad(x, [(1, 1) if i in axes else (0, 0) for i in range(x.ndim)])
        around = np.lib.stride_tricks.sliding_window_view(padded, (3,) * self.dimensions, axes).reshape(x.size, -1)
        inner = around @ p["kernel"].T + p["offset"]
        return (np.maximum(inner, 0) @ p["weight"] + p["bias"]).reshape(x.shape), (around, inner)

    def backward(self, memo: object, d: np.ndarray) -> dict[str, np.ndarray]:
        around, inner = memo
        flat = d.ravel()
        back = flat[:, None] * self.parameters["weight"] * (inner > 0)
        return {"kernel": back.T @ around, "offset": back.sum(axis=0), "weight": np.maximum(inner, 0).T @ flat, "bias": flat.sum()}


#: By name: parameters -> network.
NETWORKS = {"linear": Linear, "convolution": Convolution}


def stored(network) -> dict:
    """A network's parameters as plain lists and numbers."""
    return {k: v.tolist() for k, v in network.parameters.items()}


def vector(values: dict[str, np.ndarray], like: dict[str, np.ndarray]) -> np.ndarray:
    """All values in the order of ``like``, in one vector."""
    return np.concatenate([np.ravel(values[k]) for k in like]).astype(np.float64)


def load(network, flat: np.ndarray) -> None:
    """Parameters from one vector."""
    at = 0
    for k, v in network.parameters.items():
        network.parameters[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
