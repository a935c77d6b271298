"""Fixed weights of the scoring queries, drawn from a seed, and dense layers as SQL text for their DuckDB counterparts."""

from __future__ import annotations

import numpy as np


def draw(seed: int, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {name: np.round(rng.normal(size=shape) / 2, 2) for name, shape in shapes.items()}


def affine(columns: list[str], weights: np.ndarray, bias: np.ndarray) -> list[str]:
    """SQL of columns @ weights + bias, one expression a result."""
    return ["(" + " + ".join([f"{float(bias[k])!r}::DOUBLE", *(f"({c}) * {float(w)!r}::DOUBLE" for c, w in zip(columns, weights[:, k]))]) + ")" for k in range(weights.shape[1])]


def relu(columns: list[str]) -> list[str]:
    return [f"greatest({c}, 0)" for c in columns]


def sigmoid(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def named(columns: list[str], prefix: str) -> str:
    """Expressions as prefix0, prefix1, ... of a select list."""
    return ", ".join(f"{c} AS {prefix}{k}" for k, c in enumerate(columns))


#: Node features 2, time code 2, edge features 1.
SUM_LAYERS = [draw(31 + k, {"w1": (5, 2), "b1": (2,), "w2": (6, 2), "b2": (2,)}) for k in range(2)]
ATTENTION = draw(41, {"wq": (4, 4), "bq": (4,), "wk": (5, 4), "bk": (4,), "wv": (5, 4), "bv": (4,), "wo": (4, 4), "bo": (4,), "m1": (6, 3), "c1": (3,), "m2": (3, 2), "c2": (2,)}) | {"heads": np.array(2)}
TIME = draw(51, {"weight": (2,), "bias": (2,)})
#: Node features 2 to 2, with one number of the event and a time code of 4 to 4; two heads, one layer.
EVENTS = draw(61, {"node": (2, 2), "node_b": (2,), "event": (9, 4), "event_b": (4,), "qkv0": (4, 12), "qkv0_b": (12,), "out0": (4, 4), "out0_b": (4,), "norm": (4,), "norm_b": (4,), "hidden": (4, 3), "hidden_b": (3,), "last": (3, 1), "last_b": (1,)})
#: Node features 2 to 2, one number of the event, a time code of 2, two numbers of the type.
EMBEDDED = draw(71, {"node": (2, 2), "node_b": (2,), "hidden": (9, 3), "hidden_b": (3,), "last": (3, 1), "last_b": (1,)})
#: Two neighbour layers of 2 to 2 and 3 numbers; ends, one number of the edge and a time code of 2 to 4.
SAVED = draw(81, {"self0": (2, 2), "nbr0": (2, 2), "bias0": (2,), "self1": (2, 3), "nbr1": (2, 3), "bias1": (3,), "hidden": (9, 4), "hidden_b": (4,), "last": (4,), "last_b": ()})
DECODER = draw(91, {"w0": (2, 4), "b0": (4,), "w1": (4, 3), "b1": (3,), "w2": (3, 1), "b2": (1,)})
