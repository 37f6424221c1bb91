"""Small feed-forward networks: trained on the driver on a set of a stated size, applied by the executors."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DataError
from .labels import LabelEncoder
from .reduction import _map_points

MOST = 200_000
FORWARD = {
    "identity": lambda x: x,
    "sigmoid": lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500))),
    "relu": lambda x: np.maximum(x, 0),
    "tanh": np.tanh,
}
#: Derivatives by the activation's own output.
SLOPE = {"identity": np.ones_like, "sigmoid": lambda y: y * (1 - y), "relu": lambda y: (y > 0).astype(float), "tanh": lambda y: 1 - y * y}


@dataclass
class MLP:
    """Dense layers, squared error, stochastic gradients with momentum."""

    hidden: tuple[int, ...] = (3, 3)
    activation: str = "relu"
    output: str = "identity"
    max_iter: int = 1000
    learn_rate: float = 0.01
    momentum: float = 0.9
    batch: int = 50
    validation: float = 0.2
    seed: int = 42
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)

    def start(self, inputs: int, outputs: int) -> MLP:
        random, sizes = np.random.default_rng(self.seed), [inputs, *self.hidden, outputs]
        edge = [np.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        new = copy.copy(self)
        new.weights = [random.uniform(-e, e, (a, b)) for e, a, b in zip(edge, sizes, sizes[1:], strict=False)]
        new.biases = [np.zeros(b) for b in sizes[1:]]
        return new

    def _kinds(self) -> list[str]:
        return [self.activation] * (len(self.weights) - 1) + [self.output]

    def outputs(self, x: np.ndarray, tap_in: int = 0, tap_out: int = -1) -> list[np.ndarray]:
        """Values of every layer from ``tap_in`` to ``tap_out`` (-1: the last)."""
        out, last = [x], len(self.weights) if tap_out < 0 else tap_out
        for k in range(tap_in, last):
            out.append(FORWARD[self._kinds()[k]](out[-1] @ self.weights[k] + self.biases[k]))
        return out

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        return float(((self.outputs(x)[-1] - y) ** 2).sum() / max(1, len(x)))

    def train(self, x: np.ndarray, y: np.ndarray) -> float:
        """Trains in place and gives the error; -1, with the model as before, if it isn't a number."""
        random = np.random.default_rng(self.seed)
        before = [copy.deepcopy(self.weights), copy.deepcopy(self.biases)]
        order = random.permutation(len(x))
        held = int(self.validation * len(x))
        test, rows = order[:held], order[held:]
        size = min(self.batch, len(rows))
        step_w, step_b = [np.zeros_like(w) for w in self.weights], [np.zeros_like(b) for b in self.biases]
        last, patience, error = np.inf, 10, 0.0
        for _ in range(self.max_iter):
            rows = random.permutation(rows)
            # What is left over joins the first batch.
            edges = [0, *range(size + len(rows) % size, len(rows) + 1, size)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = rows[a:b]
                layers = self.outputs(x[part])
                grad = 2 * (layers[-1] - y[part]) / len(part) * SLOPE[self.output](layers[-1])
                for k in range(len(self.weights) - 1, -1, -1):
                    w, bias = layers[k].T @ grad, grad.sum(axis=0)
                    if k:
                        grad = grad @ self.weights[k].T * SLOPE[self.activation](layers[k])
                    step_w[k] = self.momentum * step_w[k] + (1 - self.momentum) * self.learn_rate * w
                    step_b[k] = self.momentum * step_b[k] + (1 - self.momentum) * self.learn_rate * bias
                    self.weights[k] = self.weights[k] - step_w[k]
                    self.biases[k] = self.biases[k] - step_b[k]
            error = self.loss(x[rows], y[rows])
            if not np.isfinite(error):
                self.weights, self.biases = before
                return -1.0
            if held:
                now = self.loss(x[test], y[test])
                patience = 10 if now < last else patience - 1
                last = now
                if patience <= 0:
                    break
        return error

    def transform(self, ds: DataFrame, tap_in: int = 0, tap_out: int = -1) -> DataFrame:
        model = self
        return _map_points(ds, lambda x: model.outputs(x, tap_in, tap_out)[-1])


def _training(source: DataFrame, target: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    if not source.join(target.select("id"), "id", "left_anti").isEmpty():
        raise DataError("some ids have no target")
    rows = source.select("id", "pos", F.col("point").alias("x")).join(target.select("id", F.col("point").alias("y")), "id").orderBy("pos").limit(MOST + 1).collect()
    if not rows:
        raise DataError("the data set is empty")
    if len(rows) > MOST:
        raise DataError(f"more than {MOST} points")
    return np.array([r["x"] for r in rows], float), np.array([r["y"] for r in rows], float)


@dataclass
class MLPRegressor:
    model: MLP = field(default_factory=MLP)
    error: float = 0.0

    def fit(self, source: DataFrame, target: DataFrame) -> MLPRegressor:
        x, y = _training(source, target)
        model = self.model if self.model.weights else self.model.start(x.shape[1], y.shape[1])
        return MLPRegressor(model, model.train(x, y))

    def predict(self, ds: DataFrame, tap_in: int = 0, tap_out: int = -1) -> DataFrame:
        return self.model.transform(ds, tap_in, tap_out)


@dataclass
class MLPClassifier:
    model: MLP = field(default_factory=lambda: MLP(output="sigmoid", momentum=0.5))
    encoder: LabelEncoder | None = None
    error: float = 0.0

    def fit(self, source: DataFrame, labels: DataFrame) -> MLPClassifier:
        encoder = LabelEncoder.fit(labels)
        x, y = _training(source, encoder.one_hot(labels))
        model = self.model.start(x.shape[1], y.shape[1])
        return MLPClassifier(model, encoder, model.train(x, y))

    def predict(self, ds: DataFrame) -> DataFrame:
        return self.encoder.decode(self.model.transform(ds))
