"""A feed-forward network of large tables, fitted by L-BFGS on gradients that tasks add up.

It is the network of ``pyspark.ml`` (sigmoid layers, softmax at the end, mean cross-entropy,
its first weights and its optimizer's settings). There a pass multiplies matrices in the
JVM, most of a fit's time; here a pass is one job, whose tasks read written blocks of
rows and return one gradient each.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame

from equipoise.operators.ordered import materialize

#: Rows that a matrix product takes at a time.
ROWS_PER_PRODUCT = 1024
#: Rows of a written block.
ROWS_PER_BLOCK = 4096
#: Earlier steps that L-BFGS keeps, and the steps over which its value must have fallen.
MEMORY, VALUES = 10, 20


def layers_of(weights: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(inputs x outputs matrix, offsets) of every layer, views of ``pyspark.ml``'s one vector."""
    out, at = [], 0
    for i, o in zip(sizes, sizes[1:]):
        out.append((weights[at:at + i * o].reshape(i, o), weights[at + i * o:at + i * o + o]))
        at += i * o + o
    return out


def add_gradient(weights: np.ndarray, sizes: list[int], x: np.ndarray, y: np.ndarray, gradient: np.ndarray) -> float:
    """Adds the gradient of the rows' summed loss to ``gradient`` and returns that loss.
    Inside, a row is a column, so that sums over classes run along memory; a product's numbers
    are floats, sums over products doubles."""
    layers, into = layers_of(weights.astype("float32"), sizes), layers_of(gradient, sizes)
    seen = [x.T]
    with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0, as it should be
        for w, b in layers[:-1]:
            z = -w.T @ seen[-1]
            z -= b[:, None]
            np.exp(z, out=z)
            z += 1.0
            seen.append(np.reciprocal(z, out=z))
    z = layers[-1][0].T @ seen[-1]
    z += layers[-1][1][:, None]
    z -= z.max(0)
    delta = np.exp(z)
    s = delta.sum(0)
    at = np.arange(len(y))
    loss = float((np.log(s) - z[y, at]).sum(dtype="float64"))
    delta /= s
    delta[y, at] -= 1.0
    for k in range(len(layers) - 1, -1, -1):
        into[k][0][:] += seen[k] @ delta.T
        into[k][1][:] += delta.sum(1)
        if k:
            delta = layers[k][0] @ delta
            delta *= seen[k]
            delta *= 1.0 - seen[k]
    return loss


def in_blocks(rows: DataFrame, feature_cols: list[str], label: str) -> DataFrame:
    """The rows as blocks ``x`` (floats, row by row) and ``y`` (bytes): a pass over the
    written blocks reads a few large values instead of all columns of every row."""
    width = len(feature_cols)

    def pack(batches):
        import pyarrow as pa
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype("float32") for i in range(width)], axis=1)
            y = b.column(width).to_numpy(zero_copy_only=False)
            if not np.isin(y, (0, 1)).all():
                raise ValueError("Labels must be 0 or 1, without nulls.")
            y = y.astype("int8")
            starts = range(0, len(y), ROWS_PER_BLOCK)
            yield pa.RecordBatch.from_arrays([
                pa.array([x[i:i + ROWS_PER_BLOCK].tobytes() for i in starts], pa.binary()),
                pa.array([y[i:i + ROWS_PER_BLOCK].tobytes() for i in starts], pa.binary())], ["x", "y"])

    return rows.select(*[f"`{c}`" for c in feature_cols], f"`{label}`").mapInArrow(pack, "x binary, y binary")


def mean_loss(blocks: DataFrame, n: int, sizes: list[int]):
    """The function weights -> (mean loss, its gradient) over the ``n`` rows of written blocks."""
    def at(weights):
        def task(batches):
            import pyarrow as pa
            gradient, loss = np.zeros(len(weights)), 0.0
            for b in batches:
                for xs, ys in zip(b.column(0), b.column(1)):
                    y = np.frombuffer(ys.as_buffer(), "int8")
                    x = np.frombuffer(xs.as_buffer(), "float32").reshape(len(y), sizes[0])
                    for i in range(0, len(y), ROWS_PER_PRODUCT):
                        loss += add_gradient(weights, sizes, x[i:i + ROWS_PER_PRODUCT], y[i:i + ROWS_PER_PRODUCT], gradient)
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())], ["loss", "gradient"])

        parts = blocks.mapInArrow(task, "loss double, gradient binary").collect()  # as many numbers a task as weights
        return sum(r["loss"] for r in parts) / n, sum(np.frombuffer(r["gradient"]) for r in parts) / n

    return at


def lbfgs(f, x: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """Minimum of ``f`` (x -> value, gradient) by L-BFGS with a line search for the strong Wolfe
    conditions; ends after ``max_iter`` steps, or when value or gradient hardly change."""
    value, g = f(x)
    steps, values, first = [], [value], abs(value)
    for _ in range(max_iter):
        d, alphas = -g, []
        for s, y, r in reversed(steps):
            alphas.append(r * (s @ d))
            d = d - alphas[-1] * y
        if steps:
            s, y, r = steps[-1]
            d = d / (r * (y @ y))
        for (s, y, r), a in zip(steps, reversed(alphas)):
            d = d + (a - r * (y @ d)) * s
        if not g @ d < 0:
            d, steps = -g, []
        found = wolfe(f, x, value, g, d, 1.0 if steps else 1.0 / max(np.linalg.norm(d), 1e-12))
        if found is None:
            break
        t, value, new = found
        s, y = t * d, new - g
        x, g = x + s, new
        if s @ y > 1e-12 * (y @ y):
            steps = [*steps, (s, y, 1.0 / (s @ y))][-MEMORY:]
        values = [*values, value][-VALUES:]
        if np.linalg.norm(g) <= max(tol * abs(value), 1e-8) or max(values) - value <= tol * first:
            break
    return x


def wolfe(f, x, value, g, d, step: float, c1: float = 1e-4, c2: float = 0.9, tries: int = 20):
    """(step, value, gradient) at a step along ``d``, or None where none lowers the value."""
    slope = g @ d
    low, low_value, low_slope, high, best = 0.0, value, slope, None, None
    for _ in range(tries):
        v, new = f(x + step * d)
        here = new @ d
        falls = np.isfinite(v) and v <= value + c1 * step * slope
        if falls and (best is None or v < best[1]):
            best = step, v, new
        if falls and abs(here) <= -c2 * slope:
            return step, v, new
        if not falls or v >= low_value and low > 0 or here >= 0:
            high = step
        else:
            low, low_value, low_slope = step, v, here
        if high is None:
            step *= 2.0
        else:  # the lowest point of a parabola, kept inside the interval
            width = high - low
            bend = (v - low_value - low_slope * (step - low)) if step != low else 0.0
            guess = low - low_slope * (step - low) ** 2 / (2 * bend) if bend > 0 and np.isfinite(v) else low + width / 2
            step = min(max(guess, low + 0.1 * width), high - 0.1 * width)
    return best


def fitted_network(est: MultilayerPerceptronClassifier, rows: DataFrame, n: int, feature_cols: list[str],
                   label: str) -> MultilayerPerceptronClassificationModel:
    """``est`` fitted on all ``n`` rows, as a model of ``pyspark.ml``."""
    sizes = est.getLayers()
    names = [est.getFeaturesCol(), est.getLabelCol()]
    one = rows.sparkSession.createDataFrame([(Vectors.dense([0.0] * sizes[0]), 0.0)], names)
    start = est.copy({est.maxIter: 0}).fit(one).weights.toArray()  # the first weights of the estimator's seed
    blocks = materialize(in_blocks(rows, feature_cols, label))
    best = lbfgs(mean_loss(blocks, n, sizes), start, est.getMaxIter(), est.getTol())
    return est.copy({est.maxIter: 0, est.initialWeights: Vectors.dense(best)}).fit(one)
