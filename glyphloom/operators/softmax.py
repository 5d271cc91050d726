"""Multinomial logistic regression on staged sparse rows: L-BFGS, one Spark job for each pass.

``pyspark.ml``'s solver works on columns divided by their standard deviations.  Under a
penalty on the undivided weights, rare terms then get curvatures thousands of times those of
frequent ones, and a fit takes hundreds of iterations.  Here the steps are scaled by the
objective's own diagonal, penalty included, so a few dozen passes do; the objective is the same.

Rows stay in the tasks, packed to blocks of some ``ENTRIES`` numbers whose work fits a core's cache.
A task adds its blocks' share of the gradient into one vector as long as the model; the vectors
meet slot by slot in a group, and the driver gets one sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from glyphloom.session import stage

#: numbers of a sum that travel together, and entries of rows worked on together
SLOT, ENTRIES = 1 << 14, 1 << 16
#: curvature of the loss along a margin that the first steps are scaled by
CURVATURE = 0.01
#: iterations before which the diagonal of the objective is found anew, and its least share of a column's squares
RESCALED, LEAST = (6, 16, 40, 100), 1e-3
#: steps remembered by L-BFGS, iterations over which the loss must have fallen, tries of a step
MEMORY, WINDOW, TRIES = 30, 10, 25
#: rows packed by ``block``, and how they are staged: files that are read in small parts
BLOCK = "label int, labels binary, starts binary, scales binary, columns binary, values binary"
STAGED = {"parquet.block.size": str(16 << 20), "parquet.enable.dictionary": "false"}
#: by bytes a number: how columns and values are kept
NUMBERS = {1: np.uint8, 2: np.uint16, 4: np.int32, 8: np.float64}


def sparse_pieces(indices: pa.Array, values: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """``rows, columns, values, starts`` of list columns, some ``ENTRIES`` at a time."""
    ends = indices.offsets.to_numpy().astype(np.int64)
    columns = indices.values.to_numpy()
    entries = values.values.to_numpy()[int(values.offsets[0].as_py()):]
    row = 0
    while row < len(indices):
        last = int(np.searchsorted(ends, ends[row] + ENTRIES, side="right")) - 1
        last = min(max(last, row + 1), len(indices))
        low, high = ends[row], ends[last]
        yield slice(row, last), columns[low:high], entries[low - ends[0]:high - ends[0]], ends[row:last + 1] - low
        row = last


def _narrow(numbers: np.ndarray) -> bytes:
    """Counts and columns in as few bytes as hold the largest; others as they are."""
    if numbers.dtype.kind == "f":
        return numbers.astype(np.float64).tobytes()
    most = int(numbers.max()) if len(numbers) else 0
    return numbers.astype(NUMBERS[1 if most < 1 << 8 else 2 if most < 1 << 16 else 4]).tobytes()


def _wide(numbers: pa.Scalar, size: int, kind: type) -> np.ndarray:
    """``size`` numbers of ``_narrow`` as ``kind``."""
    kept = numbers.as_buffer()
    return np.frombuffer(kept, NUMBERS[len(kept) // size] if size else np.uint8).astype(kind)


def blocks(labels: np.ndarray, scales: np.ndarray, columns: np.ndarray, values: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Rows of ``values * scale`` in rows of ``BLOCK``, some ``ENTRIES`` numbers in each, one row at least.

    ``starts`` has one more number than there are rows; ``label`` is the greatest of a block.
    """
    out, row = [], 0
    while row < len(labels):
        last = max(row + 1, int(np.searchsorted(starts, starts[row] + ENTRIES, side="right")) - 1)
        last = min(last, len(labels), row + ENTRIES)
        low, high = starts[row], starts[last]
        out.append({
            "label": int(labels[row:last].max()), "labels": labels[row:last].astype(np.int32).tobytes(),
            "starts": (starts[row:last + 1] - low).astype(np.int32).tobytes(),
            "scales": scales[row:last].astype(np.float64).tobytes(),
            "columns": _narrow(columns[low:high]), "values": _narrow(values[low:high])})
        row = last
    schema = [("label", pa.int32()), *[(n, pa.binary()) for n in ("labels", "starts", "scales", "columns", "values")]]
    return pa.RecordBatch.from_pylist(out, pa.schema(schema))


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """``labels, scales, (columns, values, starts)`` of each block."""
    for labels, starts, scales, columns, values in zip(
            *[batch.column(n) for n in ("labels", "starts", "scales", "columns", "values")]):
        starts = np.frombuffer(starts.as_buffer(), np.int32)
        size = int(starts[-1])
        yield (np.frombuffer(labels.as_buffer(), np.int32), np.frombuffer(scales.as_buffer(), np.float64),
               (_wide(columns, size, np.intp), _wide(values, size, np.float64), starts))


def margins(weights: np.ndarray, intercepts: np.ndarray, columns, values, starts, scales=1.0) -> np.ndarray:
    """Rows by classes; a row without entries has the intercepts."""
    out = np.zeros((len(intercepts), len(starts) - 1))
    filled = starts[1:] > starts[:-1]
    if filled.any():
        first = starts[:-1][filled]
        for k, w in enumerate(weights):
            terms = w[columns]
            terms *= values
            out[k, filled] = np.add.reduceat(terms, first)
    return (out * scales).T + intercepts


def spread(sums: np.ndarray, shares: np.ndarray, columns, values, starts) -> None:
    """Add each row's ``shares`` (by class) of its values to ``sums`` (classes by columns)."""
    sizes = np.diff(starts)
    for total, share in zip(sums, np.ascontiguousarray(shares.T)):
        terms = np.repeat(share, sizes)
        terms *= values
        np.add.at(total, columns, terms)


def likelihoods(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes' shares of each row from its margins, and the logarithm of their sum."""
    top = m.max(axis=1, keepdims=True)
    p = np.exp(m - top)
    whole = p.sum(axis=1, keepdims=True)
    return p / whole, (np.log(whole) + top)[:, 0]


def added(rows: DataFrame, width: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """What ``add(batch, total)`` adds up to over all ``rows``, in ``width`` numbers."""

    def part(batches):
        total, task = np.zeros(width), TaskContext.get().partitionId()
        for batch in batches:
            add(batch, total)
        slots = range(0, width, SLOT)
        yield pa.RecordBatch.from_arrays([
            pa.array([s // SLOT for s in slots], pa.int32()), pa.array([task] * len(slots), pa.int32()),
            pa.array([total[s:s + SLOT].tobytes() for s in slots], pa.binary())], names=["slot", "task", "sums"])

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")  # one order of addition, so that reruns agree
        total = sum(np.frombuffer(s.as_buffer()) for s in table.column("sums"))
        return pa.table({"slot": table.column("slot").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    found = (rows.mapInArrow(part, "slot int, task int, sums binary").groupBy("slot")
             .applyInArrow(summed, "slot int, sums binary").collect())
    total = np.zeros(width)
    for r in found:
        share = np.frombuffer(r["sums"])
        total[r["slot"] * SLOT:r["slot"] * SLOT + len(share)] = share
    return total


def _squares(packed: DataFrame, features: int) -> tuple[int, np.ndarray]:
    """Number of rows, and the sum of squares of each column."""

    def add(batch, total):
        for labels, scales, (columns, values, starts) in _unpacked(batch):
            total[-1] += len(labels)
            spread(total[None, :-1], (scales * scales)[:, None], columns, values * values, starts)

    sums = added(packed, features + 1, add)
    return int(sums[-1]), sums[:-1]


def _loss(packed: DataFrame, point: np.ndarray, bent: bool = False) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of cross-entropies at ``point`` (classes by features, then the intercept), its gradient, and with ``bent`` the
    diagonal of its second derivative."""
    sent = packed.sparkSession.sparkContext.broadcast(point)
    classes, width = point.shape

    def add(batch, total):
        weights, intercepts = sent.value[:, :-1], sent.value[:, -1]
        sums = total[:-1].reshape(-1, classes, width)
        for labels, scales, (columns, values, starts) in _unpacked(batch):
            m = margins(weights, intercepts, columns, values, starts, scales)
            p, whole = likelihoods(m)
            own = np.arange(len(m)), labels
            total[-1] += (whole - m[own]).sum()
            if bent:
                bend = p * (1 - p)
                spread(sums[1, :, :-1], bend * (scales * scales)[:, None], columns, values * values, starts)
                sums[1, :, -1] += bend.sum(axis=0)
            p[own] -= 1
            spread(sums[0, :, :-1], p * scales[:, None], columns, values, starts)
            sums[0, :, -1] += p.sum(axis=0)

    found = added(packed, point.size * (1 + bent) + 1, add)
    sent.destroy()
    sums = found[:-1].reshape(-1, classes, width)
    return float(found[-1]), sums[0], sums[-1]


def _direction(gradient: np.ndarray, inverse: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """The two loops of L-BFGS around the ``inverse`` of a diagonal."""
    q, shares = gradient.copy(), []
    for s, y, r in reversed(steps):
        shares.append(r * np.vdot(s, q))
        q -= shares[-1] * y
    if steps:
        s, y, r = steps[-1]
        q *= inverse / (r * np.vdot(y, inverse * y))
    else:
        q *= inverse / np.sqrt(np.vdot(q, inverse * q))
    for (s, y, r), share in zip(steps, reversed(shares)):
        q += s * (share - r * np.vdot(y, q))
    return -q


def fit_softmax(
    rows: DataFrame, features: int, classes: int, c: float, max_iter: int, tol: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes by features) and intercepts, which carry no penalty.

    ``rows``: ``label int, indices array<int>, values array<double>``, without nulls; they are packed
    and staged for ``fit_blocks``.
    """
    def packed(batches):
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for part, *piece in sparse_pieces(batch.column("indices"), batch.column("values")):
                yield blocks(labels[part], np.ones(part.stop - part.start), *piece)

    return fit_blocks(stage(rows.select("label", "indices", "values").mapInArrow(packed, BLOCK), **STAGED),
                      features, classes, c, max_iter, tol)


def fit_blocks(
    packed: DataFrame, features: int, classes: int, c: float, max_iter: int, tol: float,
    factors: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """``fit_softmax`` on staged rows of ``BLOCK``, which every pass reads again.

    With ``factors`` the features are the columns times these, and only the model is multiplied.  The objective is the mean cross-entropy and ``|weights|^2 / (2 c n)``.  The solver stops
    after ``max_iter`` iterations, or when ten have lowered the objective by at most ``tol`` of its first
    value, or when the gradient's norm is at most ``tol`` times the objective.
    """
    n, squares = _squares(packed, features)
    if not n:
        raise ValueError("no rows to fit on")
    penalty = np.append(np.full(features, 1.0 / (c * n)), 0.0)
    factors = np.append(np.ones(features) if factors is None else factors, 1.0)
    squares = np.append(squares / n, 1.0) * factors ** 2
    inverse = np.broadcast_to(1 / (squares * CURVATURE + penalty), (classes, features + 1))

    def objective(point):
        loss, gradient, _ = _loss(packed, point * factors)
        return loss / n + (penalty * point * point).sum() / 2, gradient * factors / n + penalty * point

    point = np.zeros((classes, features + 1))
    value, slope = objective(point)
    values, steps = [value], []
    for iteration in range(max_iter):
        if np.linalg.norm(slope) <= max(tol * value, 1e-12):
            break
        if iteration in RESCALED:
            bend = _loss(packed, point * factors, bent=True)[-1] * factors ** 2 / n
            inverse = 1 / (np.maximum(bend, LEAST * squares) + penalty)
        way = _direction(slope, inverse, steps)
        descent = np.vdot(slope, way)
        length, low, high = 1.0, 0.0, None
        for _ in range(TRIES):  # the Wolfe conditions, by bisection
            there = point + length * way
            lower, turned = objective(there)
            if lower > value + 1e-4 * length * descent:
                high = length
            elif np.vdot(turned, way) < 0.9 * descent:
                low = length
            else:
                break
            length = (low + high) / 2 if high else 2 * length
        else:
            break  # no better point within the precision of the sums
        step, bend = length * way, turned - slope
        steps = [*steps, (step, bend, 1 / np.vdot(step, bend))][-MEMORY:]
        point, value, slope = there, lower, turned
        values.append(value)
        if len(values) > WINDOW and values[-1 - WINDOW] - value <= tol * values[0]:
            break
    point -= point.mean(axis=0)  # the same for all classes: no likelihood, and the least penalty
    return point[:, :-1], point[:, -1]
