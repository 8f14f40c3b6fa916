"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers floor(256 * c); every distinct vector counts once.  The centred rows are
the matrix X.  A step forms u = Xv less the last u, then Xᵀu less the last v, each made orthogonal to
all earlier ones (twice).  Spark holds the rows, in blocks, and each step is a pass over them; a left
vector lies in the span of the rows and so goes to the tasks as its d coefficients, from which every
task forms its own part of all left vectors anew.  What the driver holds are d x d numbers at most.
The small bidiagonal matrix's SVD gives components and deviations; steps end when the leading ones no
longer move, or at d.

Rows whose vector is null, or holds a null or non-finite entry, are dropped, and so are vectors of
another length than the commonest one (of equally common ones the longest) and empty ones.  Components
without variance (fewer distinct vectors than components, or constant ones) have a null `whitened` and
`explained` 0.  A single distinct vector gives n = 1 and deviations of 0.  No row left: no row.
Repeated rows and ids stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Numbers in a block of rows.
BLOCK = 1 << 18
#: A component has come to rest when its residual is below this share of the largest singular value.
REST = 1e-13


class Fit(NamedTuple):
    """What a fit gives: the number of distinct vectors, their sums, and by falling deviation the
    components (rows), each one's share of all variance and standard deviation."""

    n: int
    sums: list[int]
    components: np.ndarray
    explained: np.ndarray
    deviations: np.ndarray
    identity_error: float


def whole_numbers(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Adds x, the vector's whole numbers; rows that cannot be used go."""
    ok = F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * 256).cast("long"))
    return _of_one_length(rows.where(F.coalesce(ok, F.lit(False))).withColumn("x", x))


def _of_one_length(rows: DataFrame) -> DataFrame:
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    found = lengths.first()
    return rows.where(F.size("x") == (found.d if found else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(fit_rows: DataFrame, d: int) -> DataFrame:
    """The vectors packed as (block binary): rows of 64-bit whole numbers, BLOCK of them at a time."""
    most = max(1, BLOCK // d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"))
            for at in range(0, len(x), most):
                yield pa.RecordBatch.from_pydict({"block": pa.array([x[at : at + most].astype("<i8").tobytes()], pa.binary())})

    return materialise(fit_rows.mapInArrow(run, "block binary"), "whitening-blocks")


class _Rows:
    """The centred rows: passes over the blocks, each of which sends a task's sums to the driver."""

    def __init__(self, blocks: DataFrame, d: int):
        self.blocks, self.d = blocks, d
        self.mean = np.zeros(d)

    def _pass(self, part, width: int) -> np.ndarray:
        """The sum over all rows of part(rows), an array of `width` numbers."""
        d, mean = self.d, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, rest = np.zeros(width), np.zeros(width)
            for b in batches:
                for block in b.column("block"):
                    x = np.frombuffer(block.as_buffer(), "<i8").reshape(-1, d) - mean
                    # compensated, as a step's outcome is only as good as its sums
                    y = part(x) - rest
                    new = total + y
                    rest, total = (new - total) - y, new
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(width, dtype=np.int32)), "v": pa.array(total)})

        summed = self.blocks.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(width)
        for r in summed:
            out[r.i] = r.v
        return out

    def both_products(self, w: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """For u = X w: Xᵀu, the products with the earlier left vectors X `left`, and u·u."""
        k = left.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            u = x @ w
            return np.concatenate([x.T @ u, (x @ left).T @ u, [u @ u]])

        out = self._pass(part, self.d + k + 1)
        return out[: self.d], out[self.d : self.d + k], float(out[-1])

    def second_moments(self, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and products of the rows' coordinates on `axes` (columns), not yet divided by n."""
        k = axes.shape[1]
        out = self._pass(lambda x: np.concatenate([(y := x @ axes).sum(axis=0), (y.T @ y).ravel()]), k + k * k)
        return out[:k], out[k:].reshape(k, k)

    def square(self) -> float:
        return float(self._pass(lambda x: np.array([np.einsum("ij,ij->", x, x)]), 1)[0])


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    return v


def bidiagonalise(rows: _Rows, scale: float, leading: int, rest: float = REST) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (rows) and singular values, largest first, of the centred rows.  `scale`
    is the root of the sum of all squares."""
    d = rows.d
    v = np.random.default_rng(13).standard_normal(d)
    right = [v / np.linalg.norm(v)]
    left = np.empty((d, 0))  # coefficients of the left vectors
    back: list[np.ndarray] = []  # Xᵀu of each
    alpha: list[float] = []
    beta: list[float] = []
    while True:
        w = right[-1] - (beta[-1] * left[:, -1] if alpha else 0)
        for _ in range(2):  # orthogonal to all left vectors; again where that takes much away
            y, products, square = rows.both_products(w, left)
            w = w - left @ products
            if not len(products) or np.abs(products).max() <= 1e-8 * np.sqrt(max(square, 0.0)):
                break
        # a small share of earlier vectors goes from Xᵀu and u·u by their own, without a further pass
        if len(products):
            y, square = y - np.array(back).T @ products, square - float(products @ products)
        a = np.sqrt(max(square, 0.0))
        if a <= 1e-14 * scale:  # the rows are of a lower rank
            beta = beta[: len(alpha)]
            break
        left, back = np.column_stack([left, w / a]), [*back, y / a]
        alpha.append(a)
        new = _orthogonal(back[-1] - a * right[-1], right)
        b = float(np.linalg.norm(new))
        if len(right) == d or b <= 1e-14 * scale:
            break
        small = np.diag(alpha) + np.diag(beta, 1)
        p, values, _ = np.linalg.svd(small)
        if len(alpha) > leading and (b * np.abs(p[-1, :leading]) <= rest * values[0]).all():
            break
        beta.append(b)
        right.append(new / b)
    k = len(alpha)
    if not k:
        return np.empty((0, d)), np.empty(0)
    # where the last left vector vanished, its right one still takes part: the matrix has k x (k + 1)
    wide = np.zeros((k, len(right)))
    wide[np.arange(k), np.arange(k)] = alpha
    for i, b in enumerate(beta[: min(k, len(right) - 1)]):
        wide[i, i + 1] = b
    _, values, turned = np.linalg.svd(wide, full_matrices=False)
    return turned @ np.array(right), values


def fit(rows: DataFrame, leading: int = 4) -> Fit | None:
    """Components of rows with x (of `whole_numbers`); None where there are no rows."""
    distinct = materialise(rows.select("x").distinct(), "whitening-rows")
    one = distinct.select(F.size("x").alias("d")).first()
    if one is None:
        return None
    d = one.d
    sums = distinct.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    n = sums[0].n
    s = [0] * d
    for r in sums:
        s[r.i] = int(r.s)
    x = _Rows(_blocks(distinct, d), d)
    x.mean = np.array([v / n for v in s])
    square = x.square()
    components, values = bidiagonalise(x, np.sqrt(square), leading) if square > 0 else (np.empty((0, d)), np.empty(0))
    keep = min(leading, int((values > 1e-12 * (values[0] if len(values) else 1)).sum()))
    components, deviations = components[:keep], values[:keep] / np.sqrt(n)
    error = 0.0
    if keep:
        mean, products = x.second_moments(components.T / deviations)
        error = float(np.abs(products / n - np.outer(mean / n, mean / n) - np.eye(keep)).max())
    return Fit(n, s, components, values[:keep] ** 2 / square if keep else np.empty(0), deviations, error)


def whiten(rows: DataFrame, fitted: Fit, leading: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each row of
    (vec_id, x) and component up to `leading`, or up to the vectors' length if that is less."""
    n, sums, components, explained, deviations, error = fitted
    axes = components.T / deviations if len(components) else np.empty((len(sums), 0))
    most, mean = min(leading, len(sums)), np.array([s / n for s in sums])
    squares = sum(s * s for s in sums)
    exact = np.array(sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"))
            for at in range(0, len(x), max(1, BLOCK // len(sums))):
                part = x[at : at + max(1, BLOCK // len(sums))]
                # sum((n x - S)^2), in numbers without a bound
                own = part.astype(object)
                far = n * n * (own * own).sum(axis=1) - 2 * n * (own @ exact) + squares
                shown = (part - mean) @ axes
                column = np.full((len(part), most), np.nan)
                column[:, : shown.shape[1]] = shown
                share = np.zeros(most)
                share[: len(explained)] = explained
                flat = column.ravel()
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pc.take(b.column("vec_id"), pa.array(np.repeat(np.arange(at, at + len(part)), most))),
                    "component": pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), len(part))),
                    "n": pa.array(np.full(len(flat), n, np.int64)),
                    "deviation": pa.array(np.repeat(far, most).tolist(), pa.int64()),
                    "whitened": pa.array(flat, mask=np.isnan(flat)),
                    "explained": pa.array(np.tile(share, len(part))),
                    "identity_error": pa.array(np.full(len(flat), error)),
                })

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whitened(embeddings: DataFrame, leading: int = 4) -> DataFrame:
    """Fit on the distinct vectors of (vec_id, embedding) and whiten every row that can be used."""
    rows = whole_numbers(embeddings.select("vec_id", "embedding"))
    fitted = fit(rows, leading)
    if fitted is None:
        fitted = Fit(1, [0], np.empty((0, 1)), np.empty(0), np.empty(0), 0.0)
    return whiten(rows, fitted, leading)
