"""Embedding whitening by polarisation covariance.

Entries are read as whole numbers, x = floor(scale * c) + offset, so that all sums are exact.
The model is fitted on the different x vectors, each once. Tasks sum the squares of every
dimension and of every sum of two dimensions, centred before squaring: the whole number below
the mean is taken off, and the rest of the mean, less than 1, is taken off the sums exactly.
The variance of a sum of two dimensions is both variances and twice the covariance, so the
differences of these variances give all covariances as exact fractions. They make a matrix of
dimensions x dimensions on the driver, and eigh turns it into components.

A vector travels as bytes: its entries less the offset, in the narrowest of 1, 2, 4 or 8 bytes
that hold them all. Equal x vectors have equal bytes, and task-side aggregation makes copies of
one vector one row per task before the shuffle. Tasks hold one batch and the sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import written

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
# entries beyond this are read as this, so that the sums of squares of 10^13 vectors have 38 digits at most
MOST = 1 << 40
WIDTHS = (1, 2, 4, 8)
# components whose share of the largest variance is not above rounding have no direction
RANK_SHARE = 1e-13
# rows worked on at a time
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """A fitted model: exact count and sums, and the components as columns of unit vectors."""

    dims: int
    n: int
    sums: tuple[int, ...]
    widest: int
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float

    def base(self) -> np.ndarray:
        """The whole numbers below the means."""
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    def rest(self) -> list[int]:
        """n times what the means exceed their base by."""
        return [s % self.n for s in self.sums]

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened rows of y = x - base; a component without variance gives nan."""
        centred = y - np.array([r / self.n for r in self.rest()])
        has = self.variances > 0
        out = np.full((len(y), len(has)), np.nan)
        out[:, has] = (centred @ self.components)[:, has] / np.sqrt(self.variances[has])
        return out

    def deviation(self, y: np.ndarray) -> list[int | None]:
        """Per row the sum over dimensions of (n * x - sum)^2; None if a long can't hold it."""
        rest, n = self.rest(), self.n
        if self.dims * (n * (self.widest + 1)) ** 2 < 1 << 63:
            d = y * n - np.array(rest, dtype=np.int64)
            return (d * d).sum(axis=1).tolist()
        about = ((y - np.array([r / n for r in rest])) ** 2).sum(axis=1) * float(n) ** 2
        exact = lambda row: sum((n * int(v) - r) ** 2 for v, r in zip(row, rest))
        found = [exact(row) if near < 2.0**64 else None for row, near in zip(y, about)]
        return [v if v is not None and v < 1 << 63 else None for v in found]


def whole_numbers(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(floor(scale * c) of all entries of usable vectors, their lengths, which vectors are usable).

    Usable: not null, and every entry a finite number.
    """
    flat = vectors.flatten()
    entries = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    fine = (bad[ends] == bad[ends - lengths]) & vectors.is_valid().to_numpy(zero_copy_only=False)
    kept = entries[np.repeat(fine, lengths)]
    with np.errstate(over="ignore"):
        return np.clip(np.floor(kept * scale), -MOST, MOST).astype(np.int64), lengths[fine], fine


def packed(numbers: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Each vector as one byte for the width and its entries in that width."""
    out, at = [], 0
    for n in lengths:
        row = numbers[at : at + n]
        at += n
        low, high = (int(row.min()), int(row.max())) if n else (0, 0)
        width = next(w for w in WIDTHS if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
        out.append(bytes([width]) + row.astype(f"<i{width}").tobytes())
    return out


def unpacked(keys: list[bytes], dims: int) -> np.ndarray:
    """The vectors as rows; all have the same number of entries."""
    out = np.empty((len(keys), dims), dtype=np.int64)
    for width in {k[0] for k in keys}:
        at = [i for i, k in enumerate(keys) if k[0] == width]
        out[at] = np.frombuffer(b"".join(keys[i][1:] for i in at), dtype=f"<i{width}").reshape(len(at), dims)
    return out


def _pack(scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, lengths, _ = whole_numbers(batch.column(0), scale)
            yield pa.RecordBatch.from_pydict({"key": pa.array(packed(numbers, lengths), pa.binary()), "dims": pa.array(lengths, pa.int64())})

    return run


def _rows(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield unpacked(batch.column("key").slice(at, ROWS).to_pylist(), dims)


def _sums(dims: int) -> Callable:
    """Per task and dimension: sum, least and largest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high = [0] * dims, np.full(dims, 1 << 62), np.full(dims, -(1 << 62))
        for x in _rows(batches, dims):
            # 2^12 rows of entries up to 2^40
            total = [t + int(a) for t, a in zip(total, x.sum(axis=0))]
            low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if low[0] <= high[0]:
            yield pa.RecordBatch.from_pydict({
                "slot": pa.array(range(dims), pa.int32()), "total": pa.array([str(t) for t in total]),
                "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})

    return run


def polarised(y: np.ndarray, most: int) -> list[int]:
    """Exact sums of squares of centred y: of every dimension i, then of every i + j, j > i, by i.

    most bounds the entries; where 64 bits can't hold the sums, whole numbers of any size do.
    """
    if len(y) * (2 * most) ** 2 >= 1 << 63:
        y = y.astype(object)
    square = lambda a: [int(v) for v in (a * a).sum(axis=0)]
    out = square(y)
    for i in range(y.shape[1] - 1):
        out += square(y[:, i + 1 :] + y[:, i : i + 1])
    return out


def _squares(dims: int, base: np.ndarray, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _rows(batches, dims):
            own = polarised(x - base, most)
            total = own if total is None else [a + b for a, b in zip(total, own)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"slot": pa.array(range(len(total)), pa.int32()), "total": pa.array([str(t) for t in total])})

    return run


def _summed(partial: DataFrame) -> dict[int, int]:
    """The sums of all tasks by slot; 38 digits hold them."""
    rows = partial.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    return {r["slot"]: int(r["total"]) for r in rows}


def covariances(squares: list[int], rest: list[int], n: int) -> np.ndarray:
    """The covariance matrix, divisor n, from the polarised sums; every entry rounded once.

    squares are about the base; rest is n times what the mean exceeds the base by.
    """
    d = len(rest)
    out = np.zeros((d, d))
    # n^2 times the variances of the single dimensions, exactly
    own = [n * squares[i] - rest[i] ** 2 for i in range(d)]
    slot = d
    for i in range(d):
        out[i, i] = float(Fraction(own[i], n * n))
        for j in range(i + 1, d):
            both = n * squares[slot] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = float(Fraction(both - own[i] - own[j], 2 * n * n))
            slot += 1
    return out


def _moments(model: Whitening) -> Callable:
    """Per task: sums of whitened entries and of their products; two slots for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, has = model.base(), model.variances > 0
        k = int(has.sum())
        first, second, any_row = np.zeros(k), np.zeros((k, k)), False
        for x in _rows(batches, model.dims):
            w = model.project(x - base)[:, has]
            first, second, any_row = first + w.sum(axis=0), second + w.T @ w, True
        if any_row:
            values = np.concatenate([first, second.ravel()])
            yield pa.RecordBatch.from_pydict({"slot": pa.array(range(len(values)), pa.int32()), "total": pa.array(values)})

    return run


def _identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    k = int((model.variances > 0).sum())
    if not k:
        return 0.0
    partial = fit_list.select("key").mapInArrow(_moments(model), "slot int, total double")
    found = {r["slot"]: r["total"] for r in partial.groupBy("slot").agg(F.sum("total").alias("total")).collect()}
    mean = np.array([found[i] for i in range(k)]) / model.n
    second = np.array([found[k + i] for i in range(k * k)]).reshape(k, k) / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit eigenvectors as columns, eigenvalues falling, shares of the trace) of the first `most`.

    The largest entry of a vector is positive. Eigenvalues that are only rounding are 0.
    """
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])] < 0, -1.0, 1.0)
    values = np.where(values > RANK_SHARE * max(values[0], 0.0), values, 0.0)
    trace = float(np.trace(cov))
    return vectors, values, values / trace if trace > 0 else np.zeros(len(values))


def fit(df: DataFrame, vector: str, most: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """Fit on the different vectors of the table; None if no vector can be used.

    Null vectors and vectors with null or non-finite entries are left out, and so are vectors
    of another length than most different vectors have (of equally frequent lengths the longer
    counts) and empty ones. The offset of x changes no covariance and is not added here.
    """
    keys = df.select(F.col(f"`{vector}`").alias("vector")).mapInArrow(_pack(scale), "key binary, dims long")
    different = written(keys.groupBy("key").agg(F.first("dims").alias("dims")), "vectors")
    lengths = different.where("dims > 0").groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None:
        return None
    dims, n = lengths["dims"], lengths["n"]
    fit_list = different.where(F.col("dims") == dims)
    partial = fit_list.select("key").mapInArrow(_sums(dims), "slot int, total string, low long, high long")
    found = {r["slot"]: r for r in partial.groupBy("slot").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    sums = tuple(int(found[i]["total"]) for i in range(dims))
    base = [s // n for s in sums]
    widest = max(max(found[i]["high"] - base[i], base[i] - found[i]["low"]) for i in range(dims))
    squares = _summed(fit_list.select("key").mapInArrow(_squares(dims, np.array(base, dtype=np.int64), widest), "slot int, total string"))
    cov = covariances([squares[i] for i in range(len(squares))], [s % n for s in sums], n)
    vectors, values, shares = components(cov, most)
    model = Whitening(dims, n, sums, widest, vectors, values, shares, 0.0)
    return Whitening(dims, n, sums, widest, vectors, values, shares, _identity_error(fit_list, model))


def _apply(model: Whitening, scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = model.base()
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(at, ROWS)
                numbers, lengths, fine = whole_numbers(batch.column("vector"), scale)
                fits = lengths == model.dims
                rows = np.flatnonzero(fine)[fits]
                y = numbers[np.repeat(fits, lengths)].reshape(len(rows), model.dims) - base
                w = model.project(y)
                flat = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()))
                offsets = pa.array(np.arange(len(rows) + 1) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(rows)), pa.array(model.deviation(y), pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                    names=["row", "deviation", "whitened"])

    return run


def transform(df: DataFrame, vector: str, model: Whitening | None, scale: int = SCALE) -> DataFrame:
    """df as the struct `row` with deviation and whitened of every vector that the model takes.

    deviation is the sum over dimensions of (n * x - sum)^2, exact, and null if a long can't
    hold it. Scaled entries beyond 2^40 are read as 2^40. whitened has one entry for each component, null for one without variance.
    Vectors that `fit` leaves out are left out here. Repeated rows stay; an empty table or one
    without usable vectors gives no rows. Names of other columns don't matter.
    """
    kind = df.schema.simpleString()
    schema = f"row {kind}, deviation long, whitened array<double>"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{vector}`").alias("vector"))
    return rows.mapInArrow(_apply(model, scale), schema)


def whiten(df: DataFrame, vector: str = "embedding", most: int = COMPONENTS, scale: int = SCALE) -> tuple[DataFrame, Whitening | None]:
    """(`transform` of the table, the model fitted on it)."""
    model = fit(df, vector, most, scale)
    return transform(df, vector, model, scale), model
