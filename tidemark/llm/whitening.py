"""Embedding whitening from an exact integer scatter matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.scratch import cut

#: An entry c becomes the integer floor(SCALE * c) + OFFSET; the scatter is taken of it less the shift, which is OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Integers are cut into signed limbs of so many bits, so that sums of ROWS products of two are exact in doubles.
LIMB, ROWS = 20, 1 << 13
#: Greatest absolute value of floor(SCALE * c); entries beyond count as it, so that all are 64-bit integers.
MOST = 1 << 62
#: Partial scatters meet in so many tasks; each row of the matrix goes to one of them.
MERGERS = 32


@dataclass(frozen=True)
class Whitening:
    """n vectors with exact sums (of entries less the shift), eigenvalues in falling order, eigenvectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vector) of rows whose vector is there and has only finite entries."""
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return rows.where(F.col("vector").isNotNull() & ~F.exists("vector", odd))


def _integers(column: pa.ListArray, size: int) -> np.ndarray:
    """floor(SCALE * c), that is x less the shift, as an int64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return np.clip(np.floor(np.clip(flat, -MOST, MOST) * SCALE), -MOST, MOST).astype(np.int64)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as sum of limb[k] << (LIMB * k), each below 2**LIMB in size, as doubles."""
    out = []
    while len(x) and np.abs(x).max() >= 1 << LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def _partial(size: int):
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's count, sums and cross-products in arbitrary precision, a row for each row of the matrix."""
        n, sums, cross = 0, np.zeros(size, dtype=object), np.zeros((size, size), dtype=object)
        for batch in batches:
            whole = _integers(batch.column(1), size)
            for at in range(0, len(whole), ROWS):
                x = whole[at : at + ROWS]
                limbs = _limbs(x)
                n += len(x)
                for a, left in enumerate(limbs):
                    sums += left.sum(axis=0).astype(np.int64).astype(object) << (LIMB * a)
                    for b, right in enumerate(limbs):
                        cross += (left.T @ right).astype(np.int64).astype(object) << (LIMB * (a + b))
        if n:
            rows = [[str(n), *map(str, sums)], *([str(v) for v in cross[i, i:]] for i in range(size))]
            yield pa.RecordBatch.from_pydict({"line": pa.array(range(size + 1), pa.int32()), "numbers": pa.array(rows, pa.list_(pa.string()))})

    return partial


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the lists of each line, in arbitrary precision."""
    total: dict[int, list[int]] = {}
    for batch in batches:
        for line, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = list(map(int, numbers))
            total[line] = [a + b for a, b in zip(total[line], own, strict=True)] if line in total else own
    if total:
        yield pa.RecordBatch.from_pydict({"line": pa.array(list(total), pa.int32()), "numbers": pa.array([list(map(str, x)) for x in total.values()], pa.list_(pa.string()))})


def fit(vectors: DataFrame, size: int) -> Whitening | None:
    """The whitening of (vec_id, vector) rows, all of one size; None without rows.

    Each task sums its vectors, less the shift, and their products as integers of any size; a few tasks add those up line
    by line, and the driver gets size + 1 lines, whatever the number of rows. There n XᵀX - SSᵀ is formed exactly, and
    only then divided by n² to doubles, each rounded once, and decomposed. The shift cancels. Eigenvectors have their
    largest entry positive.
    """
    schema = "line int, numbers array<string>"
    lines = vectors.mapInArrow(_partial(size), schema).repartition(MERGERS, "line").mapInArrow(_merged, schema).collect()
    if not lines:
        return None
    lines = {r["line"]: list(map(int, r["numbers"])) for r in lines}
    n, *sums = lines[0]
    scatter = np.empty((size, size), dtype=object)
    for i in range(size):
        for j in range(i, size):
            scatter[i, j] = scatter[j, i] = n * lines[i + 1][j - i] - sums[i] * sums[j]
    values, columns = np.linalg.eigh((scatter / (n * n)).astype(np.float64))
    values, columns = values[::-1], columns[:, ::-1]
    largest = columns[np.abs(columns).argmax(axis=0), np.arange(size)]
    trace = sum(scatter[i, i] for i in range(size)) / (n * n)
    return Whitening(n, sums, values, columns * np.where(largest < 0, -1.0, 1.0), trace)


def _whitened(net: Whitening, components: int, size: int):
    values = net.values[:components]
    live = values > size * np.finfo(float).eps * max(net.values[0], 0.0)
    project = net.vectors[:, :components][:, live] / np.sqrt(values[live])
    sums = np.array(net.sums, dtype=object)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred = net.n * _integers(batch.column(1), size).astype(object) - sums
            out = np.full((len(centred), len(values)), np.nan)
            out[:, live] = (centred / net.n).astype(np.float64).reshape(-1, size) @ project
            exact = [Decimal(int(v)) if abs(v) < 10**38 else None for v in (centred * centred).sum(axis=1)]
            lists = [[None if np.isnan(v) else v for v in row] for row in out.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(exact, pa.decimal128(38, 0)), pa.array(lists, pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"]
            )

    return whitened


def _identity_error(table: DataFrame, n: int, live: list[int]) -> float | None:
    """Largest absolute entry of the covariance of the whitened numbers, less the identity; they are centred first."""
    if not live:
        return None
    means = table.agg(*[F.avg(F.col("whitened")[k]).alias(f"m{k}") for k in live]).first()
    centred = {k: F.col("whitened")[k] - F.lit(float(means[f"m{k}"])) for k in live}
    pairs = [(i, j) for i in live for j in live if i <= j]
    sums = table.agg(*[F.sum(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(sums[f"c{i}_{j}"] / n - (i == j)) for i, j in pairs)


SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten_embeddings(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """The first components of every vector, whitened by the exact covariance of all; a row for each vector and component.

    Returns key as vec_id, component (from 1, by falling eigenvalue), n (vectors), deviation (the sum of (n x - S)² over
    the dimensions, exact; null from 10³⁸ on), whitened, explained (the eigenvalue's part of the trace) and
    identity_error (one value: how far the covariance of all whitened numbers is from the identity).

    Left out are vectors that are null, hold null, NaN or infinite entries, or have another length than most vectors (of
    equally frequent lengths the larger one counts). Components are at most the dimensions. A component along which the
    vectors don't vary (one vector only, all alike, or dependent dimensions) has null whitened numbers and isn't part of
    identity_error, which is null where no component varies, as is explained without any variance. Null and repeated keys
    and equal vectors are rows like any other; no rows, or empty vectors, give none. Other columns are not read.
    """
    spark = rows.sparkSession
    vectors = _vectors(rows, key, vector)
    size = vectors.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = size["size"] if size else 0
    vectors = vectors.where(F.size("vector") == size)
    net = fit(vectors, size) if size else None
    if net is None:
        return spark.createDataFrame([], SCHEMA)
    components = min(components, size)
    table = cut(vectors.mapInArrow(_whitened(net, components, size), "vec_id long, deviation decimal(38,0), whitened array<double>"), "whitened")
    floor = size * np.finfo(float).eps * max(net.values[0], 0.0)
    error = _identity_error(table, net.n, [k for k in range(components) if net.values[k] > floor])
    parts = [float(v / net.trace) if net.trace > 0 else None for v in net.values[:components]]
    each = table.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(net.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*[F.lit(p).cast("double") for p in parts])[F.col("at")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
