"""Embedding whitening: covariance by tiles of dimension pairs, eigenvectors, whitened components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import release, table

#: Rows of a row block, dimensions of a tile, components returned; bytes of tile sums that a task holds before it hands
#: them on; vectors of one Arrow slice.
ROWS, TILE, COMPONENTS, HELD, SLICE = 4096, 32, 32, 256 << 20, 1024
SCALE, SHIFT, LIMIT = 64, 1_000_000, 1 << 40
#: Eigenvalues of at most this share of the trace are rounding of zero: such components can't be scaled to one.
ZERO = 1e-14


def integers(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """vec_id, x (array of longs: floor(64 * entry) + 1000000) of the rows whose vector holds finite numbers only."""
    e = F.col(f"`{name}`").cast("array<double>")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = F.transform(e, lambda v: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), SCALE * v))).cast("long") + SHIFT)
    return vectors.where(e.isNotNull() & finite).select(F.col("vec_id"), x.alias("x"))


def matrices(batches: Iterator[pa.RecordBatch], dims: int, ids: bool = False) -> Iterator:
    """Arrow batches of x as integer matrices of few rows; a vector that is shorter than dims ends in zeros (x = SHIFT)."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            lists = part["x"]
            lens, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            if (lens == dims).all():
                m = flat.reshape(len(lens), dims)
            else:
                m = np.full((len(lens), dims), SHIFT, np.int64)
                m[np.arange(dims) < lens[:, None]] = flat
            yield (part["vec_id"], m) if ids else m
        del batch
    release()


@dataclass
class Fit:
    """What the fit list says: rows, sums by dimension, components (a row each), eigenvalues, trace, identity error."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    error: float = 0.0

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Of S / n by dimension, the whole part and the remainder of n."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([s - w * self.n for s, w in zip(self.sums, whole, strict=True)], np.int64)


def totals(x: DataFrame) -> tuple[int, list[int]]:
    """Rows, and the exact sum of each dimension; one row a task and dimension is shuffled."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(0, np.int64)
        for batch in batches:
            lens = np.diff(batch["x"].offsets.to_numpy())
            for m in matrices([batch], int(lens.max(initial=0))):
                if m.shape[1] > len(sums):  # what a longer vector adds, the earlier ones lack: they end in zeros
                    sums = np.concatenate([sums, np.full(m.shape[1] - len(sums), n * SHIFT)])
                sums[: m.shape[1]] += m.sum(axis=0)
                sums[m.shape[1] :] += len(m) * SHIFT
                n += len(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(sums)), pa.int64()), pa.array([n, *sums.tolist()], pa.int64()), pa.array([n] * (len(sums) + 1), pa.int64())], names=["dim", "total", "n"])

    parts = x.select("vec_id", "x").mapInArrow(summed, "dim bigint, total bigint, n bigint")
    got = sorted(parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect(), key=lambda r: r.dim)
    n = int(got[0].total or 0) if got else 0
    return n, [int(r.total) + (n - r.n) * SHIFT for r in got[1:]]


def column_blocks(x: DataFrame, fit: Fit) -> DataFrame:
    """block, tile, rows, data: of each block of at most ROWS rows of a task, TILE dimensions less the whole part of their means."""
    dims, (whole, _) = len(fit.sums), fit.centre()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, k, held, rows = TaskContext.get().partitionId() << 32, 0, [], 0

        def blocks() -> pa.RecordBatch:
            m = np.concatenate(held) - whole
            kind = next(t for t in ("<i2", "<i8") if t == "<i8" or np.abs(m).max() < 1 << 15)
            tiles = [np.ascontiguousarray(m[:, c : c + TILE].T.astype(kind)).tobytes() for c in range(0, dims, TILE)]
            return pa.RecordBatch.from_arrays([pa.array([at + k] * len(tiles), pa.int64()), pa.array(range(len(tiles)), pa.int32()), pa.array([len(m)] * len(tiles), pa.int32()), pa.array(tiles, pa.binary())], names=["block", "tile", "rows", "data"])

        for m in matrices(batches, dims):
            held.append(m)
            rows += len(m)
            if rows >= ROWS:
                yield blocks()
                k, held, rows = k + 1, [], 0
        if held:
            yield blocks()

    return x.select("vec_id", "x").mapInArrow(cut, "block bigint, tile int, rows int, data binary")


def tile_sums(blocks: DataFrame, dims: int) -> DataFrame:
    """i, values: row i of the products of all tile pairs (a, b), a <= b, summed over the row blocks of a task.

    The column blocks of a row block come one after another, sorted by tile; each pair of them is multiplied. A product
    of integers below 2**53 is exact in any order. A task holds one row block and at most HELD bytes of sums."""

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        block, columns = None, {}

        def add() -> None:
            for a, left in columns.items():
                for b, right in columns.items():
                    if a <= b:
                        p = left @ right.T
                        sums[a, b] = sums[a, b] + p if (a, b) in sums else p

        def given() -> Iterator[pa.RecordBatch]:
            for (a, b), p in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([a * TILE + i for i in range(len(p))], pa.int32()), pa.array([b * TILE] * len(p), pa.int32()), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["i", "j0", "values"])
            sums.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    add()
                    if len(sums) * TILE * TILE * 8 > HELD:
                        yield from given()
                    block, columns = row["block"], {}
                wide = min(TILE, dims - row["tile"] * TILE)
                kind = "<i2" if len(row["data"]) == 2 * wide * row["rows"] else "<i8"
                columns[row["tile"]] = np.frombuffer(row["data"], kind).reshape(wide, row["rows"]).astype(np.float64)
        add()
        yield from given()
        release()

    return blocks.mapInArrow(multiplied, "i int, j0 int, values array<double>")


def covariance(x: DataFrame, fit: Fit) -> np.ndarray:
    """The covariance matrix of x, dims * dims on the driver, however many rows there are.

    With y = x - floor(S / n) and r = S / n - floor(S / n), it is sum(y y') / n - r r': all rows are centred to within one
    before they are multiplied, and what is left of the means, below one, is taken off exactly."""
    dims, (_, rest) = len(fit.sums), fit.centre()
    blocks = column_blocks(x, fit)
    by_block = blocks.repartition(F.col("block")).sortWithinPartitions("block", "tile")
    parts = tile_sums(by_block, dims).select("i", "j0", F.posexplode("values").alias("at", "v"))
    sums = parts.groupBy("i", (F.col("j0") + F.col("at")).alias("j")).agg(F.sum("v").alias("v")).toArrow()
    v = np.zeros((dims, dims))
    v[sums["i"].to_numpy(), sums["j"].to_numpy()] = sums["v"].to_numpy()
    v = np.triu(v) + np.triu(v, 1).T
    r = rest / fit.n
    return v / fit.n - np.outer(r, r)


def projected(m: np.ndarray, fit: Fit) -> np.ndarray:
    """Whitened components of rows of x."""
    whole, rest = fit.centre()
    return ((m - whole) - rest / fit.n) @ fit.components.T / np.sqrt(fit.values)


def identity_error(x: DataFrame, fit: Fit) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity, by one more pass over the rows."""
    dims, k = len(fit.sums), len(fit.values)

    def squared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k + 1, k)), 0
        for m in matrices(batches, dims):
            w = projected(m, fit)
            sums[:k] += w.T @ w
            sums[k] += w.sum(axis=0)
            n += len(m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["i", "values"])

    parts = x.select("vec_id", "x").mapInArrow(squared, "i int, values array<double>").select("i", F.posexplode("values").alias("j", "v"))
    s = np.zeros((k + 1, k))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        s[r.i, r.j] = r.v
    mean = s[k] / fit.n
    return float(np.abs(s[:k] / fit.n - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def fitted(x: DataFrame, most: int = COMPONENTS) -> Fit | None:
    """The fit over all rows of x; None if no component has a variance."""
    n, sums = totals(x)
    if not n or not sums:
        return None
    fit = Fit(n, sums, np.zeros((0, 0)), np.zeros(0), 0.0)
    v = covariance(x, fit)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    trace = float(np.trace(v))
    order = [k for k in order if values[k] > ZERO * trace]
    if not order:
        return None
    fit.components, fit.values, fit.trace = np.ascontiguousarray(vectors[:, order].T), values[order], trace
    fit.error = identity_error(x, fit)
    return fit


def deviations(m: np.ndarray, fit: Fit) -> list[int | None]:
    """Sums of (n * x - S)**2, exactly; None where a long can't hold one."""
    whole, rest = fit.centre()
    y = m - whole
    most = (float(np.abs(y).max(initial=0)) + 1) * fit.n
    if most * most * m.shape[1] < 2**62:
        d = y * fit.n - rest
        return (d * d).sum(axis=1).tolist()
    near = ((y - rest / fit.n) ** 2).sum(axis=1) * float(fit.n) ** 2
    exact = lambda row: sum((int(v) * fit.n - int(r)) ** 2 for v, r in zip(row, rest, strict=True))
    got = [exact(row) if about < 1.01 * 2**63 else 2**63 for row, about in zip(y, near, strict=True)]
    return [d if d < 2**63 else None for d in got]


def whiten(vectors: DataFrame, name: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened (array, one number a component), explained (likewise), identity_error for each row
    of vectors (vec_id, and an array of numbers called name) whose vector is neither null nor holds null or non-finite entries.

    Entries become floor(64 * entry) + 1000000; beyond 2**40 they stop there. A vector shorter than the longest ends in
    zeros. Components are unit eigenvectors of the covariance of all remaining rows, by falling eigenvalue, at most most;
    those without variance (equal rows, one row, fewer rows than dimensions) are left out, and without any there are no
    rows. deviation is null where a long can't hold it. Repeated rows and null ids are kept as they are; no rows give no
    rows; other columns are not looked at. Ties of eigenvalues: any basis of their plane, the same for all rows.

    Passes: sums; tiles of dimension pairs, by shuffling column blocks by row block, multiplying all pairs of a row block's
    column blocks and summing by tile, first within tasks; the covariance of the result; the result. The driver holds
    dims * dims numbers, a task one row block. Row blocks are numbered by task, so that a lost task is repeated as it was.
    """
    spark, x = vectors.sparkSession, integers(vectors, name)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    fit = fitted(x, most)
    if fit is None:
        return spark.createDataFrame([], schema)
    dims, shares = len(fit.sums), (fit.values / fit.trace).tolist()

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, m in matrices(batches, dims, ids=True):
            w = projected(m, fit)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * w.shape[1], pa.int32()), pa.array(w.reshape(-1)))
            columns = [ids, pa.array([fit.n] * len(m), pa.int64()), pa.array(deviations(m, fit), pa.int64()), lists, pa.array([shares] * len(m), pa.list_(pa.float64())), pa.array([fit.error] * len(m), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(out, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c")
    return w.select("vec_id", "n", "deviation", "identity_error", each).select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
