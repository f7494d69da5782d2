"""Whitening of embeddings by a one-sided Jacobi singular value decomposition.

Entries become whole numbers; their sums are exact, so rows are centred without
rounding before anything is multiplied. Blocks of centred rows are reduced to triangles
by QR, in each task and then sixteen triangles at a time, so that what meets is a few
numbers for each dimension, however many rows there are. Plane rotations then make the
columns of the last triangle orthogonal: their lengths are the standard deviations times
sqrt(n), and the accumulated rotations are the components. The covariance itself is never
formed, so small deviations keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import arrow_limits

#: Vectors with an entry of this size or more, of which no whole number is formed exactly, take no part.
MOST = float(1 << 38)
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vec: Column, scale: int, shift: int) -> Column:
    """The vector as whole numbers; null where it holds a null or non-finite entry."""
    wide = vec.cast("array<double>")
    sound = vec.isNotNull() & F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST))
    return F.when(sound, F.transform(wide, lambda c: F.floor(c * float(scale)).cast("long") + shift))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "s": [_rows(batch.column("x")).sum(axis=0).tolist()]}, schema=pa.schema([("n", pa.int64()), ("s", pa.list_(pa.int64()))]))


def centred(x: np.ndarray, n: int, s: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """x - S/n, rounded once, and for each row the exact sum of (n*x - S)^2, null where
    that is beyond a long. `s` has Python's whole numbers where 64 bits could overflow."""
    most = int(np.abs(x).max(initial=0)) * n + max((abs(int(v)) for v in s), default=0)
    if most < 1 << 62:
        d = x * n - s.astype(np.int64)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return d / n, (d * d).sum(axis=1).tolist()
    else:
        d = x.astype(object) * n - s
    exact = [sum(int(v) ** 2 for v in row) for row in d]
    return (d / n).astype(np.float64), [v if v < 1 << 63 else None for v in exact]


def triangle(x: np.ndarray) -> np.ndarray:
    """R of x = QR, square, whatever the number of rows."""
    r = np.linalg.qr(x, mode="r")
    return np.vstack([r, np.zeros((x.shape[1] - len(r), x.shape[1]))]) if len(r) < x.shape[1] else r


_TRIANGLE = "nr long, r array<double>"


def _arrow_triangle(nr: int, r: np.ndarray) -> dict:
    return {"nr": [nr], "r": [r.ravel()]}


def _local(n: int, s: np.ndarray):
    """A triangle for each task, of all its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, nr = None, 0
        for batch in batches:
            if batch.num_rows:
                x = centred(_rows(batch.column("x")), n, s)[0]
                r = triangle(x if r is None else np.vstack([r, x]))
                nr = batch.column("part")[0].as_py()
        if r is not None:
            yield pa.RecordBatch.from_pydict(_arrow_triangle(nr, r), schema=pa.schema([("nr", pa.int64()), ("r", pa.list_(pa.float64()))]))

    return run


def _merged(dim: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        r = None
        for row in table.sort_by("nr").column("r"):
            block = np.asarray(row.values).reshape(dim, dim)
            r = block if r is None else triangle(np.vstack([r, block]))
        return pa.table(_arrow_triangle(key[0].as_py(), r), schema=pa.schema([("nr", pa.int64()), ("r", pa.list_(pa.float64()))]))

    return run


def tall_skinny_qr(rows: DataFrame, n: int, s: np.ndarray, fan: int = 16) -> np.ndarray:
    """R of all centred rows: a triangle for each task, then `fan` at a time."""
    dim = len(s)
    found = rows.withColumn("part", F.spark_partition_id()).mapInArrow(_local(n, s), _TRIANGLE)
    deal = fan * fan
    while deal:
        found = found.withColumn("g", F.pmod("nr", F.lit(deal)).cast("long")).groupBy("g").applyInArrow(_merged(dim), _TRIANGLE)
        deal //= fan
    last = found.first()
    return np.array(last["r"]).reshape(dim, dim)


def jacobi(r: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(deviations, components as columns) of a square matrix: plane rotations of disjoint
    pairs of columns, dealt as in a round-robin tournament, until all are orthogonal.
    Largest deviation first; of each component the largest entry is positive."""
    dim = r.shape[1]
    size = dim + dim % 2
    a = np.zeros((r.shape[0], size))
    a[:, :dim] = r
    v = np.eye(size)
    if dim:
        scale = np.abs(a).max()
        a = a / scale if scale > 0 else a
        players = np.arange(size)
        for _ in range(sweeps):
            worst = 0.0
            for _ in range(size - 1):
                p, q = players[: size // 2], players[size // 2 :][::-1]
                x, y = a[:, p], a[:, q]
                aa, bb, ab = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    off = np.where((aa > 0) & (bb > 0), np.abs(ab) / np.sqrt(aa * bb), 0.0)
                    turn = off > tolerance
                    worst = max(worst, float(off.max(initial=0)))
                    zeta = (bb - aa) / (2 * ab)
                    t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
                    t = np.where(turn & np.isfinite(t), t, 0.0)
                c = 1 / np.sqrt(1 + t * t)
                sn = c * t
                a[:, p], a[:, q] = c * x - sn * y, sn * x + c * y
                vp, vq = v[:, p], v[:, q]
                v[:, p], v[:, q] = c * vp - sn * vq, sn * vp + c * vq
                players = np.concatenate([players[:1], players[-1:], players[1:-1]])
            if worst <= tolerance * size:
                break
        a = a * scale
    length = np.sqrt((a * a).sum(axis=0))[:dim] if dim % 2 == 0 else np.sqrt((a * a).sum(axis=0))
    if dim % 2:  # the column that evened the number stays zero and by itself
        keep = np.flatnonzero(np.abs(v[:dim, :]).sum(axis=0) > 0)
        length, v = length[keep], v[:, keep]
    v = v[:dim, : len(length)]
    order = np.argsort(-length, kind="stable")
    length, v = length[order], v[:, order]
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]) if dim else np.empty(0)
    return length, v * np.where(sign == 0, 1, sign)


def _projected(x: np.ndarray, n: int, s: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    c, deviation = centred(x, n, s)
    return c @ axes, deviation


def _moments(n: int, s: np.ndarray, axes: np.ndarray):
    """Sums of the whitened values and of their products, for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w, _ = _projected(_rows(batch.column("x")), n, s, axes)
                sums = np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
                yield pa.RecordBatch.from_pydict({"m": [sums]}, schema=pa.schema([("m", pa.list_(pa.float64()))]))

    return run


def _whitened(n: int, s: np.ndarray, axes: np.ndarray, explained: np.ndarray, flat: np.ndarray, error: float | None):
    k = axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            w, deviation = _projected(_rows(batch.column("x")), n, s, axes)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(w.ravel(), mask=np.tile(flat, rows)),
                    pa.array(np.tile(explained, rows), mask=np.isnan(np.tile(explained, rows))),
                    pa.array([error] * (rows * k), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000, dim: int | None = None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): for each
    vector its first `components` whitened values.

    Vectors that are null or hold null or non-finite entries are dropped, and so are those
    with an entry of 2 ** 38 or more, and those of another length than `dim` (None: the most
    frequent length, ties to the larger). All others are fitted, rows that repeat or have null
    ids among them. Along a component without variance whitened is null, and identity_error
    is taken over the others (null if there is none); explained is null where nothing varies.
    deviation is exact, and null where it is beyond a long. Vectors of fewer dimensions have
    that many components; empty vectors, like an empty table, give no rows. Other columns are
    not looked at. The driver sees sums, one triangle and the moments: bounded by dimensions.
    """
    spark = df.sparkSession
    arrow_limits(spark)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vec_col), scale, shift).alias("x")).where("x is not null")
    if dim is None:
        dims = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
        dim = dims[0]["dim"] if dims else 0
    rows = rows.where(F.size("x") == dim)
    parts = rows.mapInArrow(_sums, "n long, s array<long>").select("n", F.posexplode("s").alias("at", "s"))
    sums = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    if not sums:
        return spark.createDataFrame([], SCHEMA)
    n, s = sums[0]["n"], np.array([int(r["s"]) for r in sums], dtype=object)
    length, axes = jacobi(tall_skinny_qr(rows, n, s))
    deviations = length / np.sqrt(n)
    k = min(components, dim)
    total = float((length * length).sum())
    explained = (length * length)[:k] / total if total > 0 else np.full(k, np.nan)
    # what is left of rounding in a direction without variance is no variance
    flat = deviations[:k] <= deviations[0] * np.finfo(float).eps * dim
    axes = np.where(flat, 0.0, axes[:, :k] / np.where(flat, 1.0, deviations[:k]))
    moments = rows.mapInArrow(_moments(n, s, axes), "m array<double>").select(F.posexplode("m").alias("at", "m"))
    m = np.array([r["m"] for r in moments.groupBy("at").agg(F.sum("m").alias("m")).orderBy("at").collect()]) / n
    spread = m[k:].reshape(k, k) - np.outer(m[:k], m[:k]) - np.eye(k)
    kept = spread[np.ix_(~flat, ~flat)]
    error = float(np.abs(kept).max()) if kept.size else None
    return rows.mapInArrow(_whitened(n, s, axes, explained, flat, error), SCHEMA)
