"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots, in order. The index is cut into
blocks of vectors; in each, an inverted file posts the vectors under their pivots,
sorted by the place that the pivot has for them. A query reads the lists of its own
pivots, of each only the stretch of places not far from its own, and adds up what
every posting takes off the footrule distance (a pivot that a vector doesn't list
counts as being in the place behind the last). The nearest of each block by that
distance are ranked anew by cosine on the original vectors. Queries go to the blocks
in blocks of their own, so neither side is ever whole in one place, and each pair of
blocks gives only its k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.llm.common import arrow_limits, written


def valid(df: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> DataFrame:
    """(id, v) for vectors of the common length without null or non-finite
    components that aren't zero. `dim` None: the most frequent length, ties to the larger."""
    v = F.col("v")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(v.isNotNull())
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(sound)
    if dim is None:
        dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
        dim = dims[0]["dim"] if dims else 0
    return rows.where(F.size("v") == dim)


def _rows(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def orders(x: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    """The `listed` nearest pivots of each row by cosine, ties to the smaller number."""
    far = -np.round(x @ pivots.T / np.linalg.norm(x, axis=1, keepdims=True), 12)
    return np.argsort(far, axis=1, kind="stable")[:, :listed].astype(np.int16)


def _ordered(pivots: np.ndarray, listed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                o = orders(_rows(batch.column("v")), pivots, listed)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array([r.tobytes() for r in o], pa.binary())], ["id", "v", "perm"])

    return run


class Block:
    """An inverted file over some vectors: their ids, rows, and ordered pivots."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, perm: np.ndarray, pivots: int, k: int):
        # equal vectors are one entry, however many there are; of its ids, k + 1 are enough
        _, first, group = np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
        order = np.argsort(group, kind="stable")
        cut = np.searchsorted(group[order], np.arange(len(first) + 1))
        self.members = [ids[order[a : min(b, a + k + 1)]] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.x, perm = x[first], perm[first]
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.listed = perm.shape[1]
        slot = perm.astype(np.int64) * self.listed + np.arange(self.listed)  # by pivot, then place
        by = np.argsort(slot.ravel(), kind="stable")
        self.row = (by // self.listed).astype(np.int64)
        self.cuts = np.searchsorted(slot.ravel()[by], np.arange(pivots * self.listed + 1))
        # with both pivots listed, the footrule's share falls from (listed - a) + (listed - b) to |a - b|
        at = np.arange(self.listed)
        self.gain = 2.0 * (self.listed - np.maximum(at[:, None], at[None]))

    def near(self, perm: np.ndarray, keep: int, reach: int) -> np.ndarray:
        """Rows of the `keep` nearest by footrule, from postings within `reach` places."""
        if keep >= len(self.x):
            return np.arange(len(self.x))
        at = np.arange(self.listed)
        lo, hi = np.maximum(at - reach, 0), np.minimum(at + reach + 1, self.listed)
        base = perm.astype(np.int64) * self.listed
        # every (pivot, place) slot that is read, and the postings in it
        wide = hi - lo
        own = np.repeat(at, wide)
        place = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat(lo, wide)
        a, b = self.cuts[base[own] + place], self.cuts[base[own] + place + 1]
        n = b - a
        index = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        near = np.bincount(self.row[index], weights=np.repeat(self.gain[own, place], n), minlength=len(self.x))
        return np.argpartition(-near, keep - 1)[:keep]


def _search(k: int, pivots: int, share: float, least: int, reach: float):
    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if queries.num_rows and block.num_rows:
            block = block.sort_by("id").combine_chunks()  # ties go to the smaller id
            places = lambda t: np.frombuffer(b"".join(t.column("perm").to_pylist()), np.int16).reshape(t.num_rows, -1)
            held = Block(block.column("id").to_numpy(), _rows(block.column("v")), places(block), pivots, k)
            x = held.x
            keep = min(len(x), max(least, k + 1, int(np.ceil(share * len(x)))))
            qid, qx, qperm = queries.column("id").to_numpy(), _rows(queries.column("v")), places(queries)
            for i in range(len(qid)):
                near = held.near(qperm[i], keep, int(np.ceil(reach * held.listed)))
                score = (x[near] * qx[i]).sum(axis=1) / (held.norm[near] * np.sqrt((qx[i] * qx[i]).sum()))
                best = np.flatnonzero(score >= np.sort(score)[max(0, len(score) - k - 1)])
                ranked = sorted((-score[j], int(v)) for j in best.tolist() for v in held.members[near[j]] if v != qid[i])
                found += [(qid[i], v, -s) for s, v in ranked[:k]]
        cols = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def nearest(
    df: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    pivots: int = 1024,
    listed: int = 64,
    share: float = 0.12,
    least: int = 200,
    reach: float = 0.5,
    block_rows: int = 8192,
    query_rows: int = 1024,
    dim: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each query row.

    Pivots are at most `pivots` vectors, drawn by a hash of their ids: the one
    bounded sample. Every vector is indexed. Of each block, the nearest `share`
    by footrule (at least `least`) are ranked by cosine in double precision; of the
    lists, places within `reach` times `listed` of the query's own are read. Ids
    must be whole numbers; rows with a null id, and vectors that are null, zero,
    of another length, or hold null or non-finite components take no part. Of rows
    with one id the smallest vector counts, and the id is a query if one of them is.
    Equal scores go to the smaller id. An empty table gives an empty one; other
    columns, whatever their names, are only seen by `is_query`.
    """
    spark = df.sparkSession
    arrow_limits(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).where("id is not null")
    vectors = written(valid(rows, "id", "v", dim).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    drawn = [r["v"] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()]
    schema = "query_id long, rank int, vec_id long, score double"
    if not drawn:
        return spark.createDataFrame([], schema)
    p = np.array(drawn)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    listed = min(listed, len(p))
    index = written(vectors.mapInArrow(_ordered(p, listed), "id long, v array<double>, perm binary"), "permutations")
    n = index.count()
    queries = written(index.join(rows.where("asked").select("id").distinct(), "id", "left_semi"), "queries")
    blocks, qblocks = -(-n // block_rows), -(-max(1, queries.count()) // query_rows)

    def spread(rows: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        rows = rows.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left = spread(queries, "qb", qblocks, "b", blocks).groupBy("b", "qb")
    right = spread(index, "b", blocks, "qb", qblocks).groupBy("b", "qb")
    local = left.cogroup(right).applyInArrow(_search(k, len(p), share, least, reach), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
