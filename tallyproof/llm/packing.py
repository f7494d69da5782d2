"""Best-fit packing of token sequences from their length histogram.

The driver sees only how many pieces there are of each length (at most
`capacity` numbers). It enumerates patterns of up to three length classes that
fill a sequence, fits their repeat counts to the histogram by non-negative least
squares, rounds down, turns them into runs of exact lengths, and packs what is
left over by best fit, longest first, run by run, into the gaps and into new
sequences. A piece finds its place by its rank among the pieces of its length,
which comes from counts of each write task: no length, however frequent, is
sorted or gathered anywhere.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.llm.common import arrow_limits, small_or_not, written
from tallyproof.llm.tokens import default_path, encoder

#: Length classes that patterns are made of.
CLASSES = 256


def patterns(classes: int) -> np.ndarray:
    """Rows of three class numbers that add up to `classes`; 0 stands for none."""
    rows = [(classes, 0, 0)]
    for a in range(classes - 1, 0, -1):
        for b in range(min(a, classes - a), 0, -1):
            c = classes - a - b
            if c <= b:
                rows.append((a, b, c))
    return np.array(rows, np.int64)


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Lawson and Hanson's active-set solution of min |Ax - target|, x >= 0, where
    column p of A counts the classes in `columns[p]` (entries of class 0 are void)."""
    m = len(target)  # class 0 is row 0 and stays zero

    def dense(picked: np.ndarray) -> np.ndarray:
        a = np.zeros((m, len(picked)))
        for k in range(columns.shape[1]):
            np.add.at(a, (columns[picked, k], np.arange(len(picked))), 1.0)
        a[0] = 0
        return a

    x, passive = np.zeros(len(columns)), np.zeros(len(columns), bool)
    slack = target.astype(float).copy()
    slack[0] = 0
    limit = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        gain = slack[columns].sum(axis=1)
        gain[passive] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= limit:
            break
        passive[best] = True
        while True:
            picked = np.flatnonzero(passive)
            a = dense(picked)
            z = np.linalg.lstsq(a, np.where(np.arange(m) > 0, target, 0.0), rcond=None)[0]
            if len(z) == 0 or z.min() > 0:
                x[:] = 0
                x[picked] = z
                break
            bad = z <= 0
            step = np.min(x[picked][bad] / np.maximum(x[picked][bad] - z[bad], 1e-300))
            moved = x[picked] + step * (z - x[picked])
            x[:] = 0
            x[picked] = np.where(moved > 1e-12, moved, 0)
            passive[picked[x[picked] <= 0]] = False
            if not passive.any():
                break
        picked = np.flatnonzero(passive)
        slack = np.where(np.arange(m) > 0, target - dense(picked) @ x[picked], 0.0)
    return x


def plan(histogram: dict[int, int], capacity: int, classes: int = CLASSES) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths, how many sequences hold just these) that use the histogram up."""
    left = {k: v for k, v in histogram.items() if v > 0}
    classes = min(classes, capacity)
    width = -(-capacity // classes)
    classes = -(-capacity // width)
    target = np.zeros(classes + 1)
    by_class: dict[int, list[int]] = {}
    for length in sorted(left):
        c = -(-length // width)
        target[c] += left[length]
        by_class.setdefault(c, []).append(length)
    table = patterns(classes)
    table = table[((target[table] > 0) | (table == 0)).all(axis=1)]
    runs: list[tuple[tuple[int, ...], int]] = []
    if len(table):
        for p, x in zip(table, nnls(table, target), strict=True):
            n = int(x + 1e-6)
            while n > 0:
                chosen: list[int] = []
                for c in (int(c) for c in p if c):
                    have = by_class.get(c, [])
                    while have and left[have[-1]] <= 0:
                        have.pop()
                    k = len(have) - 1
                    while k >= 0 and left[have[k]] <= chosen.count(have[k]):
                        k -= 1
                    if k < 0:
                        break
                    chosen.append(have[k])
                else:
                    times = min(n, *(left[v] // chosen.count(v) for v in set(chosen)))
                    for v in chosen:
                        left[v] -= times
                    runs.append((tuple(chosen), times))
                    n -= times
                    continue
                break
    # best fit, longest first; runs with the same room are as good as each other
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for lengths, times in runs:
        room.setdefault(capacity - sum(lengths), []).append((lengths, times))
    gaps = sorted(room)

    def put(lengths: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in room:
            room[gap] = []
            bisect.insort(gaps, gap)
        room[gap].append((lengths, times))

    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo > 0:
            k = bisect.bisect_left(gaps, length)
            if k == len(gaps):
                fit = capacity // length
                if todo // fit:
                    put((length,) * fit, todo // fit)
                if todo % fit:
                    put((length,) * (todo % fit), 1)
                break
            gap = gaps[k]
            lengths, times = room[gap].pop()
            if not room[gap]:
                del room[gap]
                gaps.pop(k)
            used = min(times, todo)
            if used < times:
                put(lengths, times - used)
            put((*lengths, length), used)
            todo -= used
    return [run for gap in sorted(room) for run in room[gap]]


def places(runs: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each stretch of ranks of a length: the first sequence and the offset.
    `at` orders the stretches: pieces of smaller lengths first, then by rank."""
    slots: list[tuple[int, int, int, int]] = []
    base = 0
    for lengths, times in runs:
        offset = 0
        for v in lengths:
            slots.append((v, times, base, offset))
            offset += v
        base += times
    slots.sort(key=lambda s: s[0])
    length, times, first, offset = (np.array([s[k] for s in slots], np.int64) for k in range(4))
    at = np.concatenate([[0], np.cumsum(times)[:-1]]).astype(np.int64) if len(slots) else np.empty(0, np.int64)
    begin = np.full(capacity + 2, 0, np.int64)
    total = np.bincount(length, weights=times, minlength=capacity + 1) if len(slots) else np.zeros(capacity + 1)
    begin[1:] = np.cumsum(total)[: capacity + 1].astype(np.int64)
    return {"at": at, "first": first, "offset": offset, "begin": begin}


def _cutter(path: str, end_id: int | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in batches:
            source, piece, start, length, crc, rank = [], [], [], [], [], []
            for row, ids in enumerate(enc.column(batch.column(1))):
                ids = np.concatenate([ids.astype("<u4"), tail])
                for k, a in enumerate(range(0, len(ids), capacity)):
                    own = ids[a : a + capacity]
                    source.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(len(own))
                    crc.append(zlib.crc32(own.tobytes()))
                    rank.append(int(seen[len(own)]))
                    seen[len(own)] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc)), pa.array(np.full(len(source), part, np.int64)), pa.array(rank, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    return run


def _placer(table: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            at = table["begin"][length] + rank
            k = np.searchsorted(table["at"], at, side="right") - 1
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(table["first"][k] + at - table["at"][k]), pa.array(table["offset"][k])], [*names, "sequence_id", "offset"])

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int | None = 0, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Each row of `df` is one document: its ids, then `end_id`. Documents of more
    than `capacity` ids are cut into pieces of just that many, the last may be
    shorter; others stay whole. The pieces of a sequence lie end to end from 0.
    A null text is empty: only the end id remains. Null and repeated ids, and
    repeated rows, are documents like any other. An empty table gives an empty
    one. Other columns are not looked at.
    """
    spark = df.sparkSession
    arrow_limits(spark)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    cut = written(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_cutter(tokenizer or default_path(), end_id, capacity), f"{schema}, part long, rank long"), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = places(plan(histogram, capacity), capacity)
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    placed = cut.join(small_or_not(written(before, "before")), ["part", "length"]).mapInArrow(_placer(table), f"{schema}, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
