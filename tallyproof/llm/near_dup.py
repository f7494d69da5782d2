"""Near-duplicate groups: MinHash signatures, a multi-index Hamming join, and
confirmation on the full shingle sets.

A text's signature holds `chunks * chunk_size` MinHash values of 16 bits each,
cut into chunks. Two signatures that differ in at most
`chunks * (chunk_errors + 1) - 1` positions have, by the pigeonhole principle,
a chunk with at most `chunk_errors` differing positions. Each signature is
therefore posted under every chunk with every choice of that many positions
left out; equal keys give the candidates, so no pair under that distance is
lost.

Texts with equal shingle sets are one node from the start. A bucket never
emits its pairs: members are first held against the bucket's leader only. What
stays in different groups after those links are confirmed is compared inside
the task, signature against signature in bounded blocks: first each node is held
against the one node of another group whose signature is nearest, which links
nearly all that there is to link; then, for what is still apart, the pairs of
blocks (about `BLOCK` nodes or `BLOCK_SHINGLES` shingles each, whichever is
reached first) that hold a candidate go on to the exact comparison of full sets.
Nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import arrow_limits, buffers, mix, pieces, shingle_hashes, small_or_not, word_hashes, written

#: Nodes and shingles that a block of exact comparisons holds on average.
BLOCK, BLOCK_SHINGLES = 512, 2 << 20
#: Rows of a block in signature comparisons (a bucket of n rows is copied n / BUCKET_BLOCK
#: times), and of the tiles that are compared at once.
BUCKET_BLOCK, TILE = 2048, 512
_MUL = np.uint64(0xD6E8FEB86659FD93)


def _sets(column: pa.Array, shingle: int) -> Iterator[list[np.ndarray]]:
    data, offsets = buffers(column)
    for i, j in pieces(data, offsets):
        part = offsets[i : j + 1]
        yield shingle_hashes(*word_hashes(data[part[0] : part[-1]], part - part[0]), shingle)


def _digest(x: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def min_hashes(sets: list[np.ndarray], positions: int, seed: int) -> np.ndarray:
    """16-bit MinHash values, a row for each set; empty sets get zeros."""
    rng = np.random.default_rng(seed)
    flip = rng.integers(0, 1 << 32, positions, dtype=np.uint32)
    times = rng.integers(0, 1 << 32, positions, dtype=np.uint32) | np.uint32(1)
    out = np.zeros((len(sets), positions), np.uint32)
    full = np.flatnonzero([len(s) > 0 for s in sets])
    if len(full):
        h = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        least = np.empty((positions, len(full)), np.uint32)
        x = np.empty_like(h)
        for k in range(positions):
            np.bitwise_xor(h, flip[k], out=x)
            np.multiply(x, times[k], out=x)
            least[k] = np.minimum.reduceat(x, starts)
        out[full] = least.T
    return (out * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def _signer(shingle: int, positions: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, low, high, sigs = [], [], [], []
            for sets in _sets(batch.column(1), shingle):
                for x in sets:
                    a, b = _digest(x)
                    sizes.append(len(x))
                    low.append(a)
                    high.append(b)
                sigs += [s.tobytes() for s in min_hashes(sets, positions, seed)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(sigs, pa.binary())], ["id", "n", "h1", "h2", "sig"])

    return run


def _matrix(column: pa.Array, positions: int) -> np.ndarray:
    data, _ = buffers(column)
    return data.view(np.uint16).reshape(-1, positions) if len(data) else np.empty((0, positions), np.uint16)


def chunk_keys(sig: np.ndarray, chunks: int, size: int, errors: int) -> Iterator[np.ndarray]:
    """A key for each chunk and each choice of `errors` positions left out."""
    combo = 0
    for c in range(chunks):
        for left_out in combinations(range(size), errors):
            combo += 1
            key = np.full(len(sig), combo, np.uint64)
            for q in range(size):
                if q not in left_out:
                    key = mix(key * _MUL + sig[:, c * size + q])
            yield key.view(np.int64)


def _poster(chunks: int, size: int, errors: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _matrix(batch.column(1), chunks * size)
            node = batch.column(0)
            for key in chunk_keys(sig, chunks, size, errors):
                yield pa.RecordBatch.from_arrays([pa.array(key), node], ["key", "node"])

    return run


def _near(most: int, positions: int, least: float) -> Callable:
    """Keeps pairs whose signatures differ in at most `most` positions and whose sizes allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _matrix(batch.column("sig_a"), positions), _matrix(batch.column("sig_b"), positions)
            x, y = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            ok = ((a != b).sum(axis=1) <= most) & (np.minimum(x, y) >= least * np.maximum(x, y))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("n_b")], ["a", "b", "n"]).filter(pa.array(ok))

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows come sorted by `keys`; gives a table for each group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and any(c[0] != v for c, v in zip(cols, last, strict=True))
        cuts = np.flatnonzero(new).tolist()
        at = 0
        for cut in [*cuts, batch.num_rows]:
            if cut in cuts or cut == batch.num_rows:
                if cut > at:
                    held.append(batch.slice(at, cut - at))
                if cut < batch.num_rows and held:
                    yield pa.Table.from_batches(held)
                    held = []
                at = cut
        last = [c[-1] for c in cols]
    if held:
        yield pa.Table.from_batches(held)


def _tiles(batches: Iterator[pa.RecordBatch], most: int, positions: int, least: float) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray] | None]:
    """In each bucket block, tile by tile: the rows of the two sides, and how far they
    are apart where they may be a pair of two groups (else 255 or more). None behind
    each block."""
    big = 255 if positions < 255 else 65535

    def tile(sig: np.ndarray, n: np.ndarray, comp: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
        if max(comp[p].max(), comp[q].max()) == min(comp[p].min(), comp[q].min()):
            return None
        ok = comp[p][:, None] != comp[q][None]
        ok &= np.minimum(n[p][:, None], n[q][None]) >= least * np.maximum(n[p][:, None], n[q][None])
        if not ok.any():
            return None
        far = np.zeros(ok.shape, np.uint8 if big == 255 else np.uint16)
        s, t = np.ascontiguousarray(sig[p].T), np.ascontiguousarray(sig[q].T)
        for k in range(positions):
            far += s[k][:, None] != t[k][None]
        far[~ok | (far > most)] = big
        return far if (far < big).any() else None

    for group in _grouped(batches, ["key", "i", "j"]):
        group = group.combine_chunks()
        sig = _matrix(group.column("sig").chunk(0), positions)
        n, comp, bi = (group.column(c).to_numpy() for c in ("n", "comp", "bi"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = (bi == i, bi == j) if i != j else (np.ones(len(n), bool),) * 2
        if not left.any() or not right.any() or comp.min() == comp.max():
            continue
        # tiles of one and the same group fall away
        p, q = (np.flatnonzero(side)[np.argsort(comp[side], kind="stable")] for side in (left, right))
        for a in range(0, len(p), TILE):
            for c in range(a if i == j else 0, len(q), TILE):
                far = tile(sig, n, comp, p[a : a + TILE], q[c : c + TILE])
                if far is not None:
                    yield group, p[a : a + TILE], q[c : c + TILE], far
        yield None


def _nearest(most: int, positions: int, least: float) -> Callable:
    """For each node that may have a pair in another group: the nearest such node (a),
    how far it is, and the node itself (b) with its size (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, int, int]] = {}

        def rows() -> pa.RecordBatch:
            flat = np.array([(a, b, far, n) for b, (far, a, n) in sorted(best.items())], np.int64).reshape(-1, 4)
            return pa.RecordBatch.from_arrays([pa.array(flat[:, c]) for c in range(4)], ["a", "b", "far", "n"])

        for tile in _tiles(batches, most, positions, least):
            if tile is None:
                if len(best) >= 50_000:
                    yield rows()
                    best = {}
                continue
            group, p, q, far = tile
            node, n = group.column("node").to_numpy(), group.column("n").to_numpy()
            for own, other, d in ((p, q, far), (q, p, far.T)):
                at = d.argmin(axis=1)
                low = d[np.arange(len(own)), at]
                for k in np.flatnonzero(low <= most).tolist():
                    found = (int(low[k]), int(node[other[at[k]]]), int(n[own[k]]))
                    if found < best.get(int(node[own[k]]), (1 << 30,)):
                        best[int(node[own[k]])] = found
        yield rows()

    return run


def _residual(most: int, positions: int, least: float) -> Callable:
    """Which pairs of node blocks hold a candidate of two groups; a task gives each
    pair of blocks once, as far as it remembers."""
    names = ["x1", "b1", "x2", "b2"]

    def table(seen: set[tuple[int, int, int, int]]) -> pa.RecordBatch:
        rows = np.array(sorted(seen), np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, c]) for c in range(4)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int, int]] = set()
        for tile in _tiles(batches, most, positions, least):
            if tile is None:
                if len(seen) >= 50_000:
                    yield table(seen)
                    seen = set()
                continue
            group, p, q, far = tile
            x, b = group.column("wl").to_numpy(), group.column("blk").to_numpy()
            u, v = np.nonzero(far <= most)
            one, two = np.stack([x[p[u]], b[p[u]]], 1), np.stack([x[q[v]], b[q[v]]], 1)
            swap = (one[:, 0] > two[:, 0]) | ((one[:, 0] == two[:, 0]) & (one[:, 1] > two[:, 1]))
            both = np.unique(np.where(swap[:, None], np.hstack([two, one]), np.hstack([one, two])), axis=0)
            seen.update(map(tuple, both.tolist()))
        yield table(seen)

    return run


def _set_maker(shingle: int) -> Callable:
    """(node, h1, h2, text) to (node, set), for rows whose text has that very set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = batch.column("h1").to_pylist(), batch.column("h2").to_pylist()
            node, sets, at = [], [], 0
            ids = batch.column("node").to_pylist()
            for part in _sets(batch.column("text"), shingle):
                for x in part:
                    if _digest(x) == (h1[at], h2[at]):
                        node.append(ids[at])
                        sets.append(x.tobytes())
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])

    return run


def _confirm(percent: int) -> Callable:
    """In each group of two blocks: the pairs of different components whose full
    sets pass; of a node's links to one component the first is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["x1", "b1", "x2", "b2"]):
            group = group.combine_chunks()
            node, comp, side = (group.column(c).to_numpy() for c in ("node", "comp", "side"))
            data, offsets = buffers(group.column("set").chunk(0))
            flat = data.view(np.uint64)
            offsets = offsets // 8
            universe, code = np.unique(flat, return_inverse=True)
            sizes = np.diff(offsets)
            one = np.flatnonzero(side == 0)
            two = np.flatnonzero(side == 1) if (side == 1).any() else one
            if not len(one):
                continue
            mark = np.zeros(len(universe), np.int32)
            a, b = [], []
            for c in np.unique(comp[one]).tolist():  # of a large group against itself nothing is left to compare
                others = two[comp[two] != c]
                if not len(others):
                    continue
                cols, starts = code[np.concatenate([np.arange(offsets[k], offsets[k + 1]) for k in others])], np.concatenate([[0], np.cumsum(sizes[others])[:-1]])
                for k in one[comp[one] == c]:
                    own = code[offsets[k] : offsets[k + 1]]
                    mark[own] = 1
                    both = np.add.reduceat(mark[cols], starts)
                    mark[own] = 0
                    ok = np.flatnonzero(100 * both >= percent * (sizes[k] + sizes[others] - both))
                    _, first = np.unique(comp[others[ok]], return_index=True)
                    for m in others[ok[first]]:
                        a.append(max(node[k], node[m]))
                        b.append(min(node[k], node[m]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of `edges(a, b)`, comp the smallest reachable
    node; by alternating large-star and small-star steps until nothing changes."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())

    def kept(rows: DataFrame, most: int) -> DataFrame:
        """Written in files of some 500,000 edges instead of one for each task."""
        return written(rows.coalesce(most // 500_000 + 1), "edges")

    total = edges.count()
    e = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), total)
    was = state(e)
    while was[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        before, e = e, kept(small, was[0])
        now = state(e)
        # equal counts and sums are likely the same edges; a join makes it certain
        if now == was and not e.join(before, ["a", "b"], "left_anti").limit(1).count():
            break
        was = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 75,
    shingle: int = 5,
    chunks: int = 16,
    chunk_size: int = 5,
    chunk_errors: int = 1,
    seed: int = 7,
) -> DataFrame:
    """A row for each row of `df`: id, n_shingles, component_id, kept.

    Rows are linked when 100 * intersection >= percent * union of their sets of
    distinct `shingle`-word shingles (A-Z lowered; words are runs without space,
    tab or line break); component_id is the smallest id that links reach, and
    kept says whether it is the row's own.

    Null or blank texts have no shingles and link with nothing. A null id takes
    part: it gets its group's smallest id that isn't null, and is kept only if
    there is none. Repeated rows and ids are rows of their own; equal texts share
    their component whatever their ids. An empty table gives an empty one. Other
    columns, whatever their names, are not looked at.
    """
    spark = df.sparkSession
    arrow_limits(spark)
    positions, least = chunks * chunk_size, percent / 100
    # beyond the guaranteed distance the keys still find nearly all; the sets decide
    most = max(chunks * (chunk_errors + 1) - 1, positions // 2)
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    signed = written(docs.mapInArrow(_signer(shingle, positions, seed), f"id {kind}, n long, h1 long, h2 long, sig binary"), "signed")
    nodes = written(
        signed.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    posts = nodes.select("node", "sig").mapInArrow(_poster(chunks, chunk_size, chunk_errors), "key long, node long")
    heads = posts.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("cnt")).where("cnt > 1")
    buckets = written(posts.join(heads, "key"), "buckets")

    # every member against its bucket's leader
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    pairs = buckets.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    star = written(pairs.join(a, "a").join(b, "b").mapInArrow(_near(most, positions, least), "a long, b long, n long"), "star")

    def blocks(rows: DataFrame, key: str) -> DataFrame:
        """Into how many blocks the rows of each key go, by number and by shingles.
        Joined without dealing out by `key`, of which one may hold very many rows, where there are few keys."""
        parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long")
        return small_or_not(rows.groupBy(key).agg(parts.alias("parts")))

    def confirmed(rows: DataFrame) -> DataFrame:
        wanted = rows.select("node").distinct().join(nodes.select("node", F.col("id").alias("id_"), "h1", "h2"), "node")
        wanted = small_or_not(written(wanted, "wanted"))
        sets = docs.join(wanted, docs["id"].eqNullSafe(wanted["id_"])).select("node", "h1", "h2", "text").mapInArrow(_set_maker(shingle), "node long, set binary")
        keys = ["x1", "b1", "x2", "b2"]
        full = rows.join(sets, "node").select(*keys, "side", "node", "comp", "set")
        return full.repartition(*keys).sortWithinPartitions(*keys, "side", "node").mapInArrow(_confirm(percent), "a long, b long")

    def stars(rows: DataFrame, name: str) -> DataFrame:
        """The links among pairs (a, b, n): many nodes b, of size n, against one node a."""
        cut = rows.join(blocks(rows, "a"), "a").withColumn("blk", F.pmod(F.xxhash64("b"), "parts"))
        key = [F.col("a").alias("x1"), F.lit(-1).cast("long").alias("b1"), F.col("a").alias("x2"), F.col("blk").alias("b2")]
        sides = cut.select(*key, F.lit(1).alias("side"), F.col("b").alias("node")).unionByName(cut.select(*key, F.lit(0).alias("side"), F.col("a").alias("node")).distinct())
        return written(confirmed(sides.withColumn("comp", F.col("node"))), name)

    # nodes that meet in buckets mostly have the smallest leader of their buckets in common: that makes few blocks
    home = buckets.groupBy("node").agg(F.min("leader").alias("wl"))
    shared = buckets.where("cnt > 2")
    plain = shared.select("node").distinct().join(nodes.select("node", "n", "sig"), "node").join(home, "node")
    plain = written(plain, "member")

    def apart(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What shares a bucket but not a group, in blocks; and all members of buckets."""
        # nodes without a link go in blocks of their own: blocks within one large group then hold no candidate
        member = written(plain.join(found, "node", "left").withColumn("wl", F.when(F.col("comp").isNull(), -F.col("wl") - 1).otherwise(F.col("wl"))).withColumn("comp", F.coalesce("comp", "node")), "grouped")
        member = written(member.join(blocks(member, "wl"), "wl").withColumn("blk", F.pmod(F.xxhash64("node"), "parts")), "dealt")
        mixed = shared.join(member.select("node", "comp"), "node").groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
        part = shared.join(small_or_not(written(mixed, "mixed")), "key").join(member, "node")
        part = part.withColumn("nb", F.ceil(F.col("cnt") / BUCKET_BLOCK).cast("long")).withColumn("bi", F.pmod(F.xxhash64("node", F.lit(1)), "nb"))
        part = part.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).withColumn("i", F.least("bi", "o")).withColumn("j", F.greatest("bi", "o"))
        part = part.select("key", "i", "j", "bi", "node", "n", "sig", "comp", "wl", "blk").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return part, member

    links = stars(star, "links")
    found = written(components(links), "found")
    part, member = apart(found)
    nearest = part.mapInArrow(_nearest(most, positions, least), "a long, b long, far long, n long")
    nearest = nearest.groupBy("b").agg(F.min(F.struct("far", "a", "n")).alias("s")).select("s.a", "b", "s.n")
    closer = stars(written(nearest, "nearest"), "closer")
    if closer.limit(1).count():
        links = links.unionByName(closer)
        found = written(components(links), "found")
        part, member = apart(found)
    near = written(part.mapInArrow(_residual(most, positions, least), "x1 long, b1 long, x2 long, b2 long").distinct(), "near")
    of = member.select("node", "comp", "wl", "blk")
    first = near.join(of, (near["x1"] == of["wl"]) & (near["b1"] == of["blk"])).withColumn("side", F.lit(0))
    second = near.where("x1 <> x2 or b1 <> b2").join(of, (near["x2"] == of["wl"]) & (near["b2"] == of["blk"])).withColumn("side", F.lit(1))
    names = ["x1", "b1", "x2", "b2", "side", "node", "comp"]
    more = written(confirmed(first.select(*names).unionByName(second.select(*names))), "more")
    if more.limit(1).count():
        found = written(components(links.unionByName(more)), "found")

    # only linked nodes go by component; of these one may hold very many
    linked = found.join(nodes.select("node", "id"), "node")
    lowest = written(linked.groupBy("comp").agg(F.min("id").alias("low")), "lowest")
    low = linked.join(small_or_not(lowest), "comp").select("node", "low", F.lit(True).alias("linked"))
    group = nodes.select("node", "h1", "h2", "id").join(low, "node", "left").select("h1", "h2", F.when(F.col("linked"), F.col("low")).otherwise(F.col("id")).alias("low"))
    out = signed.select("id", "n", "h1", "h2").join(group, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
