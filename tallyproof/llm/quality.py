"""Quality of documents by weak labels and a hashed linear scorer.

Heuristic labellers vote on every document from statistics of its whole text.
Expectation-maximisation on the counts of vote patterns (at most 3 to the number
of labellers, whatever the corpus) estimates how accurate each labeller is on good
text and on every kind of bad text (a labeller knows one kind and misses the
others, so that one class of bad text would not do), and gives every pattern a
posterior. Posteriors of a bounded sample then train a linear model on hashed
words, word shapes, shape pairs and statistics, and that model scores every
document on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import arrow_limits, buffers, mix, pieces, words
from tallyproof.llm.weak import fit_linear, latent_classes

DIMS = 1 << 14
SHAPES = 64
#: Statistics per document, in this order.
STATS = ("repeats", "top", "variety", "capitals", "shouts", "marks", "bars", "stops", "long")
LABELLERS = 8

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower and all beyond ASCII, 3 digit, 4 sentence mark, 5 ! or ?, 6 other mark
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[128:] = 2
_KIND[48:58] = 3
for _c in b".,;:":
    _KIND[_c] = 4
for _c in b"!?":
    _KIND[_c] = 5
for _c in b"#$%&*+/<=>@[\\]^_`{|}~":
    _KIND[_c] = 6


class Words:
    """Word shapes and per-document statistics of texts that lie end to end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        hashes, starts, ends, first = words(data, offsets)
        self.first, n = first, len(offsets) - 1
        self.count = np.diff(first)
        if not len(hashes):
            self.word, self.shape, self.pair, self.stats = *(np.empty(0, np.int64) for _ in range(3)), np.zeros((n, len(STATS)))
            return
        self.word = (hashes % np.uint64(DIMS)).astype(np.int64)
        kind = _KIND[data]

        def inside(k: int) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
            return total[ends] - total[starts]

        upper, lower, marks = inside(1), inside(2), inside(6)
        repeat = np.zeros(len(hashes), bool)
        repeat[1:] = hashes[1:] == hashes[:-1]
        begin = first[:-1][self.count > 0]
        repeat[begin] = False
        last = kind[ends - 1]
        case = np.where(upper + lower == 0, 3, np.where((upper > 1) & (lower == 0), 2, np.where(kind[starts] == 1, 1, 0)))
        end = np.where(last == 4, 1, np.where(last == 5, 2, np.where(last == 6, 3, 0)))
        self.shape = (case * 4 + end + 16 * repeat + 32 * (marks > 0)).astype(np.int64)
        before = np.concatenate([[SHAPES], self.shape[:-1]])
        before[begin] = SHAPES
        self.pair = before * SHAPES + self.shape
        length = ends - starts
        bar = (length == 1) & (data[starts] == ord("|"))
        doc = np.repeat(np.arange(n), self.count)
        order = np.lexsort((hashes, doc))
        h, d = hashes[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(h)))
        top = np.zeros(n)
        np.maximum.at(top, d[at], times)
        # Herdan's C: how the number of distinct words grows with all, on a scale that length leaves alone
        variety = np.log(np.maximum(np.bincount(d[at], minlength=n), 1)) / np.log(np.maximum(self.count, 2))
        share = lambda flag: np.bincount(doc, weights=flag, minlength=n) / np.maximum(self.count, 1)
        self.stats = np.stack(
            [share(repeat), top / np.maximum(self.count, 1), variety, share(case == 2), share(end == 2), share(marks > 0), share(bar), share(end == 1), share(length > 40)],
            axis=1,
        )


def votes(count: np.ndarray, stats: np.ndarray) -> list[str]:
    """A pattern for each document: + speaks for good text, - against, 0 abstains."""
    s = dict(zip(STATS, stats.T, strict=True))
    enough, many = count >= 8, count >= 30

    def vote(bad: np.ndarray, good: np.ndarray, may: np.ndarray) -> np.ndarray:
        return np.where(may & bad, "-", np.where(may & good, "+", "0"))

    rows = [
        vote(s["repeats"] >= 0.08, s["repeats"] <= 0.02, count >= 20),
        vote(s["top"] >= 0.5, s["top"] <= 0.2, many),
        vote(s["variety"] < 0.55, s["variety"] >= 0.7, many),
        vote(s["capitals"] >= 0.2, s["capitals"] <= 0.05, enough),
        vote(s["shouts"] >= 0.15, s["shouts"] <= 0.03, enough),
        vote(s["marks"] - s["bars"] >= 0.12, s["marks"] - s["bars"] <= 0.03, enough),
        vote(s["bars"] >= 0.08, s["bars"] <= 0.01, enough),
        vote((s["stops"] < 0.005) | (s["long"] > 0.1), (s["stops"] >= 0.02) & (s["stops"] <= 0.5), many),
    ]
    return ["".join(p) for p in np.stack(rows, axis=1).tolist()] if len(count) else []


def _hash(numbers: np.ndarray) -> np.ndarray:
    return (mix(numbers.astype(np.uint64) + np.uint64(0x9E37)) % np.uint64(DIMS)).astype(np.int64)


#: Hashed places of shapes, of pairs, and of the steps that statistics fall in.
STEPS = np.array([0.002, 0.01, 0.03, 0.06, 0.1, 0.16, 0.25, 0.4, 0.6, 0.8])
SHAPE_AT = _hash(np.arange(SHAPES))
PAIR_AT = _hash(np.arange(SHAPES * (SHAPES + 1)) + 1000)
STEP_AT = _hash(np.arange(len(STATS) * (len(STEPS) + 1)) + 100_000).reshape(len(STATS), -1)


def step_places(stats: np.ndarray) -> np.ndarray:
    return np.stack([STEP_AT[k][np.searchsorted(STEPS, stats[:, k], side="right")] for k in range(len(STATS))], axis=1)


def scores(w: Words, model: np.ndarray) -> np.ndarray:
    """The linear score of each document; 0 for a document without words."""
    total = np.concatenate([[0.0], np.cumsum(model[w.word] + model[SHAPE_AT[w.shape]] + model[PAIR_AT[w.pair]])])
    mean = (total[w.first[1:]] - total[w.first[:-1]]) / np.maximum(w.count, 1)
    z = mean + model[step_places(w.stats)].sum(axis=1) + model[-1]
    return np.where(w.count > 0, np.round(1 / (1 + np.exp(-np.clip(z, -50, 50))), 9), 0.0)


def sparse(w: Words) -> tuple[list[list[int]], list[list[float]]]:
    """The features that `scores` weighs, for training."""
    rows, values, steps = [], [], step_places(w.stats)
    for k, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        at, n = np.unique(np.concatenate([w.word[a:b], SHAPE_AT[w.shape[a:b]], PAIR_AT[w.pair[a:b]]]), return_counts=True)
        rows.append([*at.tolist(), *steps[k].tolist()])
        values.append([*(n / max(b - a, 1)).tolist(), *[1.0] * len(STATS)])
    return rows, values


def _each(column: pa.Array) -> Iterator[Words]:
    data, offsets = buffers(column)
    for i, j in pieces(data, offsets):
        part = offsets[i : j + 1]
        yield Words(data[part[0] : part[-1]], part - part[0])


def _voter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [p for w in _each(batch.column(0)) for p in votes(w.count, w.stats)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["votes"])


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for w in _each(batch.column(1)):
            rows, values = sparse(w)
            keep = np.flatnonzero(w.count > 0)
            pattern = votes(w.count, w.stats)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at + keep)), *(pa.array([x[k] for k in keep.tolist()], t) for x, t in ((pattern, pa.string()), (rows, pa.list_(pa.int32())), (values, pa.list_(pa.float32()))))], ["h", "votes", "at", "value"]
            )
            at += len(w.count)


class Model:
    """`posterior` of the vote patterns; `table` holds P(against | class, it votes),
    class 0 being good text and the others the kinds of bad text; `shares` are the
    classes' own; `weights` belong to the linear scorer."""

    def __init__(self, posterior: dict[str, float], weights: np.ndarray, table: np.ndarray, shares: np.ndarray):
        self.posterior, self.weights, self.table, self.shares = posterior, weights, table, shares
        self.prior = float(shares[0])


def fit(df: DataFrame, text_col: str = "text", sample_rows: int = 4000) -> Model:
    """Votes of all documents; the linear model from about `sample_rows` distinct
    texts (twice as many at most), those with the smallest hashes: copies count once,
    and reruns draw the same."""
    arrow_limits(df.sparkSession)
    texts = df.select(F.col(text_col).alias("text"))
    seen = texts.mapInArrow(_voter, "votes string").groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3 ** 8 rows
    seen = sorted((r["votes"], r["n"]) for r in seen)
    post, table, shares = latent_classes([p for p, _ in seen], [n for _, n in seen])
    posterior = {p: float(v) for (p, _), v in zip(seen, post[:, 0], strict=True)}
    total = max(1, sum(n for _, n in seen))
    least = int(min(1.0, sample_rows / total) * 1_000_000) + 1
    h = F.xxhash64("text", F.lit(11))
    drawn = texts.select(h.alias("h"), "text").where(F.pmod("h", F.lit(1_000_000)) < least).mapInArrow(_sampler, "h long, votes string, at array<int>, value array<float>")
    drawn = drawn.groupBy("h", "votes").agg(F.first("at").alias("at"), F.first("value").alias("value")).orderBy(F.pmod("h", F.lit(1_000_000)), "h", "votes").limit(2 * sample_rows).collect()
    y = [posterior[r["votes"]] for r in drawn]
    good, bad = max(sum(y), 1e-9), max(len(y) - sum(y), 1e-9)
    # both classes weigh alike up to a factor of 4, so that the rarer one is learnt
    weight = [v + (1 - v) * min(4.0, max(1.0, good / bad)) for v in y]
    model = fit_linear([r["at"] for r in drawn], [r["value"] for r in drawn], y, weight, DIMS)
    return Model(posterior, model, table, shares)


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """A row for each row: id, n_words, votes, posterior (of the vote pattern),
    score (of the linear model), keep (score >= threshold).

    A text without words, null included, scores 0 and is rejected. Null and
    repeated ids and repeated rows pass through; equal texts score alike. An empty
    table gives an empty one; other columns are not looked at. Very long texts go
    through whole.
    """
    model = model or fit(df, text_col)
    weights, posterior, prior = model.weights, model.posterior, model.prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, v, s = [], [], []
            for w in _each(batch.column(1)):
                n += w.count.tolist()
                v += votes(w.count, w.stats)
                s += scores(w, weights).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(v, pa.string()), pa.array([posterior.get(p, prior) for p in v], pa.float64()), pa.array(s, pa.float64())], ["id", "n_words", "votes", "posterior", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words long, votes string, posterior double, score double")
    return out.withColumn("keep", F.col("score") >= threshold).withColumnRenamed("id", id_col)


def accepted(df: DataFrame, text_col: str = "text", threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """The rows of `df`, all columns, whose text the classifier keeps."""
    weights = (model or fit(df, text_col)).weights
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [v >= threshold for w in _each(batch.column(at)) for v in scores(w, weights).tolist()]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return df.mapInArrow(run, df.schema)


