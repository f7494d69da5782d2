"""Word-piece lengths by a linear longest-match automaton.

The vocabulary becomes a trie over bytes. Each node has a failure link and the
number of pieces that following it completes, both computed beforehand, so that
a word is read once, left to right, and the number of its greedy longest-match
pieces comes out without any piece being cut. A word with no such cover counts
as one unknown piece. Each worker runs the automaton once for each distinct word.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import Known, arrow_limits, buffers, distinct_words, lowered, pieces, words
from tallyproof.llm.tokens import default_path

NONE = -1


class Automaton:
    """`initial` pieces may start a word, `inner` ones continue it."""

    def __init__(self, initial: Iterable[bytes], inner: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]  # 0: before a word; 1: before an inner piece
        self.piece = [False, False]
        for root, vocabulary in ((0, initial), (1, inner)):
            for entry in vocabulary:
                at = root
                for byte in entry:
                    if byte not in self.next[at]:
                        self.next[at][byte] = len(self.next)
                        self.next.append({})
                        self.piece.append(False)
                    at = self.next[at][byte]
                if at > 1:
                    self.piece[at] = True
        self.fail, self.popped = [NONE] * len(self.next), [0] * len(self.next)
        row = [0, 1]
        while row:
            below = []
            for at in row:
                for byte, to in self.next[at].items():
                    if self.piece[to]:
                        self.fail[to], self.popped[to] = 1, 1
                    else:
                        back, count = self.fail[at], self.popped[at]
                        while back != NONE and byte not in self.next[back]:
                            count += self.popped[back]
                            back = self.fail[back]
                        if back != NONE:
                            self.fail[to], self.popped[to] = self.next[back][byte], count
                    below.append(to)
            row = below

    def count(self, word: bytes) -> int:
        if not word:
            return 0
        at = total = 0
        for byte in word:
            while byte not in self.next[at]:
                if self.fail[at] == NONE:
                    return 1
                total += self.popped[at]
                at = self.fail[at]
            at = self.next[at][byte]
        while at != 1:
            if self.fail[at] == NONE:
                return 1
            total += self.popped[at]
            at = self.fail[at]
        return total


def byte_pieces(path: str) -> list[bytes]:
    """The vocabulary of a byte-level BPE file as byte strings, word ends cut off."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    out = set()
    for entry in json.load(open(path, encoding="utf-8"))["model"]["vocab"]:
        entry = entry.removesuffix("</w>")
        if entry and all(c in chars for c in entry):
            out.add(bytes(chars[c] for c in entry))
    return sorted(out)


class Counter:
    def __init__(self, path: str):
        vocabulary = byte_pieces(path)
        self.automaton = Automaton(vocabulary, vocabulary)
        self.known, self.counts = Known(), np.empty(0, np.int64)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and pieces of each text."""
        data = lowered(data)
        hashes, starts, ends, first = words(data, offsets, lower=False)
        if not len(hashes):
            return np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
        where, kind = distinct_words(data, hashes, starts, ends)
        at, new, anew = self.known.numbers(data, hashes[where], starts[where], ends[where])
        if len(new):
            raw = data.tobytes()
            fresh = np.array([self.automaton.count(raw[a:b]) for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)], np.int64)
            self.counts = fresh if anew else np.concatenate([self.counts, fresh])
        total = np.concatenate([[0], np.cumsum(self.counts[at][kind])])
        return np.diff(first), total[first[1:]] - total[first[:-1]]


_COUNTERS: dict[str, Counter] = {}


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            n, m = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, j in pieces(data, offsets, 2 << 20):
                part = offsets[i : j + 1]
                a, b = _COUNTERS[path].texts(data[part[0] : part[-1]], part - part[0])
                n.append(a)
                m.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n)), pa.array(np.concatenate(m))], ["id", "n_words", "n_pieces"])

    return run


def count_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """A row for each row: id, n_words, n_pieces. Words are runs without space, tab
    or line break, A-Z lowered, read as UTF-8 bytes. Null and empty texts have 0 of
    both; null and repeated ids and rows pass through; an empty table gives an
    empty one; other columns are not looked at."""
    arrow_limits(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count(vocabulary or default_path()), f"id {kind}, n_words long, n_pieces long").withColumnRenamed("id", id_col)
