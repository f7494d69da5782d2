"""What the operators of this folder share: the shared work folder, tables
written to cut lineage, and whole-column text hashing on Arrow buffers."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDERS: dict[str, str] = {}
_MADE: list[str] = []
#: Rows and bytes of the Arrow batches that Python workers get.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Rows up to which a table counts as small enough to broadcast, after counting it.
BROADCAST_ROWS = 200_000


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder of `spark.checkpoint.dir`.

    Only where that setting is absent and the session is a local one is a
    temporary folder of this machine made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_FOLDERS:
            _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="tallyproof-")
            atexit.register(shutil.rmtree, _OWN_FOLDERS[app], ignore_errors=True)
            spark.sparkContext.setCheckpointDir(_OWN_FOLDERS[app])
        base = _OWN_FOLDERS[app]
    _MADE.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def release(spark: SparkSession) -> int:
    """Deletes all folders that `workspace` gave out so far, and says how many there
    were. Only for when no DataFrame that reads them is needed any more."""
    made = list(_MADE)
    _MADE.clear()
    for folder in made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(made)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: lineage ends here."""
    spark = df.sparkSession
    path = workspace(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_limits(spark: SparkSession) -> None:
    """Bounds the Arrow batches, so that a run of long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def one_each(files: DataFrame, key: str = "file") -> DataFrame:
    """A task for each file: ranges of distinct names split evenly, hashes don't."""
    return files.repartitionByRange(max(1, files.count()), key)


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, to be broadcast if a count shows it small; a plain join side beyond."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


_MUL = np.uint64(0xD6E8FEB86659FD93)
_KEY = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
#: Bytes up to which words are worked on all at once, eight by eight; longer ones are rare.
_SHORT = 64


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A keyed 64-bit hash of each word: every eight bytes are mixed in, beginning
    with the length. Of words of up to eight bytes and equal length no two collide;
    words longer than `_SHORT` bytes go through BLAKE2."""
    eight, size = _eights(data), ends - starts
    out = mix(size.astype(np.uint64) + _KEY)
    left = np.flatnonzero(size <= _SHORT)
    for at in range(0, _SHORT, 8):
        if not len(left):
            break
        a = starts[left] + at
        rest = ends[left] - a
        out[left] = mix(out[left] * _MUL ^ eight[a] & _MASKS[np.minimum(rest, 8)])
        left = left[rest > 8]
    for k in np.flatnonzero(size > _SHORT).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, key=b"words").digest(), "little")
    return out


def equal_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, starts2: np.ndarray, ends2: np.ndarray) -> np.ndarray:
    """For each pair of words, the second ones in `others`, whether their bytes agree."""
    same = ends - starts == ends2 - starts2
    left = np.flatnonzero(same)
    one, two = _eights(data), _eights(others) if others is not data else None
    two = one if two is None else two
    for at in range(0, _SHORT, 8):
        if not len(left):
            return same
        a, b = starts[left] + at, starts2[left] + at
        rest = ends[left] - a
        ok = ((one[a] ^ two[b]) & _MASKS[np.minimum(rest, 8)]) == 0
        same[left[~ok]] = False
        left = left[ok & (rest > 8)]
    for k in left.tolist():
        same[k] = np.array_equal(data[starts[k] : ends[k]], others[starts2[k] : ends2[k]])
    return same


def distinct_words(data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words, by their bytes: the place of one word of each kind, and the kind
    of each word. The hashes only find what may be equal; of words that share a hash
    and differ, each gets a kind of its own."""
    _, where, kind = np.unique(hashes, return_index=True, return_inverse=True)
    first = where[kind]
    again = np.flatnonzero(first != np.arange(len(first)))
    ok = equal_bytes(data, starts[again], ends[again], data, starts[first[again]], ends[first[again]])
    if not ok.all():
        more: dict[bytes, int] = {}
        extra = []
        for k in again[~ok].tolist():
            word = data[starts[k] : ends[k]].tobytes()
            if word not in more:
                more[word] = len(where) + len(more)
                extra.append(k)
            kind[k] = more[word]
        where = np.concatenate([where, extra])
    return where, kind


class Known:
    """Numbers for words, by their bytes, in the order in which they are first met;
    beyond its bounds the store starts anew."""

    def __init__(self, most: int = 1_500_000, most_bytes: int = 128 << 20):
        self.most, self.most_bytes = most, most_bytes
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.number = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted by hash
        self.data, self.ends = np.empty(0, np.uint8), np.zeros(1, np.int64)  # by number
        self.clash: dict[bytes, int] = {}  # words whose hash another word has taken

    def numbers(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """A number for each of these distinct words, the indices of those that are
        new, and whether the store began anew (then all are new)."""
        n = len(hashes)
        out = np.full(n, -1, np.int64)
        taken = np.zeros(n, bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            number = self.number[at[hit]]
            same = equal_bytes(data, starts[hit], ends[hit], self.data, self.ends[number], self.ends[number + 1])
            out[hit[same]] = number[same]
            taken[hit[~same]] = True
            for k in hit[~same].tolist():
                out[k] = self.clash.get(data[starts[k] : ends[k]].tobytes(), -1)
        new = np.flatnonzero(out < 0)
        if len(new) and len(self.ends) > 1 and (len(self.ends) + len(new) > self.most or len(self.data) > self.most_bytes):
            self._clear()
            return *self.numbers(data, hashes, starts, ends)[:2], True
        if len(new):
            out[new] = len(self.ends) - 1 + np.arange(len(new))
            size = (ends - starts)[new]
            index = np.repeat(starts[new] - np.cumsum(size) + size, size) + np.arange(size.sum())
            self.data = np.concatenate([self.data, data[index]])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
            _, first = np.unique(hashes[new], return_index=True)
            own = np.zeros(len(new), bool)
            own[first] = True
            own &= ~taken[new]
            for k in new[~own].tolist():
                self.clash[data[starts[k] : ends[k]].tobytes()] = int(out[k])
            fresh = new[own][np.argsort(hashes[new[own]])]
            to = np.searchsorted(self.hashes, hashes[fresh])
            self.hashes, self.number = np.insert(self.hashes, to, hashes[fresh]), np.insert(self.number, to, out[fresh])
        return out, new, False


#: Byte classes: white space is space and tab to carriage return; A-Z are lowered.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts that lie end to end: hash, start, end (bytes), and for
    each text the index of its first word, with the total behind."""
    n = len(offsets) - 1
    if not len(data):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, np.zeros(n + 1, np.int64)
    inside = ~_SPACE[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    start[first] = inside[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    hashes = hashed(lowered(data) if lower else data, starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs of about `most` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Only the hashes (A-Z lowered), and each text's first; a long text goes through
    in blocks cut at white space, so that memory stays bounded by the words themselves."""
    if len(offsets) != 2 or len(data) <= most:
        hashes, _, _, first = words(data, offsets)
        return hashes, first
    out, at = [], 0
    while at < len(data):
        to = min(at + most, len(data))
        while to < len(data) and not _SPACE[data[to]]:
            to += 1
        out.append(words(data[at:to], np.array([0, to - at]))[0])
        at = to
    hashes = np.concatenate(out)
    return hashes, np.array([0, len(hashes)])


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its distinct k-word shingles, sorted; with fewer words the
    whole sequence is the one shingle; without words the set is empty."""
    total = len(hashes)
    n = max(total - k + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled = rolled * _MUL + hashes[j : j + n]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for w in hashes[a:b]:
                x = mix(x * _MUL + w)
            out.append(x)
        else:
            out.append(np.empty(0, np.uint64))
    return out
