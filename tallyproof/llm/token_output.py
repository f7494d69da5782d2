"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds one frame for each document, then a skippable frame with an Arrow
index (id and number of ids of each document), then the seek table of the
zstandard seekable format: for each frame its compressed size, its size, and the
low 32 bits of the XXH64 of its content. A reader opens the tail and
decompresses only the documents asked for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.llm.common import arrow_limits, filesystem, one_each, workspace, written
from tallyproof.llm.tokens import default_path, encoder

INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class Writer:
    def __init__(self, out, width, level: int = 3):
        self.out, self.width = out, np.dtype(width).newbyteorder("<")
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.counts: list[int] = []

    def add(self, ids: np.ndarray) -> None:
        raw = ids.astype(self.width).tobytes()
        frame = self.zstd.compress(raw)
        self.out.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.counts.append(len(ids))

    def close(self, doc_ids: pa.Array) -> None:
        table = pa.table({"id": doc_ids, "n": pa.array(self.counts, pa.int64())}).replace_schema_metadata({"width": str(self.width.itemsize)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        index = sink.getvalue().to_pybytes()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.entries.append((len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        body = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(body)) + body)


class Reader:
    """Random access by position in the file; checks each frame it opens."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        n, descriptor, magic = struct.unpack("<IBI", source.read_at(9, end - 9))
        if magic != FOOTER_MAGIC or not descriptor & 0x80:
            raise ValueError("no seek table with checksums at the end")
        entries = np.frombuffer(source.read_at(12 * n, end - 9 - 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(entries[:, 0])])
        with pa.ipc.open_stream(source.read_at(int(entries[-1, 0]) - 8, int(at[n - 1]) + 8)) as r:
            table = r.read_all()
        self.index, self.entries, self.at = table, entries[:-1], at[:-1]
        self.width = np.dtype(f"<u{table.schema.metadata[b'width'].decode()}")
        self.zstd = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.entries)

    def ids(self, k: int) -> np.ndarray:
        size, full, check = (int(v) for v in self.entries[k])
        raw = self.zstd.decompress(self.source.read_at(size, int(self.at[k])), max_output_size=full)
        if len(raw) != full or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, self.width).astype("<u4")


def _write(path: str, tokenizer: str, end_id: int | None, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        tail = np.array([] if end_id is None else [end_id], enc.width)
        fs, folder = filesystem(path)
        name = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}.zst"  # a repeated attempt writes a file of its own
        writer = out = None
        doc_ids = []
        for batch in batches:
            if writer is None:
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(name, compression=None)
                writer = Writer(out, enc.width, level)
            doc_ids.append(batch.column(0))
            for ids in enc.column(batch.column(1)):
                writer.add(np.concatenate([ids, tail]))
        if writer is not None:
            writer.close(pa.chunked_array(doc_ids).combine_chunks())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name.rpartition("/")[2]]), pa.array([len(writer.counts)], pa.int64()), pa.array([sum(writer.counts)], pa.int64())], ["part", "file", "docs", "ids"])

    return run


def write_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, tokenizer: str | None = None, path: str | None = None, level: int = 3) -> tuple[str, DataFrame]:
    """Writes the files in ascending id order (null ids first; equal ids by a hash
    of their text); gives the folder and the table of files (part, file, docs, ids,
    start), start being the ids in all files before."""
    spark = df.sparkSession
    arrow_limits(spark)
    path = path or workspace(spark, "tokens")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keys = [F.col("id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    files = written(rows.mapInArrow(_write(path, tokenizer or default_path(), end_id, level), "part long, file string, docs long, ids long"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return path, files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


def _read(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(f"{folder}/{file}") as source:
                    reader = Reader(source)
                    n, crc = [], []
                    for k in range(len(reader)):
                        ids = reader.ids(k)
                        n.append(len(ids))
                        crc.append(zlib.crc32(ids.tobytes()))
                    first = start + np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([reader.index.column("id").combine_chunks(), pa.array(first), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return run


def read_digests(spark, path: str, files: DataFrame, kind: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """From the files: id, start, n_tokens, ids_crc32 of each document."""
    return one_each(files.select("file", "start")).mapInArrow(_read(path), f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_files(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Writes and reads back. A null text is empty and has the end id alone; null
    and repeated ids and repeated rows are documents of their own; an empty table
    writes no file and gives no row; other columns are not looked at."""
    path, files = write_tokens(df, id_col, text_col, **kw)
    return read_digests(df.sparkSession, path, files, df.schema[id_col].dataType.simpleString(), id_col)
