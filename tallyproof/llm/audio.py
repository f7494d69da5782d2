"""Media columns: 8-bit PCM clips, and log-mel features as fixed-shape tensors.

Clips are stored as WAV bytes in Arrow files in the shared folder and read back
from there. Features: polyphase resampling, overlapped frames, log-mel
filterbanks, and segments by energy with hysteresis. A clip's features are cut
into windows of a fixed shape (frames x bands), each with its time span, and go
into a column of Arrow's fixed-shape tensor type.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import arrow_limits, buffers, filesystem, one_each, workspace, written

PAD = 64
RATE = 8000


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono PCM; each byte is one sample."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def wav_payload(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate; passes over chunks other than fmt and data."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV clip")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % PAD or (0 if raw else PAD))


@dataclass(frozen=True)
class Settings:
    up: int = 1
    down: int = 2
    taps: int = 8  # on each side, at the lower rate
    frame: int = 256
    hop: int = 128
    bands: int = 16
    window: int = 64  # frames of a tensor
    on_db: float = 0.5  # above the clip's median energy
    off_db: float = 0.0
    block: int = 1 << 20  # samples worked on at a time


def lowpass(up: int, down: int, taps: int) -> np.ndarray:
    """A Hamming-windowed sinc for a change of rate by up / down."""
    wide = max(up, down)
    n = np.arange(-taps * wide, taps * wide + 1)
    h = np.sinc(n / wide) / wide * np.hamming(len(n))
    return (h / h.sum() * up).astype(np.float64)


def resample(x: np.ndarray, up: int, down: int, h: np.ndarray) -> np.ndarray:
    """Polyphase: output m is the sum over k of h[k * up + phase] x[..]; only the
    samples that are kept are computed. Output 0 is centred on input 0."""
    half = len(h) // 2
    n = -(-len(x) * up // down)
    out = np.zeros(n)
    # outputs with equal (m * down + half) % up share a set of taps
    for r in range(up):
        m = np.arange(r, n, up)
        if not len(m):
            break
        t = m * down + half
        phase = int(t[0] % up)
        taps = h[phase::up]
        last = t // up  # input under tap 0; it steps by `down` from output to output of this phase
        pad = np.concatenate([np.zeros(len(taps) - 1), x, np.zeros(max(0, int(last[-1]) + 1 - len(x)))])
        view = np.lib.stride_tricks.sliding_window_view(pad, len(taps))[int(last[0]) : int(last[-1]) + 1 : down]
        total = np.zeros(len(m))
        for k in range(len(taps)):  # tap k falls on input last - k
            total += taps[k] * view[:, len(taps) - 1 - k]
        out[r::up] = total
    return out


def mel_bank(bands: int, frame: int, rate: float) -> np.ndarray:
    """Triangles evenly spaced on the mel scale; rows are FFT bins."""
    to = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to(20.0), to(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))


_KEPT: dict[tuple, tuple] = {}


def log_mel(payload: bytes, rate: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(frames x bands) log-mel and the energy in dB of each frame; always a frame.
    Long clips go through in blocks: of the resampled signal only a block and a
    frame's overlap are held. What comes out takes about a byte for each sample."""
    key = (rate, s)
    if key not in _KEPT:
        _KEPT[key] = (lowpass(s.up, s.down, s.taps), mel_bank(s.bands, s.frame, rate * s.up / s.down), np.hanning(s.frame + 1)[:-1])
    h, bank, taper = _KEPT[key]
    x = np.frombuffer(payload, np.uint8)
    margin = (len(h) // s.up + 1) // s.down * s.down + s.down
    block = max(s.down, s.block // s.down * s.down)
    mels, energies, rest = [], [], np.empty(0)

    def frames(y: np.ndarray, n: int) -> None:
        view = np.lib.stride_tricks.sliding_window_view(y, s.frame)[:: s.hop][:n]
        for a in range(0, n, 2048):
            power = np.fft.rfft(view[a : a + 2048] * taper, axis=1)
            power = power.real**2 + power.imag**2
            energies.append(10 * np.log10(power.sum(axis=1) + 1e-10))
            total = np.zeros((len(power), s.bands))
            for b in range(s.bands):  # sums whose order doesn't hang on how many rows there are
                total[:, b] = (power * bank[:, b]).sum(axis=1)
            mels.append(np.log(total + 1e-10))

    for a in range(0, max(len(x), 1), block):
        # a multiple of `down` in front keeps the phase; what the margins give is cut off
        lead = min(a, margin)
        piece = (x[a - lead : a + block + margin].astype(np.float64) - 128) / 128
        y = resample(piece, s.up, s.down, h)[lead * s.up // s.down :][: -(-min(block, len(x) - a) * s.up // s.down)]
        rest = np.concatenate([rest, y])
        n = max(0, 1 + (len(rest) - s.frame) // s.hop)
        if n:
            frames(rest, n)
            rest = rest[n * s.hop :]
    if not mels:
        frames(np.concatenate([rest, np.zeros(s.frame - len(rest))]), 1)
    return np.concatenate(mels), np.concatenate(energies)


def hysteresis(energy: np.ndarray, on: float, off: float) -> list[tuple[int, int]]:
    """Runs of frames that begin at `on` or more and end below `off`."""
    event = np.where(energy >= on, 1, np.where(energy < off, -1, 0))
    at = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    active = (at >= 0) & (event[at] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], active.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def features(payload: bytes, rate: int = RATE, s: Settings = Settings()) -> dict:
    """tensors (windows x frames x bands, float32, rounded to 1/1024, zeros behind
    the end), their time spans and the segments in ms."""
    mel, energy = log_mel(payload, rate, s)
    energy = np.round(energy, 6)
    mid = float(np.median(energy))
    ms = 1000 * s.down / (rate * s.up)
    windows = -(-len(mel) // s.window)
    full = np.zeros((windows * s.window, s.bands), np.float32)
    full[: len(mel)] = np.round(mel * 1024) / 1024
    spans = [(w * s.window * s.hop * ms, ((min(len(mel), (w + 1) * s.window) - 1) * s.hop + s.frame) * ms) for w in range(windows)]
    segments = [(a * s.hop * ms, ((b - 1) * s.hop + s.frame) * ms) for a, b in hysteresis(energy, mid + s.on_db, mid + s.off_db)]
    return {"tensors": full.reshape(windows, s.window, s.bands), "spans": spans, "segments": segments, "frames": len(mel)}


def _store(path: str, rate: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        name = f"clips-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arrow"
        writer = None
        schema = pa.schema([("id", kind), ("n_bytes", pa.int64()), ("media", pa.binary())])
        for batch in batches:
            if writer is None:
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                writer = pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3)))
            data, offsets = buffers(batch.column(1))
            at = 0
            for at, to in _runs(offsets):
                raw = [data[a:b].tobytes() for a, b in zip(offsets[at:to].tolist(), offsets[at + 1 : to + 1].tolist(), strict=True)]
                writer.write_batch(pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array([len(r) for r in raw], pa.int64()), pa.array([wav(padded(r), rate) for r in raw], pa.binary())], schema=schema))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    return run


def _runs(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    from tallyproof.llm.common import pieces

    return pieces(offsets, offsets, most)


def store_clips(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, rate: int = RATE) -> tuple[str, DataFrame]:
    """Writes each text's bytes as a clip; gives the folder and its file names."""
    spark = df.sparkSession
    arrow_limits(spark)
    path = path or workspace(spark, "clips")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(df.schema[id_col].dataType)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return path, written(rows.mapInArrow(_store(path, rate, kind), "file string"), "clip-files")


def tensor_type(s: Settings) -> pa.FixedShapeTensorType:
    return pa.fixed_shape_tensor(pa.float32(), [s.window, s.bands], dim_names=["frame", "band"])


def _extract(path: str, to: str, s: Settings, kind: pa.DataType):
    digest_type = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string()}
    span = pa.struct([("from_ms", pa.float64()), ("to_ms", pa.float64())])
    schema = pa.schema([("id", kind), *digest_type.items(), ("window", pa.int32()), ("windows", pa.int32()), ("frames", pa.int64()), ("span", span), ("segments", pa.list_(span)), ("log_mel", tensor_type(s))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        fs2, folder2 = filesystem(to)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                name = f"features-{uuid.uuid4().hex}.arrow"
                fs2.create_dir(folder2, recursive=True)
                with fs.open_input_stream(f"{folder}/{file}", compression=None) as source, fs2.open_output_stream(f"{folder2}/{name}", compression=None) as out:
                    with pa.ipc.open_stream(source) as clips, pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as writer:
                        for part in clips:
                            cols: list[list] = [[] for _ in schema]
                            tensors, ids = [], []
                            for row, (n, media) in enumerate(zip(part.column("n_bytes").to_pylist(), part.column("media").to_pylist(), strict=True)):
                                payload, rate = wav_payload(media)
                                f = features(payload, rate, s)
                                digest = [n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest()]
                                for w, (a, b) in enumerate(f["spans"]):
                                    ids.append(row)
                                    own = [*(digest if w == 0 else [None] * len(digest)), w, len(f["spans"]), f["frames"], {"from_ms": a, "to_ms": b}, [{"from_ms": x, "to_ms": y} for x, y in f["segments"]] if w == 0 else []]
                                    for c, v in zip(cols[1:], own, strict=False):
                                        c.append(v)
                                tensors.append(f["tensors"])
                            arrays = [part.column("id").take(pa.array(ids, pa.int64()))]
                            arrays += [pa.array(c, t.type) for c, t in zip(cols[1:-1], list(schema)[1:-1], strict=True)]
                            flat = np.concatenate(tensors) if tensors else np.empty((0, s.window, s.bands), np.float32)
                            arrays.append(pa.ExtensionArray.from_storage(tensor_type(s), pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), s.window * s.bands)))
                            writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=schema))
                yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    return run


def extract_features(spark, path: str, files: DataFrame, kind: pa.DataType, settings: Settings = Settings(), to: str | None = None) -> tuple[str, DataFrame]:
    """Reads the stored clips and writes a row for each window: a fixed-shape
    tensor, its time span, and (with window 0 alone) the clip's segments and digests."""
    to = to or workspace(spark, "features")
    return to, written(one_each(files).mapInArrow(_extract(path, to, settings, kind), "file string"), "feature-files")


def read_tensors(fs, name: str) -> Iterator[pa.RecordBatch]:
    with fs.open_input_stream(name, compression=None) as source, pa.ipc.open_stream(source) as rows:
        yield from rows


def _digests(path: str, kind: pa.DataType):
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                for rows in read_tensors(fs, f"{folder}/{file}"):
                    first = np.flatnonzero(rows.column("window").to_numpy() == 0)
                    storage = rows.column("log_mel").storage
                    flat = storage.flatten().to_numpy().reshape(len(rows), -1)
                    ends = np.append(first[1:], len(rows))
                    text = []
                    for a, b, segs, frames in zip(first.tolist(), ends.tolist(), rows.column("segments").take(pa.array(first)).to_pylist(), rows.column("frames").take(pa.array(first)).to_pylist(), strict=True):
                        body = hashlib.sha256(flat[a:b].tobytes() + repr([(x["from_ms"], x["to_ms"]) for x in segs]).encode()).hexdigest()
                        text.append(f"frames={frames};windows={b - a};segments={len(segs)};sha256={body}")
                    kept = [rows.column(n).take(pa.array(first)) for n in names]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(text)], [*names, "feature"])

    return run


def read_digests(path: str, files: DataFrame, kind: str, arrow_kind: pa.DataType, id_col: str) -> DataFrame:
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return one_each(files).mapInArrow(_digests(path, arrow_kind), schema).withColumnRenamed("id", id_col)


def audio_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Stores, reads back, computes, stores the features, and gives per row: id,
    n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature.

    The payload is the text in UTF-8 with zero bytes up to a multiple of 64, 64 of
    them for an empty or null text. Null and repeated ids and repeated rows are
    clips of their own; equal texts give equal values. An empty table stores
    nothing and gives no row. Other columns are not looked at.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[id_col].dataType
    path, files = store_clips(df, id_col, text_col)
    to, made = extract_features(df.sparkSession, path, files, to_arrow_type(kind), settings)
    return read_digests(to, made, kind.simpleString(), to_arrow_type(kind), id_col)


AUDIO_RATE = RATE
