"""Media columns: audio features of 8-bit samples, as fixed-shape tensors with time spans.

A clip is a WAV file of unsigned 8-bit mono samples. `features` reads the stored bytes back and
computes; one clip is held at a time (some twenty bytes a sample), transforms are taken in blocks:

- polyphase resampling by a rational factor: one short filter per output phase, applied to windows of
  the input at the input's rate; nothing is computed that the decimation would drop;
- log-mel filterbank energies of overlapped Hann windows;
- hysteresis segmentation of frame energies: a segment begins above a high threshold and lasts while the
  energy stays above a low one; both lie a fixed number of decibels over the clip's quiet level.

Mel frames are cut into tensors of one fixed shape (FRAMES, MELS), zero-padded at the clip's end, and stored
as an Arrow `fixed_shape_tensor` column beside each tensor's start and end in seconds. In a DataFrame,
that table is one binary column (an Arrow IPC stream); `tensors` reads it again.

Work is per clip and in blocks of fixed size, so equal clips give equal values in whatever batch they come.

Nulls and odd rows: a null text is an empty payload, padded to 64 zero bytes; repeated rows give equal values;
an empty table an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import batch, table

PAD = 64
RATE, TARGET_RATE, UP, DOWN = 8000, 6000, 3, 4
#: Taps of each phase's filter.
TAPS = 16
WINDOW, HOP, FFT = 150, 60, 256
MELS, FRAMES = 32, 64
HIGH_DB, LOW_DB = 12.0, 6.0
#: Frames computed together.
BLOCK = 512


def encode_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono PCM; every byte value is a sample, so nothing is lost."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + payload + b"\0" * (n % 2)


def decode_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of what encode_wav wrote, found by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=4)
def phases(up: int, down: int, taps: int) -> np.ndarray:
    """The windowed-sinc low pass, cut into one filter for each of the `up` phases; row r weighs taps inputs, latest first."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    cutoff = 1.0 / max(up, down)
    low_pass = cutoff * np.sinc(cutoff * n) * np.hamming(up * taps) * up
    return np.ascontiguousarray(low_pass.reshape(taps, up).T.astype(np.float32))


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """ceil(len * up / down) samples; sample m is phase m * down % up at input m * down // up."""
    filters = phases(up, down, taps)
    out = np.zeros(-(-len(x) * up // down), dtype=np.float32)
    half = taps // 2
    padded = np.concatenate([np.zeros(taps - 1 - half, np.float32), x.astype(np.float32), np.zeros(half + down, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    for r in range(min(up, len(out))):
        phase, first = r * down % up, r * down // up
        count = len(range(r, len(out), up))
        weights = filters[phase][::-1]
        rows = windows[first : first + (count - 1) * down + 1 : down]
        total = np.zeros(count, np.float32)
        for k in range(taps):  # a sum in fixed order, equal in every batch
            total += rows[:, k] * weights[k]
        out[r::up] = total
    return out


@lru_cache(maxsize=4)
def mel_filters(rate: int, fft: int, mels: int) -> np.ndarray:
    """Triangles of equal width on the mel scale over the bins of the transform."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    bins = np.arange(fft // 2 + 1) * rate / fft
    rise = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.ascontiguousarray(np.maximum(0, np.minimum(rise, fall)).T.astype(np.float32))


_HANN = np.hanning(WINDOW + 1)[:-1].astype(np.float32)


def log_mel(x: np.ndarray, rate: int = TARGET_RATE) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames, MELS) and energies in dB (frames) of windows of WINDOW samples every HOP; the last window is zero-padded."""
    frames = max(1, -(-(len(x) - WINDOW) // HOP) + 1)
    padded = np.zeros((frames - 1) * HOP + WINDOW, np.float32)
    padded[: len(x)] = x[: len(padded)]
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    mel, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    filters = mel_filters(rate, FFT, MELS)
    for at in range(0, frames, BLOCK):
        part = windows[at : at + BLOCK] * _HANN
        spectrum = np.fft.rfft(part, FFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mel[at : at + len(part)] = np.log10(power @ filters + 1e-6)
        energy[at : at + len(part)] = 10 * np.log10((part * part).sum(axis=1) / WINDOW + 1e-9)
    return mel, energy


def segments(energy: np.ndarray, high_db: float = HIGH_DB, low_db: float = LOW_DB) -> list[tuple[int, int]]:
    """Half-open frame ranges: runs above the low threshold that anywhere pass the high one. The thresholds lie over the 10th percentile."""
    quiet = float(np.sort(energy)[len(energy) // 10])
    edge = np.diff((energy > quiet + low_db).astype(np.int8), prepend=0, append=0)
    runs = zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)
    return [(int(a), int(b)) for a, b in runs if energy[a:b].max() > quiet + high_db]


TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS), dim_names=("frame", "mel"))
TENSORS = pa.schema([("mel", TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64())])


def features(media: bytes) -> tuple[pa.RecordBatch, list[tuple[float, float]]]:
    """The clip's tensors with their time spans, and the spans of its loud segments in seconds."""
    rate, samples = decode_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x), rate * UP // DOWN)
    step = HOP * DOWN / (rate * UP)
    count = -(-len(mel) // FRAMES)
    padded = np.zeros((count * FRAMES, MELS), np.float32)
    padded[: len(mel)] = mel
    starts = np.arange(count) * FRAMES
    values = pa.FixedSizeListArray.from_arrays(pa.array(padded.ravel()), FRAMES * MELS)
    rows = pa.RecordBatch.from_arrays(
        [pa.ExtensionArray.from_storage(TENSOR, values), pa.array(starts * step), pa.array(np.minimum(starts + FRAMES, len(mel)) * step)], schema=TENSORS
    )
    return rows, [(a * step, b * step) for a, b in segments(energy)]


def to_ipc(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def tensors(stored: bytes) -> pa.Table:
    """The table that audio_features stored."""
    return pa.ipc.open_stream(stored).read_all()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 bytes, and these with zero bytes up to a positive multiple of PAD."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b"\0" * (max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def audio_features(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id_col, tensors (Arrow IPC stream of TENSORS), spans (start and end in seconds of loud segments) of each WAV; null media gives nulls."""
    kind = df.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                media = rows.column(1)[i].as_py()
                found = features(media) if media is not None else None
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).slice(i, 1),
                        pa.array([to_ipc(found[0]) if found else None], pa.binary()),
                        pa.array([[{"start_s": a, "end_s": b} for a, b in found[1]] if found else None], spans),
                    ],
                    names=["id", "tensors", "spans"],
                )

    return df.select(df[id_col].alias("id"), df[media_col].alias("media")).mapInArrow(run, f"id {kind}, tensors binary, spans array<struct<start_s: double, end_s: double>>").withColumnRenamed("id", id_col)


def summary(media: bytes) -> str:
    """What the features hold, in one line: shapes, loud spans in milliseconds, and a hash of the tensors' bytes."""
    rows, spans = features(media)
    values = rows.column(0).storage.values
    digest = hashlib.sha256(np.round(np.frombuffer(values.buffers()[1], np.float32, len(values)), 3).tobytes()).hexdigest()[:32]
    loud = ",".join(f"{a * 1000:.0f}-{b * 1000:.0f}" for a, b in spans)
    return f"tensors={rows.num_rows}x{FRAMES}x{MELS};end={rows.column(2)[-1].as_py():.3f};segments={len(spans)};loud={loud};mel={digest}"


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part = rows.slice(at, 256)
                made = [payload_of(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([encode_wav(p) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part = rows.slice(at, 256)
                media = [m.as_py() for m in part.column(2)]
                payload = [decode_wav(m)[1] for m in media]
                sha = lambda x: hashlib.sha256(x).hexdigest()
                yield batch(
                    out, doc_id=part.column(0), n_bytes=part.column(1), payload_bytes=[len(p) for p in payload], payload_sha256=[sha(p) for p in payload],
                    tail_crc32=[zlib.crc32(p[-PAD:]) for p in payload], media_bytes=[len(m) for m in media], media_sha256=[sha(m) for m in media], feature=[summary(m) for m in media],
                )

    stored = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")
    return stored.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


QUERIES = {"op1_audio_features": op1_audio_features}
ORACLE: dict[str, str] = {}
