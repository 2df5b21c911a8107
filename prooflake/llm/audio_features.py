"""Audio features of media columns: polyphase resampling, overlapped log-mel filterbanks, hysteresis energy segments.

A payload of 8-bit samples is stored losslessly as a mono WAV file; all features are computed from the samples that are read
back from it. Samples at RATE are resampled by UP / DOWN with a windowed-sinc polyphase filter, framed with overlap, turned
into log-mel bands and stored as Arrow fixed-shape tensors (CLIP_FRAMES x BANDS floats) with the time span of each. Frames
louder than HIGH dB under the loudest open a segment, which lasts until a frame falls under LOW dB.

A recording is worked on in pieces of PIECE_FRAMES frames, so a long one needs no more memory than a short one besides its
bytes. Rows: null and empty texts are 64 zero bytes; equal texts give equal values; repeated rows give equal rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import math
import wave
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prooflake.llm.common import runs, table, texts_of

RATE, UP, DOWN, TAPS = 8000, 3, 4, 12
FRAME, HOP, BANDS, CLIP_FRAMES, PIECE_FRAMES = 256, 128, 24, 64, 2048
HIGH, LOW = 6.0, 12.0
PAD = 64


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of PAD."""
    return text + bytes(max(PAD, -(-len(text) // PAD) * PAD) - len(text))


def store_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as media:
        media.setnchannels(1)
        media.setsampwidth(1)
        media.setframerate(RATE)
        media.writeframes(payload)
    return out.getvalue()


def read_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as media:
        if (media.getnchannels(), media.getsampwidth()) != (1, 1):
            raise ValueError("not mono 8-bit samples")
        return media.readframes(media.getnframes())


def resampling_filter() -> np.ndarray:
    """UP rows of TAPS coefficients, each of sum 1: row p weighs the samples around a place p / UP past the middle one, by a
    Hann-windowed sinc at the lower of both Nyquist rates."""
    place = np.arange(1 - TAPS // 2, TAPS // 2 + 1) - np.arange(UP)[:, None] / UP
    phases = np.sinc(place * UP / max(UP, DOWN)) * (0.5 + 0.5 * np.cos(np.pi * np.clip(place * 2 / (TAPS + 1), -1, 1)))
    return phases / phases.sum(1, keepdims=True)


def mel_filters() -> np.ndarray:
    """Triangles between equal steps of the mel scale, as (FRAME // 2 + 1) x BANDS."""
    top = RATE * UP / DOWN / 2
    mel = lambda hertz: 2595 * math.log10(1 + hertz / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(top), BANDS + 2) / 2595) - 1)
    bins = np.linspace(0, top, FRAME // 2 + 1)[:, None]
    rise, fall = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


@dataclass
class Features:
    logmel: np.ndarray  # frames x BANDS
    energy: np.ndarray  # dB of each frame
    segments: list[tuple[float, float]]
    seconds: float


class Extractor:
    def __init__(self) -> None:
        self.phases, self.filters, self.window = resampling_filter(), mel_filters(), np.hanning(FRAME)

    def resampled(self, samples: np.ndarray, first: int, last: int) -> np.ndarray:
        """Outputs first..last-1 (first a multiple of UP): output m lies DOWN / UP * m samples in, samples outside are silence."""
        out = np.zeros(last - first)
        for r in range(UP):
            count = len(range(first + r, last, UP))
            if not count:
                continue
            at, phase = divmod((first + r) * DOWN, UP)
            begin = at - TAPS // 2 + 1
            end = begin + (count - 1) * DOWN + TAPS
            piece = np.zeros(end - begin)
            lo, hi = max(0, begin), min(len(samples), end)
            if hi > lo:
                piece[lo - begin : hi - begin] = (samples[lo:hi].astype(np.float64) - 128) / 128
            views = np.lib.stride_tricks.sliding_window_view(piece, TAPS)[::DOWN]
            out[r::UP] = views @ self.phases[phase]
        return out

    def features(self, payload: bytes) -> Features:
        samples = np.frombuffer(payload, np.uint8)
        length = len(samples) * UP // DOWN
        frames = max(1, -(-(length - FRAME) // HOP) + 1)
        mels, energies = [], []
        for at in range(0, frames, PIECE_FRAMES):
            count = min(PIECE_FRAMES, frames - at)
            first = at * HOP
            skip = first % UP
            wave_piece = self.resampled(samples, first - skip, first + (count - 1) * HOP + FRAME)[skip:]
            framed = np.lib.stride_tricks.sliding_window_view(wave_piece, FRAME)[::HOP] * self.window
            power = np.abs(np.fft.rfft(framed, axis=1)) ** 2
            mels.append(np.log10(np.maximum(power @ self.filters, 1e-10)))
            energies.append(10 * np.log10(np.maximum((framed * framed).mean(1), 1e-10)))
        energy = np.concatenate(energies)
        return Features(np.concatenate(mels), energy, segments_of(energy), len(samples) / RATE)


def segments_of(energy: np.ndarray) -> list[tuple[float, float]]:
    """Spans in seconds: a frame within HIGH dB of the loudest opens one, the first more than LOW dB under it closes it."""
    loud, quiet = energy >= energy.max() - HIGH, energy < energy.max() - LOW
    event = np.where(loud, 1, np.where(quiet, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    state = np.where(last >= 0, event[last], -1) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], state, [False]]).astype(np.int8)))
    step = HOP * DOWN / UP / RATE
    return [(a * step, b * step) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]


def clip_tensors(logmel: np.ndarray) -> pa.RecordBatch:
    """start_s, end_s, frames (those that count) and a fixed-shape tensor of each clip; the last clip is filled up with the lowest value."""
    clips = -(-len(logmel) // CLIP_FRAMES)
    full = np.full((clips * CLIP_FRAMES, BANDS), logmel.min(), np.float32)
    full[: len(logmel)] = logmel
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(clips, CLIP_FRAMES, BANDS))
    step = HOP * DOWN / UP / RATE
    starts = np.arange(clips) * CLIP_FRAMES * step
    ends = np.minimum(starts + CLIP_FRAMES * step, ((len(logmel) - 1) * HOP + FRAME) * DOWN / UP / RATE)
    frames = np.minimum(CLIP_FRAMES, len(logmel) - np.arange(clips) * CLIP_FRAMES).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(starts), pa.array(ends), pa.array(frames), tensor], names=["start_s", "end_s", "frames", "logmel"])


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(stored: bytes) -> pa.RecordBatch:
    """The inverse of to_ipc: tensors come back as a FixedShapeTensorArray."""
    with pa.ipc.open_stream(stored) as reader:
        return reader.read_next_batch()


def summary(clips: pa.RecordBatch, segments: list[tuple[float, float]], loudest: float) -> str:
    """A short text of stored features: frames, clips, segments, their seconds, and the mean and deviation of each band over all frames."""
    frames = sum(clips.column("frames").to_pylist())
    logmel = clips.column("logmel").to_numpy_ndarray().reshape(-1, BANDS)[:frames].astype(np.float64)
    bands = ",".join(f"{m + 0.0:.2f}~{s + 0.0:.2f}" for m, s in zip(logmel.mean(0).round(2), logmel.std(0).round(2), strict=True))
    voiced = sum(b - a for a, b in segments)
    return f"frames={frames};clips={clips.num_rows};segments={len(segments)};voiced={voiced:.3f};loudest={round(loudest, 2) + 0.0:.2f};bands={bands}"


SPANS = "array<struct<start_s double, end_s double>>"


def media_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (WAV), tensors (Arrow IPC of clip_tensors), segments, loudest (dB), seconds, of every row; no shuffle."""
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    names = ["doc_id", "n_bytes", "media", "tensors", "segments", "loudest", "seconds"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor()
        for batch in runs(batches, 2 << 20):
            texts = texts_of(batch.column(1))
            media = [store_wav(padded(t)) for t in texts]
            found = [extract.features(read_wav(m)) for m in media]
            columns = [
                pa.array(map(len, texts), pa.int64()),
                pa.array(media, pa.binary()),
                pa.array([to_ipc(clip_tensors(f.logmel)) for f in found], pa.binary()),
                pa.array([[{"start_s": a, "end_s": b} for a, b in f.segments] for f in found], span),
                pa.array([float(f.energy.max()) for f in found], pa.float64()),
                pa.array([f.seconds for f in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, f"doc_id long, n_bytes long, media binary, tensors binary, segments {SPANS}, loudest double, seconds double")


def media_digests(features: DataFrame) -> DataFrame:
    """Digests of what media_features stored: the payload as it is read back from the WAV file, the features as they are read back from the
    tensors and segments."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 8 << 20):
            rows = []
            for n, media, tensors, segments, loudest in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                back = read_wav(media)
                feature = summary(from_ipc(tensors), [(s["start_s"], s["end_s"]) for s in segments], loudest)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    columns = features.select("doc_id", "n_bytes", "media", "tensors", "segments", "loudest")
    return columns.mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(media_features(table(spark, sf_dir, "documents")))
