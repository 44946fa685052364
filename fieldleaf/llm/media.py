"""Media columns: sound stored as 8-bit samples, and its features as fixed-shape tensors.

``to_media`` turns bytes into WAV files (mono, 8 bits) and, from the files, computes their
features: polyphase resampling (3 samples for every 4), overlapping frames, a log-mel
filterbank, and voiced stretches by energy with hysteresis. Features are stored beside the
file as tiles: tensors of ``TILE`` frames by ``MELS`` bands, in hundredths, with their time
span and the voiced frames. ``digests`` describes what is read back of both; ``tensors``
gives one row for each tile, which ``as_tensors`` casts to Arrow's fixed-shape tensor type.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldleaf.llm.common import stored

RATE, UP, DOWN, TAPS = 8000, 3, 4, 16
FRAME, HOP, MELS, TILE = 256, 128, 32, 16
BLOCK = 1 << 20  # samples that are worked on at a time


def wav(samples: bytes, rate: int = RATE) -> bytes:
    pad = b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + pad


def samples_of(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate of an 8-bit mono WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, RATE
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono samples")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@cache
def filters() -> np.ndarray:
    """A windowed sinc low-pass, as one row of taps for each output phase."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    return (h / h.sum() * UP).reshape(TAPS, UP).T[:, ::-1].copy()


@cache
def mel_bank(rate: int) -> np.ndarray:
    """Triangular bands evenly spaced on the mel scale, (FRAME / 2 + 1) x MELS."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    left, mid, right = edges[None, :-2], edges[None, 1:-1], edges[None, 2:]
    return np.maximum(0, np.minimum((f - left) / (mid - left), (right - f) / (right - mid)))


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase resampling by UP / DOWN of samples; each output sample uses only its phase's taps."""
    n = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS - 1), x, np.zeros(DOWN)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n)
    for m in range(min(UP, n)):  # outputs m, m + UP, ... share a phase and start DOWN inputs apart
        at, phase = divmod(m * DOWN, UP)
        own = out[m::UP]
        own[:] = windows[at::DOWN][: len(own)] @ filters()[phase]
    return out


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows and energies in dB of overlapping frames; the last frame is padded with zeros."""
    frames = max(1, -(-max(len(x) - FRAME, 0) // HOP) + 1)
    x = np.concatenate([x, np.zeros(max(0, (frames - 1) * HOP + FRAME - len(x)))])
    rows, energy = [], []
    for at in range(0, frames, BLOCK // HOP):
        f = np.lib.stride_tricks.sliding_window_view(x[at * HOP : (min(at + BLOCK // HOP, frames) - 1) * HOP + FRAME], FRAME)[::HOP]
        rows.append(np.log10(np.maximum(np.abs(np.fft.rfft(f * np.hanning(FRAME), axis=1)) ** 2 @ mel_bank(rate), 1e-10)))
        energy.append(10 * np.log10(np.maximum((f * f).mean(axis=1), 1e-10)))
    return np.concatenate(rows).astype(np.float32), np.concatenate(energy)


def voiced(energy: np.ndarray, above: float = 1.0, below: float = 0.0) -> np.ndarray:
    """(start, end) of stretches that begin over the median + ``above`` dB and end under the median + ``below`` dB."""
    level = np.median(energy)
    turn = np.where(energy > level + above, 1, np.where(energy < level + below, -1, 0))
    last = np.maximum.accumulate(np.where(turn != 0, np.arange(len(turn)), -1))
    on = np.where(last >= 0, turn[last] == 1, False)
    edges = np.flatnonzero(np.diff(np.r_[0, on.astype(np.int8), 0]))
    return edges.reshape(-1, 2)


def analyse(media: bytes) -> tuple[bytes, np.ndarray, np.ndarray, int]:
    """Samples, log-mel rows, voiced stretches in frames, and the rate of the rows' time axis."""
    raw, rate = samples_of(media)
    x = resample((np.frombuffer(raw, np.uint8).astype(float) - 128) / 128)
    rows, energy = log_mel(x, rate * UP // DOWN)
    return raw, rows, voiced(energy), rate * UP // DOWN


TILES = "array<struct<start_s: double, end_s: double, frames: smallint, voiced: int, log_mel: array<smallint>>>"


def tiles_of(media: bytes) -> list[np.ndarray]:
    """A file's tiles as columns: start and end in seconds, how many frames are its own (the rest of the last tile repeats its least value), a bit for each voiced frame, and the values in hundredths."""
    _, rows, spans, rate = analyse(media)
    n = -(-len(rows) // TILE)
    full = np.full((n * TILE, MELS), rows.min(), np.float32)
    full[: len(rows)] = rows
    on = np.zeros(n * TILE, np.int64)
    for s, e in spans:
        on[s:e] = 1
    at = np.arange(n)
    frames = np.minimum(TILE, len(rows) - at * TILE)
    return [at * TILE * HOP / rate, ((at * TILE + frames - 1) * HOP + FRAME) / rate, frames.astype(np.int16), (on.reshape(n, TILE) @ (1 << np.arange(TILE))).astype(np.int32), np.round(full * 100).astype(np.int16).reshape(n, TILE * MELS)]


def to_media(docs: DataFrame, unit: int = 192) -> DataFrame:
    """(doc_id, n_bytes, media, tiles): each text's UTF-8 bytes, filled with spaces to a positive multiple of ``unit``, as a WAV file with its features. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t.as_py() or "").encode() for t in b.column(1)]
            media = [wav(x.ljust(max(1, -(-len(x) // unit)) * unit)) for x in raw]
            made = [tiles_of(m) for m in media]
            cols = [np.concatenate([m[k] for m in made]) if made else np.zeros((0, TILE * MELS) if k == 4 else 0) for k in range(5)]
            inner = pa.ListArray.from_arrays(np.arange(len(cols[0]) + 1, dtype=np.int32) * TILE * MELS, pa.array(cols[4].ravel(), pa.int16()))
            one = pa.StructArray.from_arrays([pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int16()), pa.array(cols[3], pa.int32()), inner], ["start_s", "end_s", "frames", "voiced", "log_mel"])
            ends = np.r_[0, np.cumsum([len(m[0]) for m in made])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary()), pa.ListArray.from_arrays(ends, one)], ["doc_id", "n_bytes", "media", "tiles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n_bytes long, media binary, tiles {TILES}")


def tensors(media: DataFrame) -> DataFrame:
    """(doc_id, tile, start_s, end_s, frames, voiced, log_mel): one row for each stored tile."""
    return media.select("doc_id", F.posexplode("tiles").alias("tile", "t")).select("doc_id", "tile", "t.*")


def as_tensors(table: pa.Table) -> pa.Table:
    """The same Arrow table with log_mel as fixed-shape tensors."""
    shape = pa.fixed_shape_tensor(pa.int16(), (TILE, MELS))
    flat = table["log_mel"].combine_chunks().cast(pa.list_(pa.int16(), TILE * MELS))
    return table.set_column(table.schema.get_field_index("log_mel"), "log_mel", pa.ExtensionArray.from_storage(shape, flat))


def digests(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_frames, n_voiced, voiced_s) of stored media: the bytes and the tensors as they are read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            listed = b.column(3)
            edges, tile = listed.offsets.to_numpy() - listed.offsets[0].as_py(), listed.flatten()
            frames, voiced = tile.field("frames").to_numpy(), tile.field("voiced").to_numpy()
            values = tile.field("log_mel").flatten().to_numpy().reshape(-1, MELS)
            for k, value in enumerate(b.column(2)):
                m = value.as_py()
                raw, rate = samples_of(m)
                own = slice(edges[k], edges[k + 1])
                n = int(frames[own].sum())
                rows = values[edges[k] * TILE : edges[k + 1] * TILE][:n]
                on = (voiced[own][:, None] >> np.arange(TILE) & 1).ravel()[:n]
                spans, active = int((np.diff(np.r_[0, on]) == 1).sum()), int(on.sum())
                means = ",".join(f"{x / 100:.2f}" for x in rows.mean(axis=0, dtype=float).reshape(8, -1).mean(axis=1))
                feature = f"frames={n};mel={means};voiced={spans}/{active};tensor={hashlib.sha256(rows.tobytes()).hexdigest()[:16]}"
                out.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, n, spans, active * HOP * DOWN / (rate * UP)))
            kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_voiced", "voiced_s"])

    return media.select("doc_id", "n_bytes", "media", "tiles").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_voiced long, voiced_s double")


def stored_media(docs: DataFrame) -> DataFrame:
    """Stores every text as sound with its feature tensors in the shared folder and describes what is read back.

    Repeated rows each give their row; equal texts give equal values; an empty table gives
    an empty result; other columns are ignored. Long texts are worked on in blocks.
    """
    return digests(stored(to_media(docs)))
