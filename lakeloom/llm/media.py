"""Media columns: WAV payloads, their spectra and spectral-peak pair fingerprints.

A WAV file is one binary column. ``fingerprint`` reads it with the wave module, takes short-time Fourier transforms
(Hann window, half overlap), keeps the strongest local peaks of each frame and pairs each peak with the next ones within
a short target zone. A pair is packed as (first bin, second bin, frames between); with the first peak's frame it
is an entry of two time-coded arrays.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lakeloom.llm.common import slices

UNIT = 576
RATE = 8000
FRAME, HOP = 288, 144
PEAKS, FAN_OUT, ZONE = 2, 2, 4
BLOCK_FRAMES = 4096


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` and bytes 255 up to a positive multiple of ``unit``."""
    return data + b"\xff" * (max(unit, -(-len(data) // unit) * unit) - len(data))


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file with one unsigned 8-bit sample a byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(samples)
    return out.getvalue()


def read_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("only mono 8-bit files are written here")
        return f.readframes(f.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the spectral peaks: ``PEAKS`` bins of each frame that exceed both neighbours, by strength.

    Magnitudes are rounded to quarter decibels before they are compared and ties go to the lower bin.
    """
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    at, bins = [], []
    for start in range(0, len(frames), BLOCK_FRAMES):  # a very long text is worked on in blocks
        power = np.abs(np.fft.rfft(frames[start : start + BLOCK_FRAMES] * _WINDOW, axis=1))
        level = np.rint(80 * np.log10(power + 1)).astype(np.int32)
        inner = level[:, 1:-1]
        rank = np.where((inner > level[:, :-2]) & (inner >= level[:, 2:]), inner * FRAME + (FRAME - 1 - np.arange(inner.shape[1], dtype=np.int32)), -1)
        best = -np.sort(-np.partition(rank, -PEAKS, axis=1)[:, -PEAKS:], axis=1)
        row, col = np.nonzero(best > 0)
        at.append(row + start)
        bins.append(FRAME - best[row, col] % FRAME)
    return np.concatenate(at), np.concatenate(bins)


def pairs(at: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and hashes of peak pairs: each peak with the ``FAN_OUT`` peaks after it, in its own or the next ``ZONE`` frames."""
    times, hashes = [], []
    n = len(at)
    own = np.arange(n)
    for k in range(FAN_OUT):
        j = own + 1 + k
        i = np.flatnonzero(j < n)
        i = i[at[j[i]] - at[i] <= ZONE]
        j = j[i]
        times.append(at[i])
        hashes.append((bins[i] << 13) | (bins[j] << 4) | (at[j] - at[i]))
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, t))
    return t[order].astype(np.int32), h[order].astype(np.int32)


def encode(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds ``media``, the text's UTF-8 bytes, padded, as a WAV file. Null text counts as empty; a column of that name is replaced."""
    others = [f for f in df.schema.fields if f.name.lower() != media.lower()]
    names = [f.name for f in others]
    schema = T.StructType([*others, T.StructField(media, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                files = [write_wav(pad((x or "").encode())) for x in part.column(names.index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(files, pa.binary())], [*names, media])

    return df.select(*[df[f"`{x}`"] for x in names]).mapInArrow(run, schema)


FINGERPRINT = T.StructType([T.StructField("fp_times", T.ArrayType(T.IntegerType(), False), False), T.StructField("fp_hashes", T.ArrayType(T.IntegerType(), False), False)])


def fingerprint(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds the time-coded arrays ``fp_times`` and ``fp_hashes`` of a column of WAV files; null gives empty arrays."""
    others = [f for f in df.schema.fields if f.name.lower() not in FINGERPRINT.names]
    names = [f.name for f in others]
    schema = T.StructType([*others, *FINGERPRINT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media):
                found = [pairs(*peaks(read_wav(x))) if x is not None else ([], []) for x in part.column(names.index(media)).to_pylist()]
                arrays = [pa.array([x[i] for x in found], pa.list_(pa.int32())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), *arrays], schema.names)

    return df.select(*[df[f"`{x}`"] for x in names]).mapInArrow(run, schema)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: sizes and digests of its WAV file, all from what is read back, and its fingerprint.

    ``feature`` is the number of pairs and the digest of both time-coded arrays, which follow as columns. Null and empty texts
    store one unit of padding. Equal texts have equal rows but for the key; each text's spectra are computed on their own.
    """
    fields = (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))
    schema = T.StructType([df.schema[key], *[T.StructField(n, t, False) for n, t in fields], *FINGERPRINT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, max_rows=1024):
                rows = []
                for x in part.column(1).to_pylist():
                    data = (x or "").encode()
                    stored = write_wav(pad(data))
                    payload = read_wav(stored)
                    t, h = pairs(*peaks(payload))
                    feature = f"{len(t)}:{hashlib.sha256(t.astype('<i4').tobytes() + h.astype('<i4').tobytes()).hexdigest()}"
                    rows.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, t, h))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(v), k) for v, k in zip(zip(*rows), kinds))], schema.names)

    return df.select(df[f"`{key}`"], df[f"`{text}`"]).mapInArrow(run, schema)
