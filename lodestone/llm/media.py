"""Media columns: WAV bytes in a binary column and spectral landmark fingerprints.

`store_wav` puts each payload into a WAV file (mono, 8-bit samples), held as a
binary column; `landmarks` reads that column with the wave module, takes
short-time Fourier transforms, keeps spectral peaks and pairs near ones into
codes with the frame at which they start.

Defined results: a null or empty text is a payload of 64 zero bytes; a null
media value gives null features. Other input columns pass through whatever they
are called; an input column that bears the name of an output column is replaced.
Every row is stored and read for itself: null, repeated and equal ids are kept,
equal texts get equal values, an empty table gives an empty one. Texts of any
length are stored whole; of several, a task holds at most AT_ONCE bytes, or one
text. Of equally loud bins the lowest is a frame's peak, of equally loud frames
near each other the last.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

BLOCK = 64
RATE = 8000
FRAME, HOP = 128, 64
#: Frequency bins of the three bands of which each frame offers its loudest bin.
BANDS = ((1, 8), (8, 24), (24, 65))
NEAR = 2  # frames on either side that a peak must not be quieter than
FAN, REACH = 3, 32  # partners of a peak, and how many frames ahead they may be
FRAMES_AT_ONCE = 16384
AT_ONCE = 4 << 20  # bytes of texts or media that a task holds as Python objects


def padded(raw: bytes) -> bytes:
    n = max(BLOCK, -(-len(raw) // BLOCK) * BLOCK)
    return raw.ljust(n, b"\0")


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def _loudest(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and magnitude of the loudest bin per frame and band."""
    x = samples.astype(np.float32) - 128.0
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)), mode="edge")
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    bins, size = [], []
    for at in range(0, len(frames), FRAMES_AT_ONCE):
        part = frames[at : at + FRAMES_AT_ONCE]
        mag = np.abs(np.fft.rfft((part - part.mean(1, keepdims=True)) * window, axis=1))
        rows = np.arange(len(mag))
        best = [mag[:, lo:hi].argmax(1) + lo for lo, hi in BANDS]
        bins.append(np.stack(best, 1))
        size.append(np.stack([mag[rows, b] for b in best], 1))
    return np.concatenate(bins), np.concatenate(size)


def landmark_pairs(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(frame, code) of each pair of peaks, and the number of peaks."""
    bins, size = _loudest(samples)
    keep = size > 1e-3
    for d in range(1, NEAR + 1):
        keep[d:] &= size[d:] >= size[:-d]
        keep[:-d] &= size[:-d] > size[d:]
    frame, band = np.nonzero(keep)
    f = bins[frame, band]
    at, code = [], []
    for k in range(1, FAN + 1):
        gap = frame[k:] - frame[:-k]
        ok = gap <= REACH
        at.append(frame[:-k][ok])
        code.append((f[:-k][ok] << 16) | (f[k:][ok] << 8) | gap[ok])
    at, code = np.concatenate(at), np.concatenate(code)
    order = np.lexsort((code, at))
    return at[order].astype("<i4"), code[order].astype("<i4"), len(frame)


def _replaced(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in new] + fields)


def _slices(batch, column: str):
    """Runs of a batch's rows whose values in a column have at most AT_ONCE bytes, or are one row."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    first, held = 0, 0
    for k, n in enumerate(size):
        if k > first and held + n > AT_ONCE:
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += int(n)
    if first < batch.num_rows:
        yield batch.slice(first)


def store_wav(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `media` (WAV bytes of the padded text) and `n_bytes`; drops the text."""
    kept = df.select([c for c in df.columns if c != text])
    schema = _replaced(kept, [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    names = [f.name for f in schema.fields[:-2]]
    given = unused("given_text", names)
    df = df.select(*names, F.col(text).alias(given))

    def run(batches):
        import pyarrow as pa

        for b in (part for batch in batches for part in _slices(batch, given)):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(given).to_pylist()]
            media = [to_wav(padded(r)) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column(n) for n in names] + [pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())],
                names=[*names, "n_bytes", "media"],
            )

    return df.mapInArrow(run, schema)


FEATURES = [
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("n_peaks", T.LongType()),
    T.StructField("pair_time", T.ArrayType(T.IntegerType())),
    T.StructField("pair_code", T.ArrayType(T.IntegerType())),
    T.StructField("feature", T.StringType()),
]


def landmarks(df: DataFrame, media: str = "media", arrays: bool = True) -> DataFrame:
    """Reads the stored media back and adds its digests and fingerprints.

    `pair_time` and `pair_code` are the time-coded arrays, `feature` is their
    count and digest. With `arrays=False` only the latter is returned.
    """
    fields = [f for f in FEATURES if arrays or not f.name.startswith("pair_")]
    kept = df.select([c for c in df.columns if c != media])
    schema = _replaced(kept, fields)
    names = [f.name for f in schema.fields[: -len(fields)]]
    given = unused("given_media", names)
    df = df.select(*names, F.col(media).alias(given))
    types = {f.name: f.dataType for f in fields}

    def one(m: bytes | None) -> dict:
        if m is None:
            return dict.fromkeys(types)
        p = from_wav(m)
        at, code, peaks = landmark_pairs(np.frombuffer(p, np.uint8))
        return {
            "payload_bytes": len(p),
            "payload_sha256": hashlib.sha256(p).hexdigest(),
            "tail_crc32": zlib.crc32(p[-BLOCK:]),
            "media_bytes": len(m),
            "media_sha256": hashlib.sha256(m).hexdigest(),
            "n_peaks": peaks,
            "pair_time": at,
            "pair_code": code,
            "feature": f"{peaks}:{len(at)}:{hashlib.sha256(at.tobytes() + code.tobytes()).hexdigest()}",
        }

    def run(batches):
        import pyarrow as pa

        kinds = {"pair_time": pa.list_(pa.int32()), "pair_code": pa.list_(pa.int32())}
        for b in (part for batch in batches for part in _slices(batch, given)):
            rows = [one(m) for m in b.column(given).to_pylist()]
            made = [pa.array([r[n] for r in rows], kinds.get(n) or (pa.int64() if isinstance(k, T.LongType) else pa.string())) for n, k in types.items()]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + made, names=[*names, *types])

    return df.mapInArrow(run, schema)


def op10(documents: DataFrame) -> DataFrame:
    return landmarks(store_wav(documents.select("doc_id", "text")), arrays=False)
