"""Media columns: texts kept losslessly as WAV, with spectral-peak pair fingerprints.

`to_media` writes each payload as an 8-bit mono WAV through the wave module and
`fingerprint` reads the stored bytes back, takes short-time Fourier transforms,
picks the local spectral peaks and pairs each with the next few in time. Both are
per-row map stages: no shuffle, memory bounded by one Arrow batch plus one block
of frames.

Defined cases: null text is the empty text; the empty text still fills one unit of
spaces; repeated rows give repeated results; other columns aren't looked at.
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
from pyspark.sql import functions as F

from basketry.llm.common import slices

UNIT = 192
RATE = 8000
FRAME = 192
HOP = 96
BLOCK_FRAMES = 4096
BANDS = ((1, 9), (9, 25), (25, 49), (49, 97))
FAN_OUT = 3
_WINDOW = np.hanning(FRAME).astype(np.float32)


def pad_payload(data: bytes, unit: int = UNIT) -> bytes:
    """data and spaces up to a positive multiple of unit."""
    return data + b" " * (max(unit, -(-len(data) // unit) * unit) - len(data))


def write_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def spectral_peaks(payload: bytes) -> np.ndarray:
    """Rows (frame, bin) of the strongest bin per band and frame that tops both neighbours in time.

    Magnitudes are rounded to whole numbers first, so ties resolve the same everywhere:
    the lowest bin of a band wins, and a peak must be above the frame before and not
    below the frame after.
    """
    x = np.frombuffer(payload, dtype=np.uint8)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    best = np.empty((len(frames), len(BANDS)), dtype=np.int64)
    power = np.empty_like(best)
    for lo in range(0, len(frames), BLOCK_FRAMES):
        part = (frames[lo : lo + BLOCK_FRAMES].astype(np.float32) - 128) * _WINDOW
        mag = np.rint(np.abs(np.fft.rfft(part, axis=1))).astype(np.int64)
        for b, (a, z) in enumerate(BANDS):
            k = mag[:, a:z].argmax(axis=1)
            best[lo : lo + len(part), b] = k + a
            power[lo : lo + len(part), b] = mag[np.arange(len(part)), k + a]
    edge = np.full((1, len(BANDS)), -1)
    keep = (power > np.vstack((edge, power[:-1]))) & (power >= np.vstack((power[1:], edge)))
    t, b = np.nonzero(keep)
    return np.column_stack((t, best[t, b]))


def pair_codes(peaks: np.ndarray) -> np.ndarray:
    """Time-coded pairs of a peak and each of the next FAN_OUT peaks: time << 24 | f1 << 16 | f2 << 8 | gap."""
    out = []
    for step in range(1, FAN_OUT + 1):
        a, b = peaks[:-step], peaks[step:]
        gap = np.minimum(b[:, 0] - a[:, 0], 255)
        out.append(a[:, 0] << 24 | a[:, 1] << 16 | b[:, 1] << 8 | gap)
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def to_media(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media): the whole text as a WAV."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [(v or "").encode() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([write_wav(pad_payload(b)) for b in raw], pa.binary())],
                names=[id_col, "n_bytes", "media"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(encode, f"`{id_col}` {kind}, n_bytes bigint, media binary")


def fingerprint(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The kept columns, digests of payload and stored form, and codes array<bigint> read from the stored bytes."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(7)]
            for item in batch.column(len(keep)):
                m = item.as_py()
                payload = read_wav(m)
                peaks = spectral_peaks(payload)
                for c, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), len(peaks), pair_codes(peaks)), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=[*keep, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_peaks", "codes"],
            )

    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    out = f"{head}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, n_peaks bigint, codes array<bigint>"
    return df.select(*keep, media).mapInArrow(features, out)


def media_digests(docs: DataFrame) -> DataFrame:
    """One row per document with its digests, the time-coded fingerprint array and its digest."""
    found = fingerprint(to_media(docs))
    digest = F.concat_ws(":", F.col("n_peaks").cast("string"), F.size("codes").cast("string"), F.sha2(F.concat_ws(",", F.col("codes").cast("array<string>")), 256))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", digest.alias("feature"), F.size("codes").cast("bigint").alias("n_pairs"), "codes")
