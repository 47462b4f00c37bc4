"""Media columns: bytes as WAV files of 8-bit samples, stored in a table, and spectral-peak fingerprints of the samples
read back.

A peak is a bin of the short-time spectrum that no other within NEAR_T frames and NEAR_F bins exceeds. Each peak is
paired with all later ones, in order of time and frequency, of its own frame and the next FAN; a pair is a code of both
bins and their distance, at the time of the first."""

from __future__ import annotations

import hashlib
import io
import uuid
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.words import tidy
from quillgraph.plans.durable import shared_dir

#: Payloads are padded to multiples of FRAME; a short-time spectrum has FRAME samples, one each HOP.
FRAME, HOP, RATE = 192, 96, 8000
#: Frames and bins around a peak, frames over which peaks are paired, and the level below which there is none.
NEAR_T, NEAR_F, FAN, FLOOR = 2, 6, 3, 1e-3
MEDIA = "doc_id long, n_bytes long, media binary"
PRINTS = "doc_id long, n_bytes long, payload binary, media binary, fingerprint array<struct<t:int,code:int>>"
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_WINDOW = np.hanning(FRAME).astype(np.float32)
_PAD = b" "


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, RATE, len(payload), "NONE", ""))
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(data: bytes) -> bytes:
    """``data`` with blanks behind it, up to a positive multiple of FRAME."""
    return data + _PAD * (-len(data) % FRAME if data else FRAME)


def _highest(s: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """The maximum within ``reach`` places along an axis."""
    n, out = s.shape[axis], s.copy()
    cut = lambda a, b: tuple([slice(None)] * axis + [slice(a, b)])
    for d in range(1, min(reach, n - 1) + 1):
        np.maximum(out[cut(d, None)], s[cut(None, n - d)], out=out[cut(d, None)])
        np.maximum(out[cut(None, n - d)], s[cut(d, None)], out=out[cut(None, n - d)])
    return out


def peaks(payload: bytes, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(frames, bins) of the spectral peaks, in order. Frames are transformed block by block, with NEAR_T on each side."""
    frames = np.lib.stride_tricks.sliding_window_view(np.frombuffer(payload, np.uint8), FRAME)[::HOP]
    times, bins = [], []
    for i in range(0, len(frames), block):
        lo, hi = max(0, i - NEAR_T), min(len(frames), i + block + NEAR_T)
        f = frames[lo:hi].astype(np.float32)
        s = np.abs(np.fft.rfft((f - f.mean(1, keepdims=True)) * _WINDOW, axis=1)).astype(np.float32)
        s[:, 0] = 0
        top = _highest(_highest(s, NEAR_F, 1), NEAR_T, 0)
        t, b = np.nonzero((s == top) & (s > FLOOR))
        here = (t >= i - lo) & (t < i - lo + block)
        times.append(t[here] + lo)
        bins.append(b[here])
    return np.concatenate(times), np.concatenate(bins)


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes) of pairs of spectral peaks. A code holds both bins and their distance in frames."""
    t, b = peaks(payload)
    n = np.searchsorted(t, t + FAN, "right") - np.arange(len(t)) - 1
    first = np.repeat(np.arange(len(t)), n)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
    return t[first].astype(np.int32), (b[first] << 16 | b[second] << 4 | (t[second] - t[first])).astype(np.int32)


def store_media(docs: DataFrame, path: str) -> DataFrame:
    """The table (doc_id, n_bytes, media) at ``path``, written and opened for reading: the UTF-8 bytes of each text,
    padded, as a WAV file.

    Null texts count as empty; rows with a null or repeated doc_id are stored as they come, an empty table as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(x.as_py() or "").encode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_wav(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select("doc_id", "text").mapInArrow(tidy(run), MEDIA)
    rows.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).option("parquet.enable.dictionary", "false").parquet(path)
    return docs.sparkSession.read.schema(MEDIA).parquet(path)


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 100):
            part = batch.slice(i, 100)
            payload = [from_wav(x) for x in part.column(2).to_pylist()]
            prints = [fingerprint(x) for x in payload]
            offsets = np.concatenate(([0], np.cumsum([len(t) for t, _ in prints]))).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([t for t, _ in prints])), pa.array(np.concatenate([c for _, c in prints]))], ["t", "code"])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(payload, pa.binary()), part.column(2), pa.ListArray.from_arrays(offsets, pairs)], ["doc_id", "n_bytes", "payload", "media", "fingerprint"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for batch in batches:
        rows = []
        prints = batch.column(4)
        t, c = (prints.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        offs = prints.offsets.to_numpy()
        for i in range(batch.num_rows):
            payload, media = batch.column(2)[i].as_buffer(), batch.column(3)[i].as_buffer()
            a, b = offs[i], offs[i + 1]
            feature = f"{b - a}:{t[b - 1] if b > a else 0}:{hashlib.sha256(t[a:b].tobytes() + c[a:b].tobytes()).hexdigest()[:32]}"
            rows.append((len(payload), sha(payload), zlib.crc32(memoryview(payload)[-16:]), len(media), sha(media), feature))
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(6))], ["doc_id", "n_bytes", *names])


def fingerprints(media: DataFrame) -> DataFrame:
    """``media`` with the payload read back and its time-coded fingerprint; equal payloads have equal ones."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(_printed), PRINTS)


def digests(prints: DataFrame) -> DataFrame:
    """Checksums of what :func:`fingerprints` gives; ``feature`` has the number of pairs, the last time and a digest."""
    return prints.mapInArrow(tidy(_digested), DIGESTS)


def fingerprint_digests(media: DataFrame) -> DataFrame:
    """:func:`digests` of the :func:`fingerprints` of ``media`` in one pass: the fingerprints never become rows."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(lambda batches: _digested(_printed(batches))), DIGESTS)
