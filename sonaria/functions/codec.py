"""Bytes to samples and back, and whole-clip changes of level and rate, in Arrow batches.

Array lambdas run interpreted, item by item; for clips of many thousand samples numpy is faster.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from sonaria.constants import PCM16_BUFFER_MAX, PCM16_MAX, TARGET_DBFS
from sonaria.functions.pieces import by_pieces

DECODED = "struct<sample_rate:int,channels:int,samples:array<float>,error:string>"


def _mono(raw: bytes, channels: int, scale: int, clip: bool) -> np.ndarray:
    x = np.frombuffer(raw, dtype="<i2").astype(np.float32) / np.float32(scale)
    if channels > 1:
        x = x.reshape(-1, channels).mean(axis=1, dtype=np.float32)
    return np.clip(x, -1.0, 1.0) if clip else x


def _pcm16(x: np.ndarray) -> bytes:
    y = np.clip(np.nan_to_num(np.asarray(x, dtype=np.float64)), -1.0, 1.0)
    return (y * PCM16_MAX).astype("<i2").tobytes()


def decode_pcm16(
    payload: Column, channels: Column | None = None, scale: int = PCM16_MAX, clip: bool = False
) -> Column:
    """Mono samples of raw little-endian PCM16; channels are averaged."""

    def one(rows: pa.Array) -> pa.Array:
        raw, chans = rows.field(0).to_pylist(), rows.field(1).to_pylist()
        return pa.array(
            [None if b is None else _mono(b, int(c), scale, clip) for b, c in zip(raw, chans)], pa.list_(pa.float32())
        )

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from by_pieces(one, batches)

    return run(F.struct(payload.alias("raw"), (F.lit(1) if channels is None else channels).alias("channels")))


def encode_pcm16(samples: Column) -> Column:
    """PCM16 bytes: NaN to 0, clip, scale by 32767, cut towards zero."""

    def one(clips: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _pcm16(x) for x in clips.to_pandas()], pa.binary())

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from by_pieces(one, batches)

    return run(samples)


def decode_wav(content: Column) -> Column:
    """struct<sample_rate, channels, samples, error> of a PCM16 WAV file; other containers are
    refused with an error, never raised."""

    def one(files: pa.Array) -> pa.Array:
        rates, channels, samples, errors = [], [], [], []
        for data in files.to_pylist():
            try:
                with wave.open(io.BytesIO(bytes(data)), "rb") as f:
                    if f.getsampwidth() != 2:
                        raise ValueError(f"unsupported sample width {f.getsampwidth()}")
                    raw = f.readframes(f.getnframes())
                    x = _mono(raw, f.getnchannels(), PCM16_BUFFER_MAX, True)
                    row = (f.getframerate(), f.getnchannels(), x, None)
            except Exception as error:
                row = (None, None, None, f"unsupported: {error!r}")
            for column, value in zip((rates, channels, samples, errors), row):
                column.append(value)
        return pa.StructArray.from_arrays(
            [
                pa.array(rates, pa.int32()),
                pa.array(channels, pa.int32()),
                pa.array(samples, pa.list_(pa.float32())),
                pa.array(errors, pa.string()),
            ],
            names=["sample_rate", "channels", "samples", "error"],
        )

    @F.arrow_udf(DECODED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from by_pieces(one, batches)

    return run(content)


def encode_wav(samples: Column, rate: Column) -> Column:
    """Mono PCM16 WAV file."""

    def one(rows: pa.Array) -> pa.Array:
        out = []
        for x, sr in zip(rows.field(0).to_pandas(), rows.field(1).to_pylist()):
            if x is None:
                out.append(None)
                continue
            buffer = io.BytesIO()
            with wave.open(buffer, "wb") as f:
                f.setnchannels(1)
                f.setsampwidth(2)
                f.setframerate(int(sr))
                f.writeframes(_pcm16(x))
            out.append(buffer.getvalue())
        return pa.array(out, pa.binary())

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from by_pieces(one, batches)

    return run(F.struct(samples.alias("samples"), rate.alias("rate")))


def normalise_level(samples: Column, target_dbfs: float = TARGET_DBFS) -> Column:
    """Whole clips set to the target RMS level and cut at full scale; silence stays as it is.

    All clips of a piece of a batch are scaled in one pass over their joined samples.
    """
    target = 10.0 ** (target_dbfs / 20.0)

    def one(clips: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(clips), 0).to_numpy(zero_copy_only=False)
        x = clips.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        owner = np.repeat(np.arange(len(clips)), sizes)
        power = np.bincount(owner, weights=x * x, minlength=len(clips))
        rms = np.sqrt(power / np.maximum(sizes, 1))
        level = np.where(rms > 0, target / (rms + 1e-9), 1.0)
        y = np.clip(x * level[owner], -1.0, 1.0).astype(np.float32)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(y), mask=clips.is_null())

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from by_pieces(one, batches)

    return run(samples)


def resample_linear(x: np.ndarray, src: int, dst: int) -> np.ndarray:
    """Output t sits at t*src/dst, kept as whole part and remainder so that no step error adds up;
    the last input sample is never extrapolated."""
    if src == dst or len(x) < 2:
        return x if src == dst else x[:0]
    t = np.arange(-(-(len(x) - 1) * dst // src), dtype=np.int64)
    whole, rest = np.divmod(t * src, dst)
    return x[whole] + (x[whole + 1] - x[whole]) * (rest / dst)


def resample_array(samples: Column, src: Column, dst: Column) -> Column:
    def one(rows: pa.Array) -> pa.Array:
        arrays, sources, targets = rows.field(0).to_pandas(), rows.field(1).to_pylist(), rows.field(2).to_pylist()
        moved = [
            None if x is None else resample_linear(np.asarray(x, dtype=np.float64), int(a), int(b))
            for x, a, b in zip(arrays, sources, targets)
        ]
        return pa.array(moved, pa.list_(pa.float64()))

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from by_pieces(one, batches)

    return run(F.struct(samples.alias("samples"), src.alias("src"), dst.alias("dst")))
