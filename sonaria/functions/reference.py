"""Voice references cut from long clips, as kernels on sample arrays: a clip stays one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sonaria.constants import (
    EDGE_DBFS,
    KEEP_SILENCE_MS,
    LONG_SILENCE,
    SHORT_SILENCE,
    SILENCE_STEP_MS,
    TAIL_SILENCE_MS,
    TTS_SAMPLE_RATE,
    VOICE_CAP_MS,
    VOICE_SOFT_MS,
)
from sonaria.functions.pieces import by_pieces


def _mean_squares(x: np.ndarray, size: int) -> np.ndarray:
    """Mean square of each run of ``size`` samples; the last run may be shorter."""
    edges = np.arange(0, len(x), size)
    return np.add.reduceat(x * x, edges) / np.diff(np.append(edges, len(x))) if len(x) else np.empty(0)


def speech_runs(energy: np.ndarray, frames: int, threshold_dbfs: float) -> np.ndarray:
    """(start, end) of the runs of frames outside every silence of ``frames`` frames."""
    n = len(energy)
    silent = np.zeros(n, dtype=bool)
    if n >= frames:
        windows = np.lib.stride_tricks.sliding_window_view(energy, frames)
        opens = np.sqrt(windows.mean(axis=1)) <= 10.0 ** (threshold_dbfs / 20.0)
        depth = np.zeros(n + 1, dtype=np.int64)
        depth[: len(opens)] += opens
        depth[frames : frames + len(opens)] -= opens
        silent = np.cumsum(depth[:n]) > 0
    edges = np.diff(np.concatenate([[0], ~silent, [0]]).astype(np.int8))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1)


def kept_segments(
    energy: np.ndarray, silence: tuple[int, float], keep_ms: int, soft_ms: int, cap_ms: int
) -> np.ndarray:
    """(start, end) in ms of the leading speech segments up to the cap, with kept silence around;
    neighbours that would overlap meet halfway."""
    least_ms, threshold = silence
    runs = speech_runs(energy, least_ms // SILENCE_STEP_MS, threshold) * SILENCE_STEP_MS
    if not len(runs):
        return runs
    start, end = runs[:, 0], runs[:, 1]
    lo, hi = start - keep_ms, end + keep_ms
    halfway = (end[:-1] + start[1:]) // 2
    close = hi[:-1] > lo[1:]
    lo[1:] = np.where(close, halfway, lo[1:])
    hi[:-1] = np.where(close, halfway, hi[:-1])
    lo, hi = np.maximum(lo, 0), np.minimum(hi, len(energy) * SILENCE_STEP_MS)
    upto = np.cumsum(hi - lo)
    past = (upto - (hi - lo) > soft_ms) & (upto > cap_ms)
    count = int(np.argmax(past)) if past.any() else len(past)
    return np.stack([lo, hi], axis=1)[:count]


def _clean(
    x: np.ndarray, rate: int, cap_ms: int, soft_ms: int, keep_ms: int, long_silence, short_silence,
    edge_dbfs: float, tail_ms: int,
) -> np.ndarray:
    per_ms = rate // 1000
    energy = _mean_squares(x, rate * SILENCE_STEP_MS // 1000)
    segments = kept_segments(energy, long_silence, keep_ms, soft_ms, cap_ms)
    if len(segments) and (segments[:, 1] - segments[:, 0]).sum() > cap_ms:
        segments = kept_segments(energy, short_silence, keep_ms, soft_ms, cap_ms)
    parts = [x[a * per_ms : b * per_ms] for a, b in segments]
    placed = np.concatenate([*parts, x[:0]])[: cap_ms * per_ms]
    loud = np.flatnonzero(np.sqrt(_mean_squares(placed, per_ms)) > 10.0 ** (edge_dbfs / 20.0))
    if len(loud):
        placed = placed[loud[0] * per_ms : (loud[-1] + 1) * per_ms]
    else:
        placed = placed[:0]
    return np.concatenate([placed, np.zeros(tail_ms * per_ms)])


def clean_reference(
    samples: Column,
    rate: int = TTS_SAMPLE_RATE,
    cap_ms: int = VOICE_CAP_MS,
    soft_ms: int = VOICE_SOFT_MS,
    keep_ms: int = KEEP_SILENCE_MS,
    long_silence: tuple[int, float] = LONG_SILENCE,
    short_silence: tuple[int, float] = SHORT_SILENCE,
    edge_dbfs: float = EDGE_DBFS,
    tail_ms: int = TAIL_SILENCE_MS,
) -> Column:
    """A long clip cut to a voice reference: long silences first, short ones if it is still over the
    cap, then the hard cap, the edge trim and a short silence at the end; null stays null."""
    settings = (rate, cap_ms, soft_ms, keep_ms, long_silence, short_silence, edge_dbfs, tail_ms)

    def one(clips: pa.Array) -> pa.Array:
        cleaned = [
            None if not clip.is_valid else _clean(clip.values.to_numpy(zero_copy_only=False).astype(np.float64), *settings)
            for clip in clips
        ]
        offsets = np.cumsum([0, *(0 if c is None else len(c) for c in cleaned)])
        flat = np.concatenate([np.empty(0), *(c for c in cleaned if c is not None)]).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat), mask=clips.is_null())

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from by_pieces(one, batches)

    return run(samples)
