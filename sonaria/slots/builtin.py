"""Built-in deterministic backends, one per slot; real models are plugged in by the user."""

from __future__ import annotations

import numpy as np
import pandas as pd

from sonaria.slots.base import Slot

# Size of the built-in spectral embedding.
SPECTRUM_SAMPLES = 2048
SPECTRUM_BINS = 256

SEGMENT = (
    "struct<id:int,seek:int,start:double,end:double,text:string,tokens:array<int>,"
    "temperature:double,avg_logprob:double,compression_ratio:double,no_speech_prob:double>"
)
TRANSCRIPT = f"struct<text:string,language:string,segments:array<{SEGMENT}>>"
TOKENS = "array<struct<word:string,label:string>>"


def _length_transcriber():
    def run(samples: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series(
            [
                {"text": f"len={len(x)}", "language": lang, "segments": []}
                for x, lang in zip(samples, language)
            ],
            index=samples.index,
        )

    return run


def _spectral_embedder():
    def run(samples: pd.Series) -> pd.Series:
        out = []
        for x in samples:
            x = np.asarray(x, dtype=np.float64)
            if len(x) <= SPECTRUM_SAMPLES:
                frames = x.reshape(1, -1)
            else:
                # The mean over all frames; the last one is filled up with silence.
                frames = np.zeros((-(-len(x) // SPECTRUM_SAMPLES), SPECTRUM_SAMPLES))
                frames.ravel()[: len(x)] = x
            spectrum = np.abs(np.fft.rfft(frames, axis=1)).mean(axis=0)[:SPECTRUM_BINS]
            out.append((spectrum / max(np.linalg.norm(spectrum), 1e-12)).astype(np.float32))
        return pd.Series(out, index=samples.index)

    return run


def _identity():
    return lambda values: values


def _plain_labels():
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"word": w, "label": "LOWER_O"} for w in t.split()])

    return run


TRANSCRIBE = Slot("transcribe.length", TRANSCRIPT, _length_transcriber)
EMBED = Slot("embed.spectrum", "array<float>", _spectral_embedder)
DENOISE = Slot("denoise.identity", "array<float>", _identity)
PUNCTUATE = Slot("punctuate.plain", TOKENS, _plain_labels)
ACCENT = Slot("accent.identity", "string", _identity)
