"""Media columns: WAV bytes, short-time Fourier transforms and peak-pair fingerprints.

``to_wav`` makes a column of mono 8-bit WAV files from bytes; ``fingerprint`` reads WAV
bytes with the wave module in portions, takes windowed spectra, picks the
strongest bin of each band where it stands out in time, and pairs each peak
with the next ones. The pairs are two arrays of equal length: the frame of the
first peak and a hash of both bins and their distance.

Defined results: null bytes give null WAV; null or unreadable WAV gives null
fingerprints. Before the first and after the last samples half a frame and more is filled up with the rest level, so every
sample lies well inside a frame and counts. Silence has no peaks and empty arrays. Equal sounds, as in repeated rows, get equal fingerprints. All functions
work on one column: other columns, whatever their names, stay, and an empty table gives an empty one.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE, SIZE, HOP, PORTION = 8000, 256, 128, 1 << 18
#: First bins of the bands.
BANDS = [1, 9, 17, 33, 65, 129]
FAN, REACH, STANDOUT = 3, 32, 4.0

_WINDOW = np.hanning(SIZE).astype(np.float32)


def wav_bytes(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of one channel of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def wav_samples(data: bytes) -> bytes:
    """All sample bytes of a WAV file."""
    with wave.open(io.BytesIO(data), "rb") as w:
        return w.readframes(w.getnframes())


def _spectra(data: bytes):
    """Energies of the frames, portion by portion."""
    with wave.open(io.BytesIO(data), "rb") as w:
        if w.getnchannels() != 1 or w.getsampwidth() != 1:
            raise ValueError("8-bit mono is asked for")
        held = np.zeros(HOP, np.float32)
        while True:
            raw = w.readframes(PORTION)
            if raw:
                held = np.concatenate([held, (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128])
            if not raw:
                # one more frame, filled up with the rest level, so that the last samples lie well inside a frame
                held = np.pad(held, (0, SIZE - len(held)))
            if len(held) >= SIZE:
                frames = np.lib.stride_tricks.sliding_window_view(held, SIZE)[::HOP]
                held = held[len(frames) * HOP :]
                f = np.fft.rfft(frames * _WINDOW, axis=1)
                yield f.real**2 + f.imag**2
            if not raw:
                return


def peak_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(frames, hashes, number of peaks, energy of all frames) of a WAV file."""
    tops, bins, loud = [], [], 0.0
    for energy in _spectra(data):
        loud += float(energy.sum(dtype=np.float64))
        top, at = [], []
        for a, b in zip(BANDS, BANDS[1:]):
            band = energy[:, a:b]
            k = band.argmax(1)
            value = band[np.arange(len(band)), k]
            top.append(np.where(value > STANDOUT * band.mean(1), value, 0))
            at.append(k + a)
        tops.append(np.stack(top, 1))
        bins.append(np.stack(at, 1).astype(np.int32))
    value, at = np.concatenate(tops), np.concatenate(bins)
    edge = np.zeros((1, value.shape[1]))
    earlier, later = np.concatenate([edge, value[:-1]]), np.concatenate([value[1:], edge])
    time, band = np.nonzero((value > 1e-6) & (value > earlier) & (value >= later))
    bin_ = at[time, band]
    starts, hashes = [], []
    for k in range(1, FAN + 1):
        gap = time[k:] - time[:-k]
        near = gap <= REACH
        starts.append(time[:-k][near])
        hashes.append((bin_[:-k][near].astype(np.int64) << 16) | (bin_[k:][near] << 8) | gap[near])
    t, h = np.concatenate(starts), np.concatenate(hashes)
    order = np.lexsort((h, t))
    return t[order].astype(np.int32), h[order].astype(np.int32), len(time), loud


def to_wav(payload: Column) -> Column:
    """WAV bytes of a binary column."""

    @F.pandas_udf("binary")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else wav_bytes(v) for v in values], dtype=object)

    return of(payload)


def samples(media: Column) -> Column:
    """The sample bytes of a WAV column."""

    @F.pandas_udf("binary")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else wav_samples(v) for v in values], dtype=object)

    return of(media)


def fingerprint(media: Column) -> Column:
    """A struct of time codes, pair hashes, the number of peaks and the energy of all frames."""

    @F.pandas_udf("times array<int>, hashes array<int>, n_peaks int, energy double")
    def of(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                rows.append((None,) * 4 if v is None else peak_pairs(v))
            except (wave.Error, EOFError, ValueError):
                rows.append((None,) * 4)
        return pd.DataFrame({"times": [r[0] for r in rows], "hashes": [r[1] for r in rows], "n_peaks": pd.array([r[2] for r in rows], dtype="Int32"), "energy": pd.array([r[3] for r in rows], dtype="Float64")})

    return of(media)


def digest(print_: Column) -> Column:
    """A short string for a fingerprint: peaks, pairs, a hash of the arrays and of the energy."""
    return F.concat_ws(":", print_["n_peaks"], F.size(print_["times"]), F.lower(F.hex(F.xxhash64(print_["times"], print_["hashes"], print_["energy"]))))


def padded(text: Column, unit: int = 64) -> Column:
    """The UTF-8 bytes of a text (null: empty), with bytes 0 up to a positive multiple of ``unit``."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    more = F.when(n == 0, unit).otherwise(F.pmod(-n, F.lit(unit)))
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), more)))
