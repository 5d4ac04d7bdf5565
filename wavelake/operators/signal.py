"""Operators that run a numpy kernel on each array of a column, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import kernels as K


def on_arrays(func: Callable[[np.ndarray], object], returns: str = "array<double>") -> Callable[[Column], Column]:
    """A column function that maps a kernel over array<double> values. A null stays null; the result is an array, nested array, number or dict (struct)."""

    def plain(x):
        return x.tolist() if isinstance(x, (np.ndarray, np.generic)) else x

    if returns.startswith("struct"):

        @F.pandas_udf(returns)
        def mapped(column: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([{} if x is None else {k: plain(v) for k, v in func(np.asarray(x, float)).items()} for x in column])
    else:

        @F.pandas_udf(returns)
        def mapped(column: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else plain(func(np.asarray(x, float))) for x in column], dtype="float64" if returns == "double" else object)

    return lambda x: mapped(x.cast("array<double>"))


def on_equal_arrays(func: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A kernel on matrices, a signal in each row: the arrays of one length in a batch are taken at once. A null stays null."""

    @F.pandas_udf("array<double>")
    def mapped(column: pd.Series) -> pd.Series:
        out, lengths = pd.Series([None] * len(column), dtype=object), np.array([-1 if x is None else len(x) for x in column], int)
        for n in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == n)
            for i, y in zip(at, func(np.stack([column.iloc[i] for i in at]))):
                out.iat[i] = y
        for i in np.flatnonzero(lengths == 0):
            out.iat[i] = np.zeros(0)
        return out

    return lambda x: mapped(x.cast("array<double>"))


def linear(func: Callable[[np.ndarray], np.ndarray], n: int) -> Callable[[Column], Column]:
    """A linear kernel on signals of exactly n samples as one matrix product for each batch."""
    matrix = K.linear_operator(func, n)

    @F.pandas_udf("array<double>")
    def mapped(column: pd.Series) -> pd.Series:
        # nulls stay, and another length is taken by the kernel itself
        out = pd.Series([None if x is None else x if len(x) == n else func(np.asarray(x, float)) for x in column], dtype=object)
        whole = [i for i, x in enumerate(column) if x is not None and len(x) == n]
        for i, y in zip(whole, np.stack([column.iloc[i] for i in whole]) @ matrix.T if whole else ()):
            out.iat[i] = y
        return out

    return lambda x: mapped(x.cast("array<double>"))


FEATURES = "struct<centroid: double, rolloff: double, spread: double, skewness: double, kurtosis: double, bandwidth: double, flatness: double, std: double, slope: double, decrease: double>"
MATRIX = "array<array<double>>"
rows = lambda m: [r.tolist() for r in m]


def fft_magnitude(x: Column) -> Column:
    return on_equal_arrays(lambda m: np.abs(np.fft.rfft(m, axis=1)))(x)


def spectral_features(x: Column, fs: float, **kw) -> Column:
    return on_arrays(lambda v: K.spectral(v, fs, **kw), FEATURES)(x)


def dominant_frequency(x: Column, fs: float) -> Column:
    return on_arrays(lambda v: K.dominant_frequency(v, fs), "double")(x)


def welch_density(x: Column, fs: float, nperseg: int) -> Column:
    return on_arrays(lambda v: K.welch(v, fs, nperseg)[1])(x)


def band_powers(x: Column, fs: float, cuts: list[tuple[float, float]]) -> Column:
    return on_arrays(lambda v: K.band_powers(v, fs, cuts))(x)


def envelope(x: Column) -> Column:
    return on_arrays(K.envelope)(x)


def instantaneous_frequency(x: Column, fs: float) -> Column:
    return on_arrays(lambda v: K.instantaneous_frequency(v, fs))(x)


def butterworth(x: Column, fs: float, kind: str = "lowpass", cut=None, order: int = 5, method: str = "filtfilt", samples: int | None = None) -> Column:
    """`samples`: the common length of all arrays, if they have one; the filter is then one matrix product."""
    func = lambda v: K.butterworth(v, fs, kind, cut, order, method)
    return (linear(func, samples) if samples else on_arrays(func))(x)


def median_filter(x: Column, size: int, mode: str = "reflect") -> Column:
    return on_arrays(lambda v: K.median_filter(v, size, mode))(x)


def gaussian_filter(x: Column, sigma: float = 1.0, order: int = 0, samples: int | None = None) -> Column:
    func = lambda v: K.gaussian_filter(v, sigma, order)
    return (linear(func, samples) if samples else on_arrays(func))(x)


def delta(x: Column, width: int = 9, order: int = 1) -> Column:
    return on_arrays(lambda v: K.savgol_delta(v, width, order))(x)


def stft_magnitude(x: Column, n_fft: int = 2048, hop: int | None = None, center: bool = True) -> Column:
    return on_arrays(lambda v: rows(np.abs(K.stft(v, n_fft, hop, center=center))), MATRIX)(x)


def stft_round_trip(x: Column, n_fft: int = 2048, hop: int | None = None) -> Column:
    return on_arrays(lambda v: K.istft(K.stft(v, n_fft, hop), hop, length=len(v)))(x)


def melspectrogram(x: Column, sr: float = 22050, n_fft: int = 2048, hop: int = 512, n_mels: int = 128) -> Column:
    return on_arrays(lambda v: rows(K.melspectrogram(v, sr, n_fft, hop, n_mels)), MATRIX)(x)


def mfcc(x: Column, sr: float = 22050, n_mfcc: int = 20, n_fft: int = 2048, hop: int = 512, n_mels: int = 128) -> Column:
    return on_arrays(lambda v: rows(K.mfcc(v, sr, n_mfcc, n_fft, hop, n_mels)), MATRIX)(x)


def pcen(x: Column, **kw) -> Column:
    return on_arrays(lambda v: K.pcen(v, **kw))(x)


def hpss(x: Column, n_fft: int = 2048, kernel: int = 31) -> Column:
    return on_arrays(lambda v: dict(zip(("harmonic", "percussive"), K.hpss(v, n_fft, kernel))), "struct<harmonic: array<double>, percussive: array<double>>")(x)


def griffin_lim(x: Column, n_fft: int = 2048, n_iter: int = 32) -> Column:
    """The signal rebuilt from the magnitudes of its own STFT."""
    return on_arrays(lambda v: K.griffinlim(np.abs(K.stft(v, n_fft)), n_iter, length=len(v)))(x)


def time_stretch(x: Column, rate: float, n_fft: int = 2048) -> Column:
    return on_arrays(lambda v: K.time_stretch(v, rate, n_fft))(x)


def pitch_shift(x: Column, steps: float, n_fft: int = 2048) -> Column:
    return on_arrays(lambda v: K.pitch_shift(v, steps, n_fft=n_fft))(x)


def resample(x: Column, n: int) -> Column:
    return on_arrays(lambda v: K.fft_resample(v, n))(x)


def interpolate(x: Column, n: int) -> Column:
    """Not-a-knot spline to n samples."""
    return on_arrays(lambda v: K.cubic_spline(np.arange(len(v)), v, np.linspace(0, len(v) - 1, n)))(x)


def envelope_peaks(x: Column, fs: float, **kw) -> Column:
    return on_arrays(lambda v: K.envelope_peaks(v, fs, **kw), "array<int>")(x)


def mfcc_stats(x: Column, sr: float = 22050, n_mfcc: int = 13, n_fft: int = 2048, hop: int = 512, n_mels: int = 128) -> Column:
    return on_arrays(lambda v: K.mfcc_stats(v, sr, n_mfcc, n_fft, hop, n_mels), "struct<mean: array<double>, std: array<double>, delta: array<double>, delta2: array<double>>")(x)


def mel_round_trip(x: Column, sr: float = 22050, n_fft: int = 2048, hop: int = 512, n_mels: int = 128, n_iter: int = 32) -> Column:
    """The signal rebuilt from its mel spectrogram."""
    return on_arrays(lambda v: K.mel_to_audio(K.melspectrogram(v, sr, n_fft, hop, n_mels), sr, n_fft, hop, n_iter=n_iter, length=len(v)))(x)


def spectrogram(x: Column, fs: float, nperseg: int = 256, noverlap: int | None = None, low: float = 0.0, high: float | None = None) -> Column:
    """Magnitudes of full segments: (bin, segment)."""
    return on_arrays(lambda v: rows(np.abs(K.plain_spectrogram(v, fs, nperseg, noverlap, None, low, high)[2])), MATRIX)(x)


def power_spectrogram(x: Column, fs: float, nperseg: int = 256, noverlap: int | None = None, low: float = 0.0, high: float | None = None) -> Column:
    """Powers of segments that reach over both ends: (bin, segment)."""
    return on_arrays(lambda v: rows(np.abs(K.plain_spectrogram(v, fs, nperseg, noverlap, None, low, high, True)[2]) ** 2), MATRIX)(x)


def bin_mel_spectrogram(x: Column, sr: float, n_fft: int = 2048, hop: int = 512, n_mels: int = 128) -> Column:
    return on_arrays(lambda v: rows(K.bin_mel_spectrogram(v, sr, n_fft, hop, n_mels)), MATRIX)(x)


def phase_power_ratio(x: Column, fs: float) -> Column:
    return on_arrays(lambda v: K.phase_power_ratio(v, fs), "double")(x)
