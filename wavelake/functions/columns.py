"""Column expressions: statistics (aggregates), energy and loudness, decibels, masks, conversions between indices and time."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

_INF = float("-inf")


def safe(a: Column, b: Column) -> Column:
    """a / b, zero where b is zero."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def sample_skewness(x: Column) -> Column:
    n = F.count(x)
    return F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)) * F.skewness(x)


def central_moments(x: Column) -> list[Column]:
    m2 = F.var_pop(x)
    return [F.lit(1.0), F.lit(0.0), m2, F.skewness(x) * F.pow(m2, 1.5), (F.kurtosis(x) + 3) * m2 * m2]


def statistics(x: Column, ddof: int = 0) -> dict[str, Column]:
    """One pass over a group: all statistical and energy features with a bounded state. The median is no such; see eda.statistics."""
    return {
        "mean": F.avg(x), "std": F.stddev_samp(x) if ddof else F.stddev_pop(x), "variance": F.var_samp(x) if ddof else F.var_pop(x),
        "max": F.max(x), "min": F.min(x), "kurtosis": F.kurtosis(x), "skewness": sample_skewness(x),
        "rms": rms(x), "energy": F.sum(x * x), "power": F.avg(x * x), "crest_factor": safe(F.max(F.abs(x)), rms(x)), "length": F.count(x),
    }


def crossing(x: Column, window: Window) -> Column:
    """1 where x and the sample before it have strictly different signs. Sum over count - 1 is the zero-crossing rate."""
    return F.when(x * F.lag(x).over(window) < 0, 1).otherwise(0)


def dbfs(x: Column, sample_width: int) -> Column:
    level = rms(x)
    return F.when(F.coalesce(level, F.lit(0.0)) == 0, F.lit(_INF)).otherwise(20 * F.log10(level / max_amplitude(sample_width)))


def max_amplitude(sample_width: int) -> float:
    return 2.0 ** (8 * sample_width) / 2


def ratio_to_db(ratio: Column, other: Column | None = None, amplitude: bool = True) -> Column:
    value = ratio if other is None else F.try_divide(ratio, other)
    return F.when(value == 0, F.lit(_INF)).otherwise((20 if amplitude else 10) * F.log10(value))


def power_to_db(s: Column, ref: float = 1.0, amin: float = 1e-10, top_db: float | None = None, window: Window | None = None) -> Column:
    import math

    if amin <= 0:
        raise ValueError("the floor `amin` has to be above zero")
    if top_db is not None and top_db < 0:
        raise ValueError("the range `top_db` can't be below zero")
    out = 10 * F.log10(F.greatest(s, F.lit(amin))) - 10 * math.log10(max(amin, ref))
    return out if top_db is None else F.greatest(out, F.max(out).over(window) - top_db)


def amplitude_to_db(s: Column, ref: float = 1.0, amin: float = 1e-5, **more) -> Column:
    return power_to_db(s * s, ref * ref, amin * amin, **more)


def db_to_power(s: Column, ref: float = 1.0) -> Column:
    return ref * F.pow(F.lit(10.0), s * 0.1)


def db_to_amplitude(s: Column, ref: float = 1.0) -> Column:
    return F.sqrt(db_to_power(s, ref * ref))


def normalized(x: Column, window: Window) -> Column:
    top = F.greatest(F.max(x).over(window), -F.min(x).over(window))
    return F.when(top == 0, x).otherwise(F.try_divide(x, top))


def signal_magnitude_area(*channels: Column) -> Column:
    return sum((F.abs(c) for c in channels[1:]), F.abs(channels[0]))


def magnitude(*channels: Column) -> Column:
    return F.sqrt(sum((c * c for c in channels[1:]), channels[0] * channels[0]))


def softmask(x: Column, ref: Column, power: float = 1.0, split_zeros: bool = False) -> Column:
    """Share of x ** power beside ref ** power, as a logistic curve of the log ratio."""
    curve = 1 / (1 + F.exp(power * (F.ln(ref) - F.ln(x))))
    return F.when((x <= 0) & (ref <= 0), F.lit(0.5 if split_zeros else 0.0)).when(x <= 0, F.lit(0.0)).when(ref <= 0, F.lit(1.0)).otherwise(curve)


def hz_to_mel(f: Column, htk: bool = False) -> Column:
    return 2595 * F.log10(1 + f / 700) if htk else F.when(f < 1000, f * 3 / 200).otherwise(15 + 27 * F.log(F.greatest(f, F.lit(1000.0)) / 1000) / F.log(F.lit(6.4)))


def mel_to_hz(m: Column, htk: bool = False) -> Column:
    return 700 * (F.pow(F.lit(10.0), m / 2595) - 1) if htk else F.when(m < 15, m * 200 / 3).otherwise(1000 * F.exp((m - 15) * F.log(F.lit(6.4)) / 27))


def frames_to_samples(frame: Column, hop: int = 512, n_fft: int | None = None) -> Column:
    return (frame * hop + (n_fft or 0) // 2).cast("long")


def samples_to_time(sample: Column, sr: float = 22050) -> Column:
    return sample / F.lit(float(sr))


def times_like(n: Column, sr: float = 22050, hop: int = 512, n_fft: int | None = None) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: samples_to_time(frames_to_samples(i, hop, n_fft), sr))


def fft_frequencies(sr: float = 22050, n_fft: int = 2048) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_fft // 2)), lambda k: k * F.lit(sr / n_fft))


def fix_length(x: Column, size: int) -> Column:
    return F.concat(F.slice(x, 1, size), F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(x), F.lit(0))))


def pad_center(x: Column, size: int) -> Column:
    left = F.floor((F.lit(size) - F.size(x)) / 2).cast("int")
    padded = F.concat(F.array_repeat(F.lit(0.0), left), x, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(x) - left))
    return F.when(F.size(x) > size, F.raise_error(F.lit("target size is smaller than the data"))).otherwise(padded)


def one_pole(x: Column, s: float) -> Column:
    """First-order smoother over an array: m[t] = (1 - s) m[t - 1] + s x[t], m[0] = x[0]."""
    start = F.array(F.get(x, F.lit(0)).cast("double"))
    return F.aggregate(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), start, lambda m, v: F.concat(m, F.array(F.element_at(m, -1) * (1 - s) + v * s)))


def samples_like(n: Column, hop: int = 512, n_fft: int | None = None) -> Column:
    """The sample at which each of n frames begins."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: frames_to_samples(i, hop, n_fft))


def phasor(angle: Column, mag: Column | None = None) -> dict[str, Column]:
    """Real and imaginary part of a complex number of the given angle and magnitude (1)."""
    m = F.lit(1.0) if mag is None else mag
    return {"re": m * F.cos(angle), "im": m * F.sin(angle)}
