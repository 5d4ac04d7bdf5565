"""Series as typed long tables with an explicit order, and the relational operators on them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import positioned


@dataclass(frozen=True)
class SeriesFrame:
    """A DataFrame with column roles: keys of a series, position in it, channels (X) and targets (y)."""

    df: DataFrame
    key: tuple[str, ...]
    channels: tuple[str, ...]
    targets: tuple[str, ...] = ()
    pos: str = "pos"

    @staticmethod
    def ordered(df: DataFrame, key: list[str], order: list[str], channels: list[str], targets: list[str] = ()) -> SeriesFrame:
        """Positions 0, 1, ... within each series, by the order columns."""
        at = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
        return SeriesFrame(df.withColumn("pos", at.cast("long")), tuple(key), tuple(channels), tuple(targets))

    def _with(self, df: DataFrame, **roles) -> SeriesFrame:
        return replace(self, df=df, **roles)

    @property
    def columns(self) -> list[str]:
        return [*self.key, self.pos, *self.channels, *self.targets]

    def iloc(self, start: int, stop: int, channels: list[int] | None = None) -> SeriesFrame:
        """Positions start to stop (not included), channels by number."""
        keep = tuple(self.channels[i] for i in channels) if channels is not None else self.channels
        return self._with(self.df.where(F.col(self.pos).between(start, stop - 1)), channels=keep)

    def loc(self, first: int, last: int, channels: list[str] | None = None) -> SeriesFrame:
        """Labels first to last, both included."""
        unknown = set(channels or ()) - set(self.channels)
        if unknown:
            raise KeyError(f"no such channels: {sorted(unknown)}")
        return self._with(self.df.where(F.col(self.pos).between(first, last)), channels=tuple(channels or self.channels))

    def __getitem__(self, at) -> SeriesFrame:
        """Rows, or rows and channels together: a position, a slice (with a step), or a list of positions; channels by number, name, slice or a list of them. Negative numbers count channels from the end, not positions."""
        rows, columns = at if isinstance(at, tuple) else (at, slice(None))
        pos = F.col(self.pos)
        if isinstance(rows, slice):
            low, step = rows.start or 0, rows.step or 1
            if low < 0 or step < 1 or (rows.stop is not None and rows.stop < 0):
                raise IndexError("positions count from the beginning")
            keep = (pos >= low) & ((pos - low) % step == 0)
            keep = keep & (pos < rows.stop) if rows.stop is not None else keep
        else:
            keep = pos.isin([int(r) for r in ([rows] if isinstance(rows, int) else rows)])
        if isinstance(columns, slice):
            start, stop = (self.channels.index(x) + end if isinstance(x, str) else x for x, end in ((columns.start, 0), (columns.stop, 1)))
            names = self.channels[start : stop : columns.step]
        else:
            names = tuple(c if isinstance(c, str) else self.channels[c] for c in ([columns] if isinstance(columns, (int, str)) else columns))
        unknown = set(names) - set(self.channels)
        if unknown:
            raise KeyError(f"no such channels: {sorted(unknown)}")
        return self._with(self.df.where(keep).select(*self.key, self.pos, *names, *self.targets), channels=names)

    def lengths(self) -> DataFrame:
        """(key, n): the samples of each series."""
        return self.df.groupBy(*self.key).agg(F.count("*").alias("n"))

    def drop(self, names: list[str]) -> SeriesFrame:
        return self._with(self.df.drop(*names), channels=tuple(c for c in self.channels if c not in names), targets=tuple(c for c in self.targets if c not in names))

    def rename(self, names: dict[str, str]) -> SeriesFrame:
        new = [names.get(c, c) for c in self.columns]
        if len(set(new)) < len(new):
            raise ValueError("names must stay unique")
        to = lambda cols: tuple(names.get(c, c) for c in cols)
        return self._with(self.df.withColumnsRenamed(names), key=to(self.key), channels=to(self.channels), targets=to(self.targets))

    def append(self, *others: SeriesFrame) -> SeriesFrame:
        """Rows of all; X and y both."""
        return self._with(reduce(lambda a, b: a.unionByName(b.df.select(*self.columns)), others, self.df.select(*self.columns)))

    def beside(self, other: SeriesFrame) -> SeriesFrame:
        """Channels of both, joined on key and position."""
        if set(self.channels) & set(other.channels):
            raise ValueError("channel names must differ")
        joined = self.df.select(*self.columns).join(other.df.select(*self.key, self.pos, *other.channels), [*self.key, self.pos])
        return self._with(joined, channels=self.channels + other.channels)

    def replaced(self, other: SeriesFrame) -> SeriesFrame:
        """Channels that both have, with the other's values where it has a row."""
        shared = [c for c in self.channels if c in other.channels]
        theirs = other.df.select(*self.key, self.pos, *(F.col(c).alias(f"_{c}") for c in shared), F.lit(True).alias("_has"))
        joined = self.df.select(*self.columns).join(theirs, [*self.key, self.pos], "left")
        return self._with(joined.withColumns({c: F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)) for c in shared}).select(*self.columns))

    def batches(self, size: int) -> DataFrame:
        return self.df.withColumn("batch", F.floor(F.col(self.pos) / size))

    def split(self, test: float = 0.2, seed: int | None = None, by: list[str] = (), up: bool = False) -> DataFrame:
        """A column `train`: of each stratum the first floor (or ceil) of n * (1 - test) rows, in order or in a seeded hash order."""
        order = F.col(self.pos) if seed is None else F.xxhash64(*self.key, self.pos, F.lit(seed))
        kept = lambda n: (F.ceil if up else F.floor)(F.round(n * (1 - test), 9))
        if not by:
            total = self.df.agg(F.count("*").alias("_total"))
            placed = positioned(self.df, order, *self.key, self.pos).crossJoin(F.broadcast(total))  # one row
            return placed.withColumn("train", F.col("_at") < kept(F.col("_total"))).drop("_at", "_total")
        part = Window.partitionBy(*by)
        return self.df.withColumn("train", F.row_number().over(part.orderBy(order, *self.key, self.pos)) <= kept(F.count("*").over(part)))

    def shuffled(self, seed: int = 42) -> DataFrame:
        return self.df.orderBy(F.xxhash64(*self.key, self.pos, F.lit(seed)))

    def arrays(self) -> DataFrame:
        """One row for each series: an array of values for each channel, in order."""
        packed = self.df.groupBy(*self.key).agg(F.array_sort(F.collect_list(F.struct(self.pos, *self.channels))).alias("_x"))
        return packed.select(*self.key, *(F.col(f"_x.{c}").alias(c) for c in self.channels))

    def windows(self, size: int, overlap: int = 0) -> DataFrame:
        """Full windows only: a row for each series, window and sample. Each sample is copied ceil(size / step) times; no range join."""
        if overlap >= size:
            raise ValueError("overlap must be smaller than the window")
        step = size - overlap
        n = F.count("*").over(Window.partitionBy(*self.key))
        last = F.floor(F.col(self.pos) / step)
        wide = self.df.withColumn("_n", n).withColumn("win", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(self.pos) - size + 1) / step)), last)))
        return wide.where(F.col("win") * step + size <= F.col("_n")).withColumn("start", F.col("win") * step).drop("_n")

    def rolling_windows(self, size: int, step: int, centred: bool = True) -> DataFrame:
        """Windows that end (or have their centre) at positions 0, step, 2 * step, ...; only the full ones, numbered from the first of those that could exist."""
        first = (1 + (size - 1) // 2 if centred else 1) - size
        n = F.count("*").over(Window.partitionBy(*self.key))
        low, high = F.ceil((F.col(self.pos) - size + 1 - first) / step), F.floor((F.col(self.pos) - first) / step)
        wide = self.df.withColumn("_n", n).where(low <= high).withColumn("win", F.explode(F.sequence(low, high))).withColumn("start", F.col("win") * step + first)
        return wide.where((F.col("start") >= 0) & (F.col("start") + size <= F.col("_n"))).drop("_n")

    def _framed(self, length: int, hop: int, skip: int = 0) -> DataFrame:
        """A row for each sample and centred frame (column `frame`) that holds it, and `skip` samples before it at least."""
        half = length // 2
        n = F.count("*").over(Window.partitionBy(*self.key))
        low, high = F.ceil((F.col(self.pos) + half - length + 1) / hop), F.floor((F.col(self.pos) + half - skip) / hop)
        wide = self.df.withColumn("_n", n).withColumn("_low", F.greatest(low, F.lit(0))).withColumn("_high", F.least(high, F.floor((F.col("_n") + 2 * half - length) / hop)))
        return wide.where("_low <= _high").withColumn("frame", F.explode(F.sequence("_low", "_high"))).drop("_n", "_low", "_high")

    def rolling_rms(self, channel: str, length: int, hop: int) -> DataFrame:
        """(key, frame, v): root mean square of centred frames, zeros beyond the ends."""
        x = F.col(channel)
        return self._framed(length, hop).groupBy(*self.key, "frame").agg(F.sqrt(F.sum(x * x) / length).alias("v"))

    def rolling_zcr(self, channel: str, length: int, hop: int) -> DataFrame:
        """(key, frame, v): share of sign changes (zero counts as positive) in centred frames, end values repeated beyond the ends."""
        before = F.lag(channel).over(Window.partitionBy(*self.key).orderBy(self.pos))
        marked = self._with(self.df.withColumn("_c", F.coalesce(((F.col(channel) < 0) != (before < 0)).cast("int"), F.lit(0))))
        changes = marked._framed(length, hop, 1).groupBy(*self.key, "frame").agg((F.sum("_c") / F.lit(float(length))).alias("v"))
        whole = self.df.groupBy(*self.key).agg(F.count("*").alias("_n")).withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") + 2 * (length // 2) - length) / hop)))).drop("_n")
        return whole.join(changes, [*self.key, "frame"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))

    def reversed(self) -> SeriesFrame:
        """The last sample first."""
        n = F.count("*").over(Window.partitionBy(*self.key))
        return self._with(self.df.withColumn(self.pos, n - 1 - F.col(self.pos)))

    def resampled(self, channel: str, size: Column) -> DataFrame:
        """(key, pos, v): linear interpolation to `size` (of column _n, the length) samples, end points kept. Each sample makes those up to the next one."""
        w = Window.partitionBy(*self.key)
        own = self.df.withColumn("_n", F.count("*").over(w)).withColumn("_m", size.cast("long")).withColumn("_next", F.coalesce(F.lead(channel).over(w.orderBy(self.pos)), F.col(channel)))
        step = F.when(F.col("_m") > 1, (F.col("_n") - 1) / (F.col("_m") - 1)).otherwise(F.lit(0.0))
        at = F.when(F.col("_m") > 1, F.col("j") * (F.col("_n") - 1) / (F.col("_m") - 1)).otherwise(F.lit(0.0))
        # a little wider than needed, as quotients are rounded; what isn't this sample's goes
        low, high = F.greatest(F.floor(F.col(self.pos) / F.col("_step")) - 1, F.lit(0)), F.least(F.ceil((F.col(self.pos) + 1) / F.col("_step")) + 1, F.col("_m") - 1)
        wide = own.withColumn("_step", F.when(step > 0, step).otherwise(F.lit(1.0))).withColumn("_low", low).withColumn("_high", high).where("_low <= _high").withColumn("j", F.explode(F.sequence("_low", "_high")))
        made = wide.withColumn("_t", at).where(F.floor("_t") == F.col(self.pos))
        return made.select(*self.key, F.col("j").alias(self.pos), (F.col(channel) + (F.col("_next") - F.col(channel)) * (F.col("_t") - F.floor("_t"))).alias("v"))


def frames(x: Column, length: int, hop: int) -> Column:
    """Array form: an array of full frames."""
    count = F.floor((F.size(x) - length) / hop).cast("int")
    return F.when(F.size(x) < length, F.array().cast("array<array<double>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda i: F.slice(x, i * hop + 1, length).cast("array<double>")))


def chunks(x: Column, length: int) -> Column:
    """Array form: consecutive parts, the last may be short."""
    return F.when(F.size(x) == 0, F.array().cast("array<array<double>>")).otherwise(F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / length).cast("int") - 1), lambda i: F.slice(x, i * length + 1, length).cast("array<double>")))


def centred_frames(x: Column, length: int, hop: int, edge: bool = False) -> Column:
    """Frames of the signal padded by half a frame on both sides, with zeros or with its end values."""
    half = length // 2
    left = F.array_repeat(F.get(x, F.lit(0)) if edge else F.lit(0.0), half)
    right = F.array_repeat(F.get(x, F.size(x) - 1) if edge else F.lit(0.0), half)
    return frames(F.concat(left.cast("array<double>"), x.cast("array<double>"), right.cast("array<double>")), length, hop)


def rolling_rms(x: Column, length: int, hop: int) -> Column:
    return F.transform(centred_frames(x, length, hop), lambda f: F.sqrt(F.aggregate(f, F.lit(0.0), lambda a, v: a + v * v) / length))


def rolling_zcr(x: Column, length: int, hop: int) -> Column:
    sign = lambda v: F.when(v < 0, 1).otherwise(0)
    changes = lambda f: F.aggregate(F.zip_with(F.slice(f, 1, length - 1), F.slice(f, 2, length - 1), lambda a, b: F.abs(sign(a) - sign(b))), F.lit(0), lambda a, v: a + v)
    return F.transform(centred_frames(x, length, hop, edge=True), lambda f: changes(f) / F.lit(float(length)))


def resized(x: Column, n: Column) -> Column:
    """Linear interpolation to n samples, end points kept."""
    at = lambda j: F.when(n > 1, j * (F.size(x) - 1) / (n - 1)).otherwise(F.lit(0.0))
    low = lambda j: F.least(F.floor(at(j)).cast("int"), F.size(x) - 1)
    value = lambda j: F.get(x, low(j)) + (F.get(x, F.least(low(j) + 1, F.size(x) - 1)) - F.get(x, low(j))) * (at(j) - low(j))
    return F.transform(F.sequence(F.lit(0), n - 1), value)
