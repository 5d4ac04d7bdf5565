"""Named queries of the engine over the shared tables, each with its SQL twin where SQL can express it.

The series are `events.value` by user, ordered by (ts, event_id); ready-made signals are the embeddings; the
multi-channel matrix is `lineitem`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import augment, eda, events, pipelines, series, signal

CHANNELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

#: Shared parts of the SQL twins. Where decimal inputs make exact ties of the last digit, both sides add 1e-6 before rounding.
P = "p as (select user_id, event_id, event_type, ts, value, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, count(*) over (partition by user_id) as n from events)"
E = "e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos, len(embedding) as n from embeddings)"
DFT = f"{E}, m as (select vec_id, k.k as k, any_value(n) as n, sqrt(pow(sum(x * cos(2 * pi() * k.k * pos / n)), 2) + pow(sum(x * sin(2 * pi() * k.k * pos / n)), 2)) as mag from e, (select unnest(range(0, 33)) as k) k group by vec_id, k.k)"


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _users(spark: SparkSession, sf_dir: str) -> series.SeriesFrame:
    return series.SeriesFrame.ordered(_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", "value"), ["user_id"], ["ts", "event_id"], ["value"], ["event_type"])


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def r4(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 4) + F.lit(0.0)  # no negative zero


def _long(df: DataFrame, column: str, key: str = "vec_id", pos: str = "pos", value: str = "v") -> DataFrame:
    return df.select(key, F.posexplode(column).alias(pos, value)).withColumn(value, r4(value))


def _by_user():
    return Window.partitionBy("user_id")


WINDOW_FEATURES = f"""
with {P}, w as (select user_id, cast(floor(pos / 5.0) as bigint) - k.k as win, value, n from p cross join (select * from (values (0), (1), (2), (3)) t(k)) k)
select user_id, win, round(avg(value), 4) as mean_value, round(stddev_pop(value), 4) as std_value,
       round(sqrt(avg(value * value)), 4) as rms_value, round(max(abs(value)) / sqrt(avg(value * value)), 4) as crest_factor, count(*) as n
from w where win >= 0 and win * 5 + 20 <= n group by user_id, win
"""


@query(WINDOW_FEATURES)
def window_features(spark, sf_dir):
    w = _users(spark, sf_dir).windows(20, 15)
    x = F.col("value")
    return w.groupBy("user_id", "win").agg(r4(F.avg(x)).alias("mean_value"), r4(F.stddev_pop(x)).alias("std_value"), r4(C.rms(x)).alias("rms_value"), r4(F.max(F.abs(x)) / C.rms(x)).alias("crest_factor"), F.count("*").alias("n"))


@query("""select event_type, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as std, round(var_pop(value), 3) as variance, round(median(value), 4) as median, max(value) as max, min(value) as min,
 round(kurtosis_pop(value), 4) as kurtosis, round(skewness(value), 4) as skewness, round(sqrt(avg(value * value)), 4) as rms, round(sum(value * value), 1) as energy, round(avg(value * value), 3) as power,
 round(max(abs(value)) / sqrt(avg(value * value)), 4) as crest_factor, count(value) as length from events group by event_type""")
def signal_statistics(spark, sf_dir):
    digits = {"variance": 3, "power": 3, "energy": 1, "max": None, "min": None, "length": None}
    out = eda.statistics(_table(spark, sf_dir, "events"), "value", ["event_type"])
    return out.withColumns({c: F.round(c, digits.get(c, 4)) for c in out.columns if c != "event_type" and digits.get(c, 4) is not None})


@query("""select event_type, 1.0::double as m0, 0.0::double as m1, round(avg(pow(d, 2)), 3) as m2, round(avg(pow(d, 3)), 0) as m3, round(avg(pow(d, 4)), -3) as m4
 from (select event_type, value - avg(value) over (partition by event_type) as d from events) group by event_type""")
def central_moments(spark, sf_dir):
    m = C.central_moments(F.col("value"))
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(*(F.round(c, d).alias(f"m{k}") for k, (c, d) in enumerate(zip(m, (4, 4, 3, 0, -3)))))


@query(f"""with {P}, c as (select user_id, case when (value - 40) * lag(value - 40) over (partition by user_id order by pos) < 0 then 1 else 0 end as x from p)
 select user_id, round(sum(x) / (count(*) - 1)::double, 4) as zcr from c group by user_id""")
def zero_crossing_rate(spark, sf_dir):
    df = _users(spark, sf_dir).df.withColumn("x", C.crossing(F.col("value") - 40, _by_user().orderBy("pos")))
    return df.groupBy("user_id").agg(r4(F.try_divide(F.sum("x").cast("double"), F.count("*") - 1)).alias("zcr"))


@query(f"with {P} select user_id, pos, round(value / greatest(max(value) over (partition by user_id), -min(value) over (partition by user_id)), 4) as v from p")
def normalize_signal(spark, sf_dir):
    return _users(spark, sf_dir).df.select("user_id", "pos", r4(C.normalized(F.col("value"), _by_user())).alias("v"))


@query(f"with {P}, b as (select user_id, min(pos) as a, max(pos) as z from p where value > 30 group by user_id) select p.user_id, pos, value from p join b on p.user_id = b.user_id and pos between a and z")
def trim_signal(spark, sf_dir):
    loud = F.when(F.col("value") > 30, F.col("pos"))
    df = _users(spark, sf_dir).df.withColumn("_a", F.min(loud).over(_by_user())).withColumn("_z", F.max(loud).over(_by_user()))
    return df.where(F.col("pos").between(F.col("_a"), F.col("_z"))).select("user_id", "pos", "value")


@query(f"with {P}, g as (select distinct user_id, n, unnest(range(0, (n // 2)::bigint)) as j from p), q as (select user_id, j, case when n // 2 > 1 then j * (n - 1)::double / (n // 2 - 1) else 0 end as t from g) select q.user_id, q.j as pos, round(a.value + (b.value - a.value) * (t - floor(t)) + 1e-6, 4) as v from q join p a on a.user_id = q.user_id and a.pos = floor(t)::bigint join p b on b.user_id = q.user_id and b.pos = least(floor(t)::bigint + 1, b.n - 1)")
def resample_signal(spark, sf_dir):
    return _users(spark, sf_dir).resampled("value", F.floor(F.col("_n") / 2)).withColumn("v", r4(F.col("v") + 1e-6))


@query("select l_orderkey, l_linenumber, round(abs(l_quantity) + abs(l_discount) + abs(l_tax), 4) as sma, round(sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax), 4) as magnitude from lineitem")
def sma_magnitude(spark, sf_dir):
    c = [F.col(x) for x in ("l_quantity", "l_discount", "l_tax")]
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r4(C.signal_magnitude_area(*c)).alias("sma"), r4(C.magnitude(*c)).alias("magnitude"))


@query(f"""with {P}, v as (select user_id, pos, value from p union all select user_id, max(n), 0.0 from p group by user_id),
 w as (select user_id, pos, sqrt(sum(value * value) over (partition by user_id order by pos rows between 5 preceding and 4 following) / 10) as r, max(pos) over (partition by user_id) as n from v)
 select user_id, cast(pos / 5 as bigint) as frame, round(r, 4) as v from w where pos % 5 = 0 and pos <= n""")
def rolling_rms(spark, sf_dir):
    return _users(spark, sf_dir).rolling_rms("value", 10, 5).withColumn("v", r4("v"))


@query(f"""with {P}, w as (select user_id, pos, value, n, unnest(range(greatest(0, ceil((pos - 9) / 5.0))::bigint, (pos // 5 + 1)::bigint)) as frame from p)
 select user_id, frame, max(value) as peak, count(*) as n from w where frame * 5 + 10 <= n group by user_id, frame""")
def frame_signal(spark, sf_dir):
    return _users(spark, sf_dir).windows(10, 5).groupBy("user_id", F.col("win").alias("frame")).agg(F.max("value").alias("peak"), F.count("*").alias("n"))


@query(f"with {P} select user_id, cast(pos // 16 as bigint) as chunk, round(sum(value), 2) as total, count(*) as n from p group by user_id, pos // 16")
def create_chunks(spark, sf_dir):
    return _users(spark, sf_dir).batches(16).groupBy("user_id", F.col("batch").alias("chunk")).agg(F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))


@query(f"""with {P}, i as (select user_id, pos, pos - row_number() over (partition by user_id order by pos) as g from p where value > 20)
 select user_id, min(pos) as start, max(pos) + 1 as "end" from i group by user_id, g""")
def continuous_events(spark, sf_dir):
    df = _users(spark, sf_dir).df.withColumn("p", events.above(F.col("value"), 20.0))
    return events.runs(df, ["user_id"], "p")


_RUNS = """{n} as (select user_id, min(pos) as s, max(pos) + 1 as e from (select user_id, pos, pos - row_number() over (partition by user_id order by pos) as g from p where {c}) group by user_id, g)"""


@query(f"""with {P}, {_RUNS.format(n="a", c="value > 20")}, {_RUNS.format(n="b", c="value > 25")},
 j as (select a.user_id, a.s, a.e, coalesce(max(case when least(a.e, b.e) > greatest(a.s, b.s) then (least(a.e, b.e) - greatest(a.s, b.s))::double / ((a.e - a.s) + (b.e - b.s) - (least(a.e, b.e) - greatest(a.s, b.s))) end), 0) as iou from a left join b on a.user_id = b.user_id and a.s < b.e and b.s < a.e group by a.user_id, a.s, a.e),
 c as (select user_id, count(*) filter (iou = 0) as i, count(*) filter (iou > 0 and iou < 0.5) as d, count(*) filter (iou >= 0.5) as c from j group by user_id)
 select user_id, i as insertions, c as corrects, 0::bigint as substitutions, d as deletions, round(case when d + c > 0 then c::double / (d + c) else 0 end, 4) as dr, round(case when c + i > 0 then c::double / (c + i) else 0 end, 4) as reliability, round(case when d + c > 0 then (d + i)::double / (d + c) else 0 end, 4) as erer from c""")
def interval_scores(spark, sf_dir):
    u = _users(spark, sf_dir).df

    def found(threshold):
        r = events.runs(u.withColumn("p", events.above(F.col("value"), threshold)), ["user_id"], "p")
        return r.withColumn("cls", F.lit(1)).withColumn("id", F.col("start"))

    s = events.scores(events.classified(found(20.0), found(25.0), ["user_id"], 0.5), ["user_id"])
    return s.withColumns({c: r4(c) for c in ("dr", "reliability", "erer")})


@query("""with q as (select user_id, event_type, avg(value / 500) as m, stddev_pop(value / 500) as sd from events group by user_id, event_type)
 select user_id, arg_max(event_type, m) as predicted, round(max(m), 4) as mean_pred, round(arg_max(sd, m), 4) as std from q group by user_id""")
def prediction_summary(spark, sf_dir):
    q = _table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg(F.col("value") / 500).alias("m"), F.stddev_pop(F.col("value") / 500).alias("sd"))
    return q.groupBy("user_id").agg(F.max_by("event_type", "m").alias("predicted"), r4(F.max("m")).alias("mean_pred"), r4(F.max_by("sd", "m")).alias("std"))


_PAIRS = [(a, b) for i, a in enumerate(CHANNELS) for b in CHANNELS[i + 1 :]]


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 4) as r from lineitem" for a, b in _PAIRS))
def correlation_pearson(spark, sf_dir):
    return eda.correlation(_table(spark, sf_dir, "lineitem"), CHANNELS).withColumn("r", r4("r"))


@query("with k as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as x, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 as y from part) select 'p_size' as a, 'p_retailprice' as b, round(corr(x, y), 4) as r from k")
def correlation_spearman(spark, sf_dir):
    return eda.correlation(_table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], "spearman").withColumn("r", r4("r"))


@query("select l_orderkey, l_linenumber from (select *, stddev_pop(l_extendedprice) over w as s, avg(l_extendedprice) over w as m from lineitem window w as (partition by l_returnflag)) where abs((l_extendedprice - m) / nullif(s, 0)) < 2")
def outliers_z_score(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem")
    return eda.z_score_kept(df, ["l_extendedprice"], "l_returnflag", 2).select("l_orderkey", "l_linenumber")


@query("with q as (select event_type, quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events group by event_type) select event_id, e.event_type, value from events e join q using (event_type) where value between a - 1.5 * (b - a) and b + 1.5 * (b - a)")
def outliers_iqr(spark, sf_dir):
    return eda.iqr_kept(_table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["value"], "event_type")


@query("select event_id, round((value - avg(value) over ()) / stddev_pop(value) over (), 4) as value from events")
def standard_scaler(spark, sf_dir):
    return eda.standardized(_table(spark, sf_dir, "events").select("event_id", "value"), ["value"]).withColumn("value", r4("value"))


@query("select event_id, round((value - min(value) over ()) / (max(value) over () - min(value) over ()) * 2 - 1, 4) as value from events")
def min_max_scaler(spark, sf_dir):
    return eda.min_max_scaled(_table(spark, sf_dir, "events").select("event_id", "value"), ["value"], -1, 1).withColumn("value", r4("value"))


@query("select event_id, dense_rank() over (order by event_type) - 1 as code from events")
def label_encoder(spark, sf_dir):
    df = _table(spark, sf_dir, "events")
    return df.join(eda.label_codes(df, "event_type").withColumnRenamed("label", "event_type"), "event_type").select("event_id", F.col("code").cast("long").alias("code"))


@query(f"with {P} select user_id, pos, pos < floor(round(n * 0.8, 9)) as train from p")
def train_test_split(spark, sf_dir):
    return _users(spark, sf_dir).split(0.2, by=["user_id"]).select("user_id", "pos", "train")


@query(f"with {P} select a.user_id, a.pos, a.value, round(b.value * 2, 4) as doubled from p a join p b on a.user_id = b.user_id and a.pos = b.pos")
def concat_channels(spark, sf_dir):
    a = _users(spark, sf_dir)
    b = series.SeriesFrame(a.df.select("user_id", "pos", r4(F.col("value") * 2).alias("doubled")), a.key, ("doubled",))
    return a.beside(b).df.select("user_id", "pos", "value", "doubled")


@query(f"with {P} select user_id, cast(floor(pos / 10) as bigint) as batch, count(*) as n, round(sum(value), 2) as total from p group by user_id, floor(pos / 10)")
def batches(spark, sf_dir):
    return _users(spark, sf_dir).batches(10).groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"with {P} select user_id, pos, value as signal from p where pos between 5 and 9")
def select_rows(spark, sf_dir):
    return _users(spark, sf_dir).iloc(5, 10).rename({"value": "signal"}).df.select("user_id", "pos", "signal")


@query("select event_type, round(20 * log10(sqrt(avg(value * value)) / 32768), 4) as dbfs from events group by event_type")
def loudness(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(r4(C.dbfs(F.col("value"), 2)).alias("dbfs"))


@query(f"with {P}, d as (select user_id, pos, 10 * log10(greatest(value, 1e-10)) as v from p) select user_id, pos, round(greatest(v, max(v) over (partition by user_id) - 10), 4) as v from d")
def decibels(spark, sf_dir):
    return _users(spark, sf_dir).df.select("user_id", "pos", r4(C.power_to_db(F.col("value"), top_db=10.0, window=_by_user())).alias("v"))


@query(f"with {P} select user_id, pos, round(avg(value) over (partition by user_id, pos // 4), 4) as v from p")
def pooled(spark, sf_dir):
    return _users(spark, sf_dir).df.select("user_id", "pos", r4(augment.pooled(F.col("value"), 4, ["user_id"])).alias("v"))


@query(f"with {P} select user_id, n - 1 - pos as pos, -value as v from p")
def reversed_inverted(spark, sf_dir):
    return _users(spark, sf_dir).reversed().df.select("user_id", "pos", augment.polarity_inverted(F.col("value")).alias("v"))


@query(f"with recursive {P}, s as (select user_id, pos, value as m, n from p where pos = 0 union all select p.user_id, p.pos, 0.9 * s.m + 0.1 * p.value, p.n from s join p on p.user_id = s.user_id and p.pos = s.pos + 1) select user_id, pos, round(m + 1e-6, 4) as v from s")
def one_pole_smoother(spark, sf_dir):
    a = _users(spark, sf_dir).arrays().select("user_id", F.posexplode(C.one_pole(F.col("value"), 0.1)).alias("pos", "v"))
    return a.select("user_id", F.col("pos").cast("long"), r4(F.col("v") + 1e-6).alias("v"))


@query(f"with {DFT} select vec_id, k as pos, round(mag, 4) as v from m")
def fft_magnitude(spark, sf_dir):
    out = _long(_signals(spark, sf_dir).withColumn("y", signal.fft_magnitude(F.col("x"))), "y")
    return out.withColumn("pos", F.col("pos").cast("long"))


@query(f"with {DFT}, c as (select vec_id, sum(k * mag) / sum(mag) as c, sum(mag) as t from m group by vec_id) select vec_id, round(c, 4) as centroid, round(sqrt(sum((k - c) * (k - c) * mag) / any_value(t)), 4) as spread from m join c using (vec_id) group by vec_id, c")
def spectral_shape(spark, sf_dir):
    s = signal.spectral_features(F.col("x"), 64.0, high=32)
    return _signals(spark, sf_dir).withColumn("s", s).select("vec_id", r4("s.centroid").alias("centroid"), r4("s.spread").alias("spread"))


@query(f"with {E}, f as (select vec_id, sum(x) over w as s, pos from e window w as (partition by vec_id order by pos rows between 2 preceding and 2 following)) select vec_id, pos, round(list_sort([coalesce(lag(x, 1) over w, x), x, coalesce(lead(x, 1) over w, x)])[2], 4) as v from e window w as (partition by vec_id order by pos)")
def median_filter(spark, sf_dir):
    return _long(_signals(spark, sf_dir).withColumn("y", signal.median_filter(F.col("x"), 3)), "y").withColumn("pos", F.col("pos").cast("long"))


@query(f"with {DFT}, t as (select vec_id, sum(mag) as t, sum(k * mag) / sum(mag) as c, sum(mag * mag * case when k in (0, 32) then 1 else 2 end) as pw, sum(k * mag * mag * case when k in (0, 32) then 1 else 2 end) / sum(mag * mag * case when k in (0, 32) then 1 else 2 end) as pm from m group by vec_id), s as (select m.*, t.*exclude(vec_id), sum(mag) over (partition by m.vec_id order by k) as run from m join t using (vec_id)) select vec_id, round(sum(pow(k - c, 3) * mag) / (pow(sqrt(sum(pow(k - c, 2) * mag) / any_value(t)), 3) * any_value(t)), 4) as skewness, round(sum(pow(k - c, 4) * mag) / (pow(sum(pow(k - c, 2) * mag) / any_value(t), 2) * any_value(t)), 4) as kurtosis, round(sqrt(sum(pow(k - pm, 2) * mag * mag * case when k in (0, 32) then 1 else 2 end) / any_value(pw)), 4) as bandwidth, (count(*) filter (run < 0.95 * t))::double as rolloff from s group by vec_id")
def spectral_moments(spark, sf_dir):
    s = signal.spectral_features(F.col("x"), 64.0, high=32)
    return _signals(spark, sf_dir).withColumn("s", s).select("vec_id", r4("s.skewness").alias("skewness"), r4("s.kurtosis").alias("kurtosis"), r4("s.bandwidth").alias("bandwidth"), F.col("s.rolloff").alias("rolloff"))


_WELCH = f"""{E}, g as (select vec_id, {{seg}} as seg, pos - {{hop}} * {{seg}} as j, x from e{{many}}), c as (select *, (x - avg(x) over (partition by vec_id, seg)) * (0.5 - 0.5 * cos(2 * pi() * j / {{n}})) as y from g),
 d as (select vec_id, seg, k.k as k, pow(sum(y * cos(2 * pi() * k.k * j / {{n}})), 2) + pow(sum(y * sin(2 * pi() * k.k * j / {{n}})), 2) as pw from c, (select unnest(range(0, {{n}} // 2 + 1)) as k) k group by vec_id, seg, k.k),
 w as (select vec_id, k, avg(pw) * case when k in (0, {{n}} // 2) then 1 else 2 end / (64 * {{n}} * 0.375) as v from d group by vec_id, k)"""


@query(f"with {_WELCH.format(seg='s.s', hop=16, n=32, many=', (select unnest(range(0, 3)) as s) s where pos between 16 * s.s and 16 * s.s + 31')} select vec_id, k as pos, round(v + 1e-9, 4) as v from w")
def welch_density(spark, sf_dir):
    return _long(_signals(spark, sf_dir).withColumn("y", F.transform(signal.welch_density(F.col("x"), 64.0, 32), lambda v: v + 1e-9)), "y").withColumn("pos", F.col("pos").cast("long"))


@query(f"with {_WELCH.format(seg='0', hop=0, n=64, many='')} select vec_id, arg_max(k, v)::double as v from w group by vec_id")
def dominant_frequency(spark, sf_dir):
    return _signals(spark, sf_dir).select("vec_id", signal.dominant_frequency(F.col("x"), 64.0).alias("v"))


@query(f"with {_WELCH.format(seg='0', hop=0, n=64, many='')}, q as (select vec_id, exp(avg(ln(v + 1e-17))) / avg(v) as flatness, stddev_samp(v) as std from w group by vec_id), m as (select vec_id, k.k as k, sqrt(pow(sum(x * cos(2 * pi() * k.k * pos / n)), 2) + pow(sum(x * sin(2 * pi() * k.k * pos / n)), 2)) as mag from e, (select unnest(range(0, 32)) as k) k group by vec_id, k.k), z as (select vec_id, mag as m0 from m where k = 0), r as (select vec_id, regr_slope(mag, k * 32 / 31.0::double) as slope, sum(case when k > 0 then (mag - m0) / (k * 32 / 31.0::double - 1) end) / sum(case when k > 0 then mag end) as decrease from m join z using (vec_id) group by vec_id) select vec_id, round(flatness, 4) as flatness, round(std, 4) as std, round(slope, 4) as slope, round(decrease, 4) as decrease from q join r using (vec_id)")
def spectral_slopes(spark, sf_dir):
    s = signal.spectral_features(F.col("x"), 64.0, high=32)
    return _signals(spark, sf_dir).withColumn("s", s).select("vec_id", *(r4(f"s.{c}").alias(c) for c in ("flatness", "std", "slope", "decrease")))


_SIMPSON = "case when k in ({a}, {z}) then 1 when (k - {a}) % 2 = 1 then 4 else 2 end * v"


@query(f"with {_WELCH.format(seg='0', hop=0, n=64, many='')}, b as (select vec_id, " + ", ".join(f"sum(case when k between {a} and {z} then {_SIMPSON.format(a=a, z=z)} end) / sum({_SIMPSON.format(a=0, z=32)}) as p{i}" for i, (a, z) in enumerate(((0, 8), (8, 16), (16, 32)))) + " from w group by vec_id) select vec_id, round(p0, 4) as psd_0_8, round(p1, 4) as psd_8_16, round(p2, 4) as psd_16_32 from b")
def power_spectral_density(spark, sf_dir):
    d = _signals(spark, sf_dir).withColumn("y", signal.band_powers(F.col("x"), 64.0, [(0, 8), (8, 16), (16, 32)]))
    return d.select("vec_id", *(r4(F.col("y")[i]).alias(n) for i, n in enumerate(("psd_0_8", "psd_8_16", "psd_16_32"))))


_NEAR = "select e.vec_id, e.pos, round(sum(b.x * {w}) + 1e-7, 4) as v from e, (select unnest(range({a}, {z})) as j) j join e b on b.vec_id = e.vec_id and b.pos = {at} group by e.vec_id, e.pos"


def _filtered(spark, sf_dir, make):
    y = F.transform(make(F.col("x")), lambda v: v + 1e-7)
    return _long(_signals(spark, sf_dir).withColumn("y", y), "y").withColumn("pos", F.col("pos").cast("long"))


@query(f"with {E} {_NEAR.format(w='exp(-j.j * j.j / 2.0) / (select sum(exp(-i * i / 2.0)) from range(-4, 5) t(i))', a=-4, z=5, at='case when e.pos + j.j < 0 then -1 - e.pos - j.j when e.pos + j.j >= e.n then 2 * e.n - 1 - e.pos - j.j else e.pos + j.j end')}")
def gaussian_filter(spark, sf_dir):
    return _filtered(spark, sf_dir, lambda x: signal.gaussian_filter(x, 1.0, samples=64))


@query(f"with {E} {_NEAR.format(w='(0.5 - 0.5 * cos(2 * pi() * (j.j + 3) / 6)) / 3', a=-3, z=4, at='least(greatest(e.pos + j.j, 0), e.n - 1)')}")
def convolve(spark, sf_dir):
    return _filtered(spark, sf_dir, augment.convolved)


@query(f"with {E} {_NEAR.format(w='j.j / 60.0', a=-4, z=5, at='least(greatest(e.pos, 4), e.n - 5) + j.j')}")
def delta(spark, sf_dir):
    return _filtered(spark, sf_dir, signal.delta)


@query(f"with {E} select a.vec_id, a.pos, round(sqrt(any_value(a.x) * any_value(a.x) + pow(sum(case when (a.pos - b.pos) % 2 <> 0 then b.x * 2 / a.n / tan(pi() * (a.pos - b.pos) / a.n) else 0 end), 2)) + 1e-7, 4) as v from e a join e b on a.vec_id = b.vec_id group by a.vec_id, a.pos")
def hilbert_envelope(spark, sf_dir):
    return _filtered(spark, sf_dir, signal.envelope)


@query(f"with {E}, f as (select vec_id, f.f as frame, pos - 4 * f.f + 8 as j, x from e, (select unnest(range(0, 17)) as f) f where pos - 4 * f.f + 8 between 0 and 15), d as (select vec_id, k.k as bin, frame, sqrt(pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 16)) * cos(2 * pi() * k.k * j / 16)), 2) + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 16)) * sin(2 * pi() * k.k * j / 16)), 2)) as v from f, (select unnest(range(0, 9)) as k) k group by vec_id, k.k, frame) select vec_id, bin, frame, round(v + 1e-7, 4) as v from d")
def stft_magnitude(spark, sf_dir):
    d = _signals(spark, sf_dir).select("vec_id", F.posexplode(signal.stft_magnitude(F.col("x"), 16, 4)).alias("bin", "y"))
    return d.select("vec_id", F.col("bin").cast("long"), F.posexplode("y").alias("frame", "v")).select("vec_id", "bin", F.col("frame").cast("long"), r4(F.col("v") + 1e-7).alias("v"))


@query(f"with {E} select vec_id, pos, round(x + 1e-7, 4) as v from e")
def stft_round_trip(spark, sf_dir):
    return _filtered(spark, sf_dir, lambda x: signal.stft_round_trip(x, 16, 4))


@query(f"with {E}, t as (select *, j.j * 63 / 99.0::double as t from (select distinct vec_id from e), (select unnest(range(0, 100)) as j) j) select t.vec_id, t.j as pos, round(a.x + (b.x - a.x) * (t - floor(t)) + 1e-7, 4) as v from t join e a on a.vec_id = t.vec_id and a.pos = floor(t)::bigint join e b on b.vec_id = t.vec_id and b.pos = least(floor(t)::bigint + 1, 63)")
def resize(spark, sf_dir):
    return _filtered(spark, sf_dir, lambda x: augment.resized(x, 100))


@query(f"with {E}, f as (select vec_id, f.f as frame, pos - 8 * f.f as j, x from e, (select unnest(range(0, 7)) as f) f where pos - 8 * f.f between 0 and 15), d as (select vec_id, k.k as bin, frame, sqrt(pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 16)) * cos(2 * pi() * k.k * j / 16)), 2) + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 16)) * sin(2 * pi() * k.k * j / 16)), 2)) / 8 as v from f, (select unnest(range(1, 5)) as k) k group by vec_id, k.k, frame) select vec_id, bin - 1 as bin, frame, round(v + 1e-7, 4) as v from d")
def band_spectrogram(spark, sf_dir):
    d = _signals(spark, sf_dir).select("vec_id", F.posexplode(signal.spectrogram(F.col("x"), 64.0, 16, None, 4.0, 16.0)).alias("bin", "y"))
    return d.select("vec_id", F.col("bin").cast("long"), F.posexplode("y").alias("frame", "v")).select("vec_id", "bin", F.col("frame").cast("long"), r4(F.col("v") + 1e-7).alias("v"))


@query(f"with recursive {E}, s as (select vec_id, pos, x * x as p, x * x as m from e where pos = 0 union all select e.vec_id, e.pos, e.x * e.x, 0.975 * s.m + 0.025 * e.x * e.x from s join e on e.vec_id = s.vec_id and e.pos = s.pos + 1) select vec_id, pos, round(sqrt(p / pow(1e-6 + m, 0.98) + 2) - sqrt(2) + 1e-7, 4) as v from s")
def pcen(spark, sf_dir):
    return _filtered(spark, sf_dir, lambda x: signal.pcen(F.transform(x, lambda v: v * v)))


@query(f"""with {P}, f as (select user_id, frame, j, least(greatest(frame * 5 + j - 5, 0), n - 1) as a, least(greatest(frame * 5 + j - 4, 0), n - 1) as b from (select distinct user_id, n, unnest(range(0, n // 5 + 1)) as frame from p), (select unnest(range(0, 9)) as j))
 select f.user_id, frame, round(sum(case when (x.value < 40) <> (y.value < 40) then 1 else 0 end) / 10.0, 4) as v from f join p x on x.user_id = f.user_id and x.pos = f.a join p y on y.user_id = f.user_id and y.pos = f.b group by f.user_id, frame""")
def rolling_zcr(spark, sf_dir):
    u = _users(spark, sf_dir)
    return u._with(u.df.withColumn("value", F.col("value") - 40)).rolling_zcr("value", 10, 5).withColumn("v", r4("v"))


@query(f"""with {P}, f as (select user_id, frame, j, least(greatest(frame * 5 + j - 5, 0), n - 1) as a, least(greatest(frame * 5 + j - 4, 0), n - 1) as b from (select distinct user_id, n, unnest(range(0, n // 5 + 1)) as frame from p), (select unnest(range(0, 9)) as j)),
 z as (select f.user_id, frame, sum(case when (x.value < 40) <> (y.value < 40) then 1 else 0 end) / 10.0 as v from f join p x on x.user_id = f.user_id and x.pos = f.a join p y on y.user_id = f.user_id and y.pos = f.b group by f.user_id, frame)
 select user_id, round(max(v), 4) as zcr_max, round(avg(v) + 1e-6, 4) as zcr_mean, round(min(v), 4) as zcr_min from z group by user_id""")
def rolling_zcr_extremes(spark, sf_dir):
    u = _users(spark, sf_dir)
    z = u._with(u.df.withColumn("value", F.col("value") - 40)).rolling_zcr("value", 10, 5)
    return z.groupBy("user_id").agg(r4(F.max("v")).alias("zcr_max"), r4(F.avg("v") + 1e-6).alias("zcr_mean"), r4(F.min("v")).alias("zcr_min"))


@query(f"""with {P}, v as (select user_id, pos, value from p union all select user_id, max(n), 0.0 from p group by user_id),
 w as (select user_id, pos, sqrt(sum(value * value) over (partition by user_id order by pos rows between 5 preceding and 4 following) / 10) as r, max(pos) over (partition by user_id) as n from v)
 select user_id, round(max(r), 4) as rms_max, round(avg(r), 4) as rms_mean, round(min(r), 4) as rms_min from w where pos % 5 = 0 and pos <= n group by user_id""")
def rolling_rms_extremes(spark, sf_dir):
    v = _users(spark, sf_dir).rolling_rms("value", 10, 5)
    return v.groupBy("user_id").agg(r4(F.max("v")).alias("rms_max"), r4(F.avg("v")).alias("rms_mean"), r4(F.min("v")).alias("rms_min"))


@query(f"with {P}, k as (select unnest(range(0, (select max(n) // 5 + 4 from p)::bigint)) as win) select user_id, win, win * 5 - 10 as start, round(sum(value), 2) as total, count(*) as n from p join k on pos between win * 5 - 10 and win * 5 + 9 where win * 5 - 10 >= 0 and win * 5 + 10 <= n group by user_id, win")
def rolling_windows(spark, sf_dir):
    return _users(spark, sf_dir).rolling_windows(20, 5).groupBy("user_id", "win").agg(F.first("start").alias("start"), F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))


@query(f"with {P}, w as (select user_id, cast(pos // 4 as bigint) as win, pos % 4 as t, value, n from p) select user_id, win, max(value) filter (t = 0) as \"0_value\", max(value) filter (t = 1) as \"1_value\", max(value) filter (t = 2) as \"2_value\", max(value) filter (t = 3) as \"3_value\" from w where win * 4 + 4 <= n group by user_id, win")
def flattened_windows(spark, sf_dir):
    w = _users(spark, sf_dir).windows(4).groupBy("user_id", "win").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s.value).alias("value"))
    return pipelines.flattened(w, ["value"], 4, "_")


@query(" union all ".join(f"select l_returnflag, '{n}' as feature, round({f.format('l_quantity')}, 4) as l_quantity, round({f.format('l_tax')}, 4) as l_tax from lineitem group by l_returnflag" for n, f in {"mean": "avg({})", "range_0": "min({})", "range_1": "max({})", "rms": "sqrt(avg({0} * {0}))"}.items()))
def scalar_features(spark, sf_dir):
    out = pipelines.scalar_features(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_tax"], {"mean": F.avg, "range": lambda x: [F.min(x), F.max(x)], "rms": C.rms})
    return out.withColumns({c: r4(c) for c in ("l_quantity", "l_tax")})


@query("select l_orderkey, l_linenumber, round(l_quantity / 50, 4) as l_quantity, round(l_quantity / 50 * l_quantity / 50, 4) as power from lineitem")
def column_steps(spark, sf_dir):
    chain = pipelines.Chain([pipelines.ColumnStep(("l_quantity",), lambda x: x / 50), pipelines.ColumnStep(("l_quantity",), lambda x: x * x, ("power",))])
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return chain.fit(df).transform(df).withColumns({c: r4(c) for c in ("l_quantity", "power")})


@query("with m as (" + " union all ".join(f"select {i} as i, quantile_cont(value, {i / 10}) as lo, quantile_cont(value, {(i + 1) / 10}) as hi from events" for i in range(10)) + "), b as (select min(value) as a, max(value) as z from events) select event_id, round(case when value <= a then 0 when value >= z then 1 else (i + (value - lo) / (hi - lo)) / 10 end + 1e-7, 4) as value from events, b, m where (value >= lo and value < hi) or (i = 9 and value >= hi)")
def quantile_transformer(spark, sf_dir):
    out = eda.quantile_transformed(_table(spark, sf_dir, "events").select("event_id", "value"), "value", 11)
    return out.withColumn("value", r4(F.col("value") + 1e-7))


def _guessed(spark, sf_dir):
    return _table(spark, sf_dir, "events").withColumn("predicted", F.when(F.col("value") < 100, "click").otherwise("view"))


_GUESSED = "g as (select event_type as truth, case when value < 100 then 'click' else 'view' end as predicted from events)"


@query(f"with {_GUESSED} select truth, predicted, count(*) as n from g group by truth, predicted")
def confusion_matrix(spark, sf_dir):
    return eda.confusion_matrix(_guessed(spark, sf_dir), "event_type", "predicted")


@query(f"""with {_GUESSED}, l as (select truth as label from g union select predicted from g), c as (select label, (select count(*) from g where truth = label) as support, (select count(*) from g where predicted = label) as named, (select count(*) from g where truth = label and predicted = label) as hit from l)
 select label, round(case when named > 0 then hit / named::double else 0 end, 4) as "precision", round(case when support > 0 then hit / support::double else 0 end, 4) as recall, round(case when named + support > 0 then 2 * hit / (named + support)::double else 0 end, 4) as f1, support from c""")
def classification_report(spark, sf_dir):
    return eda.classification_report(_guessed(spark, sf_dir), "event_type", "predicted").withColumns({c: r4(c) for c in ("precision", "recall", "f1")})


@query("select l_returnflag, round(sqrt(avg(pow(l_extendedprice - l_quantity * 1000, 2))), 2) as rmse, round(avg(abs(l_extendedprice - l_quantity * 1000)), 2) as mae, round(1 - avg(pow(l_extendedprice - l_quantity * 1000, 2)) / var_pop(l_extendedprice), 4) as r2 from lineitem group by l_returnflag")
def regression_report(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").withColumn("guess", F.col("l_quantity") * 1000)
    return eda.regression_report(df, "l_extendedprice", "guess", ["l_returnflag"]).withColumns({"rmse": F.round("rmse", 2), "mae": F.round("mae", 2), "r2": r4("r2")})


@query("select event_id, round(case when value < 50 then (select avg(value) from events where value >= 50) else value end, 4) as value from events")
def imputed(spark, sf_dir):
    df = _table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") < 50, -200.0).otherwise(F.col("value")).alias("value"))
    return eda.imputed(df, ["value"], -200.0).withColumn("value", r4("value"))


@query("select event_id, event_type as label from events")
def label_decoder(spark, sf_dir):
    df = _table(spark, sf_dir, "events")
    codes = eda.label_codes(df, "event_type")
    coded = df.join(codes, df.event_type == codes.label).select("event_id", "code")
    return eda.label_decoded(coded, codes, "code", "label").select("event_id", "label")


@query("""with g as (select l_linenumber as x, l_quantity as y, count(*)::double as n from lineitem group by 1, 2), s as (select sum(sign(b.y - a.y) * a.n * b.n) as s from g a join g b on b.x > a.x), t as (select sum(n) * (sum(n) - 1) / 2 as t from g),
 x as (select sum(n * (n - 1) / 2) as t from (select sum(n) as n from g group by x)), y as (select sum(n * (n - 1) / 2) as t from (select sum(n) as n from g group by y)) select round(s / sqrt((t.t - x.t) * (t.t - y.t)), 4) as tau from s, t, x, y""")
def correlation_kendall(spark, sf_dir):
    return eda.kendall(_table(spark, sf_dir, "lineitem"), "l_linenumber", "l_quantity").withColumn("tau", r4("tau"))


@query("select l_orderkey, l_linenumber, l_quantity, l_quantity * l_quantity as squared from lineitem")
def keep_highly_correlated(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *CHANNELS, (F.col("l_quantity") * F.col("l_quantity")).alias("squared"))
    return eda.keep_highly_correlated(df, [*CHANNELS, "squared"], 0.75)


@query(f"""with {P}, i as (select user_id, pos, value, pos - row_number() over (partition by user_id order by pos) as g from p where value > 20), l as (select user_id, pos, value, count(*) over (partition by user_id, g) as k from i)
 select p.user_id, p.pos, case when k >= 4 then p.value else 0 end as v from p left join l on l.user_id = p.user_id and l.pos = p.pos""")
def duration_threshold(spark, sf_dir):
    df = _users(spark, sf_dir).df.select("user_id", "pos", events.above(F.col("value"), 20.0).alias("v"))
    return events.silenced(df, events.lasting(events.runs(df, ["user_id"], "v"), 8.0, 0.5), ["user_id"], "v").select("user_id", "pos", "v")


@query("""with q as (select user_id, event_type, avg(value) / 2500 as p from events group by user_id, event_type) select user_id, round(sum(-p * log2(p + 1e-12)), 4) as entropy from q group by user_id""")
def prediction_entropy(spark, sf_dir):
    q = _table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((F.avg("value") / 2500).alias("p"))
    s = events.prediction_statistics(q.select("user_id", F.lit(0).alias("repeat"), F.ascii("event_type").alias("cls"), "p"), instance="user_id")
    return s.select("user_id", r4("entropy").alias("entropy"))


@query("with r as (select regr_slope(l_extendedprice, l_quantity) as a, regr_intercept(l_extendedprice, l_quantity) as b from lineitem) select l_orderkey, l_linenumber, round(a * l_quantity + b, 2) as price from lineitem, r")
def linear_regression(spark, sf_dir):
    from pyspark.ml.regression import LinearRegression

    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    step = pipelines.MLStep(LinearRegression(solver="normal"), ["l_quantity"], "l_extendedprice", "price").fit(df)
    return step.transform(df).select("l_orderkey", "l_linenumber", F.round("price", 2).alias("price"))


@query("""with m as (select avg(l_quantity) as a, avg(l_extendedprice / 1000) as b, var_pop(l_quantity) as x, var_pop(l_extendedprice / 1000) as y, covar_pop(l_quantity, l_extendedprice / 1000) as c from lineitem), e as (select *, (x + y) / 2 + sqrt(pow((x - y) / 2, 2) + c * c) as l from m),
 v as (select *, c / sqrt(c * c + pow(l - x, 2)) as u, (l - x) / sqrt(c * c + pow(l - x, 2)) as w from e) select l_orderkey, l_linenumber, round((l_quantity - a) * u + (l_extendedprice / 1000 - b) * w + 1e-7, 3) as pc_0 from lineitem, v""")
def principal_components(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("p"))
    return pipelines.principal_components(df, ["q", "p"], 0.75).select("l_orderkey", "l_linenumber", F.round(F.col("pc_0") + 1e-7, 3).alias("pc_0"))


@query()
def kmeans_clusters(spark, sf_dir):
    from pyspark.ml.clustering import KMeans

    df = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*(F.avg(c).alias(c) for c in CHANNELS))
    return pipelines.MLStep(KMeans(k=4, seed=1), CHANNELS, prefix="cluster").fit(df).transform(df).select("l_suppkey", "cluster")


@query()
def random_forest(spark, sf_dir):
    from pyspark.ml.classification import RandomForestClassifier

    df = _table(spark, sf_dir, "lineitem").withColumn("late", (F.col("l_returnflag") == "N").cast("double"))
    step = pipelines.MLStep(RandomForestClassifier(numTrees=5, maxDepth=4, seed=1), CHANNELS, "late", "predicted").fit(df)
    return step.transform(df).select("l_orderkey", "l_linenumber", "late", "predicted")


def _window_probabilities(spark, sf_dir):
    """Two classes that sum to 1, from the signals as windows of a recording each."""
    d = _signals(spark, sf_dir).select("vec_id", F.posexplode("x").alias("instance", "x"))
    p = 1 / (1 + F.exp(-8 * F.col("x")))
    return d.select("vec_id", "instance", F.lit(0).alias("repeat"), F.posexplode(F.array(p, 1 - p)).alias("cls", "p"))


#: Second derivatives c (in units of a knot's distance) of the not-a-knot spline through y(key, pos, n, v), n > 4. Next to the ends they are second differences; between them the system (1, 4, 1) has a closed inverse, of which 40 places on each side are more than a double can tell.
_SPLINE = """d as (select {k}, pos, n, lead(v) over w - 2 * v + lag(v) over w as d from y window w as (partition by {k} order by pos)),
 r as (select {k}, pos, n, 6 * d - case when pos = 2 then lag(d) over w else 0 end - case when pos = n - 3 then lead(d) over w else 0 end as r from d window w as (partition by {k} order by pos)),
 g as (select {k}, a.pos, any_value(a.n) as n, sum(b.r * (1 - 2 * ((a.pos + b.pos) % 2)) * exp(-abs(a.pos - b.pos) * t) * (1 - exp(-2 * (least(a.pos, b.pos) - 1) * t)) * (1 - exp(-2 * (a.n - 2 - greatest(a.pos, b.pos)) * t)) / (1 - exp(-2 * (a.n - 3) * t)) / (2 * sinh(t))) as c
  from r a join r b using ({k}), (select acosh(2) as t) where a.pos between 2 and a.n - 3 and b.pos between 2 and b.n - 3 and abs(a.pos - b.pos) <= 40 group by {k}, a.pos),
 i as (select {k}, pos, n, c from g union all select {k}, pos, n, d from d where pos in (1, n - 2)),
 c as (select {k}, pos, c from i union all select {k}, 0, sum(case pos when 1 then 2 * c else -c end) from i where pos in (1, 2) group by {k} union all select {k}, any_value(n) - 1, sum(case pos when n - 2 then 2 * c else -c end) from i where pos in (n - 2, n - 3) group by {k}),
 piece as (select {k}, pos, n, v, lead(v) over w - v as slope, c, lead(c) over w as c1 from y join c using ({k}, pos) window w as (partition by {k} order by pos))"""
_CURVE = "v + d * (slope - (2 * c + c1) / 6 + d * (c / 2 + d * (c1 - c) / 6))"


@query(f"with {E}, y as (select vec_id, cls, pos, n, case cls when 0 then 1 / (1 + exp(-8 * x)) else 1 - 1 / (1 + exp(-8 * x)) end as v from e, (select unnest(range(0, 2)) as cls)), {_SPLINE.format(k='vec_id, cls')}, a as (select vec_id, cls, p, v, slope, c, c1, (p - 2) / 4.0::double - pos as d from piece, range(0, 256) t(p) where pos = least(greatest(floor((p - 2) / 4.0::double), 0), n - 2) and p < 4 * n) select vec_id, cls, p as pos, round({_CURVE} + 1e-7, 4) as p from a")
def interpolated_probabilities(spark, sf_dir):
    out = events.interpolated(_window_probabilities(spark, sf_dir), ["vec_id", "cls"], 8.0, 1.0, 0.5)
    return out.select("vec_id", F.col("cls").cast("long"), "pos", r4(F.col("p") + 1e-7).alias("p"))


#: A Butterworth filter of order 3 at half the half rate is y[i] = g[i] - y[i - 2] / 3, so 41 terms of its series are more than a double can tell.
_THIRD = """g{i} as (select vec_id, cls, i, (x + 3 * coalesce(lag(x, 1) over w, f) + 3 * coalesce(lag(x, 2) over w, f) + coalesce(lag(x, 3) over w, f)) / 6 as g from (select *, first_value(x) over (partition by vec_id, cls order by i) as f from x{i}) window w as (partition by vec_id, cls order by i)),
 f{i} as (select a.vec_id, a.cls, a.i, sum(pow(-1 / 3.0::double, k) * b.g) as y from g{i} a, range(0, 41) t(k), g{i} b where b.vec_id = a.vec_id and b.cls = a.cls and b.i = greatest(a.i - 2 * k, 0) group by a.vec_id, a.cls, a.i)"""


@query(f"""with {E}, y as (select vec_id, cls, pos, n, case cls when 0 then 1 / (1 + exp(-8 * x)) else 1 - 1 / (1 + exp(-8 * x)) end as v from e, (select unnest(range(0, 2)) as cls)), {_SPLINE.format(k='vec_id, cls')},
 a as (select vec_id, cls, p, v, slope, c, c1, (p - 2) / 4.0::double - pos as d from piece, range(0, 256) t(p) where pos = least(greatest(floor((p - 2) / 4.0::double), 0), n - 2)), s as (select vec_id, cls, p, {_CURVE} as x from a),
 w as (select *, first_value(x) over (partition by vec_id, cls order by p) as first, first_value(x) over (partition by vec_id, cls order by p desc) as last from s),
 x0 as (select vec_id, cls, p + 12 as i, x from w union all select vec_id, cls, 12 - p, 2 * first - x from w where p between 1 and 12 union all select vec_id, cls, 12 + 510 - p, 2 * last - x from w where p between 243 and 254),
 {_THIRD.format(i=0)}, x1 as (select vec_id, cls, 279 - i as i, y as x from f0), {_THIRD.format(i=1)},
 l as (select vec_id, cls, 267 - i as pos, 267 - i - row_number() over (partition by vec_id, cls order by 267 - i) as g from f1 where i between 12 and 267 and y > 0.55), found as (select vec_id, cls, min(pos) as s, max(pos) + 1 as e from l group by vec_id, cls, g having count(*) >= 2),
 tl as (select vec_id, cls, pos, pos - row_number() over (partition by vec_id, cls order by pos) as g from y where v > 0.6), t as (select vec_id, cls, min(pos) * 4 as s, (max(pos) + 1) * 4 as e, min(pos) * 2 + cls as id from tl group by vec_id, cls, g),
 j as (select r.vec_id, r.cls, r.s, r.e, t.cls as c, (least(r.e, t.e) - greatest(r.s, t.s))::double / (greatest(r.e, t.e) - least(r.s, t.s)) as iou, row_number() over (partition by r.vec_id, r.cls, r.s order by (least(r.e, t.e) - greatest(r.s, t.s))::double / (greatest(r.e, t.e) - least(r.s, t.s)) desc nulls last, t.id) as place from found r left join t on t.vec_id = r.vec_id and r.s < t.e and t.s < r.e),
 n as (select vec_id, count(*) filter (c is null) as i, count(*) filter (iou < 0.5) as d, count(*) filter (iou >= 0.5 and c = cls) as c, count(*) filter (iou >= 0.5 and c <> cls) as s from j where place = 1 group by vec_id)
 select vec_id, i as insertions, c as corrects, s as substitutions, d as deletions, round(case when d + c + s > 0 then c::double / (d + c + s) else 0 end, 4) as dr, round(case when c + i > 0 then c::double / (c + i) else 0 end, 4) as reliability, round(case when d + c + s > 0 then (d + i + s)::double / (d + c + s) else 0 end, 4) as erer from n""")
def robustness_analysis(spark, sf_dir):
    p = _window_probabilities(spark, sf_dir)
    truth = events.runs(p.withColumn("v", events.above(F.col("p"), 0.6)), ["vec_id", "cls"], "v", "instance")
    truth = truth.select("vec_id", "cls", (F.col("start") * 4).alias("start"), (F.col("end") * 4).alias("end"), (F.col("start") * 2 + F.col("cls")).alias("id"))
    out = events.robustness(p, truth, ["vec_id"], 8.0, 1.0, 0.5, 2.0, 0.55, 0.25)["scores"]
    return out.withColumns({c: r4(c) for c in ("dr", "reliability", "erer")})


#: Mel bands of the signals: below 1 kHz the scale is linear, so 6 bands up to 32 Hz are 32/7 Hz apart; a bin is 4 Hz.
_MEL = f"""{E}, f as (select vec_id, f.f as frame, pos - 4 * f.f + 8 as j, x from e, (select unnest(range(0, 17)) as f) f where pos - 4 * f.f + 8 between 0 and 15),
 d as (select vec_id, k.k as bin, frame, pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 16)) * cos(2 * pi() * k.k * j / 16)), 2) + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 16)) * sin(2 * pi() * k.k * j / 16)), 2) as pw from f, (select unnest(range(0, 9)) as k) k group by vec_id, k.k, frame),
 s as (select vec_id, m.m as mel, frame, sum(pw * greatest(0, least(bin * 4 - m.m * 32 / 7.0::double, (m.m + 2) * 32 / 7.0::double - bin * 4)) * 49 / 1024.0::double) as v from d, (select unnest(range(0, 6)) as m) m group by vec_id, m.m, frame)"""


def _framed(d: DataFrame, bins: str) -> DataFrame:
    d = d.select("vec_id", F.posexplode("y").alias(bins, "y")).select("vec_id", F.col(bins).cast("long"), F.posexplode("y").alias("frame", "v"))
    return d.select("vec_id", bins, F.col("frame").cast("long"), r4(F.col("v") + 1e-7).alias("v"))


@query(f"with {_MEL} select vec_id, mel, frame, round(v + 1e-7, 4) as v from s")
def melspectrogram(spark, sf_dir):
    return _framed(_signals(spark, sf_dir).withColumn("y", signal.melspectrogram(F.col("x"), 64.0, 16, 4, 6)), "mel")


@query(f"with {_MEL}, b as (select vec_id, mel, frame, 10 * log10(greatest(v, 1e-10)) as v from s), t as (select vec_id, mel, frame, greatest(v, max(v) over (partition by vec_id) - 80) as v from b) select vec_id, c.c as coefficient, frame, round(sqrt(2 / 6.0::double) * case when c.c = 0 then sqrt(0.5) else 1 end * sum(v * cos(pi() * (2 * mel + 1) * c.c / 12)) + 1e-7, 4) as v from t, (select unnest(range(0, 4)) as c) c group by vec_id, c.c, frame")
def mfcc(spark, sf_dir):
    return _framed(_signals(spark, sf_dir).withColumn("y", signal.mfcc(F.col("x"), 64.0, 4, 16, 4, 6)), "coefficient")


@query(f"with {E}, h as (select a.vec_id, a.pos, atan2(sum(case when (a.pos - b.pos) % 2 <> 0 then b.x * 2 / a.n / tan(pi() * (a.pos - b.pos) / a.n) else 0 end), any_value(a.x)) as w from e a join e b on a.vec_id = b.vec_id group by a.vec_id, a.pos), d as (select vec_id, pos, lead(w) over (partition by vec_id order by pos) - w as d from h) select vec_id, pos, round(case when d > pi() then d - 2 * pi() when d <= -pi() then d + 2 * pi() else d end * 64 / (2 * pi()) + 1e-7, 4) as v from d where d is not null")
def instantaneous_frequency(spark, sf_dir):
    return _filtered(spark, sf_dir, lambda x: signal.instantaneous_frequency(x, 64.0))


@query(f"with {E}, f as (select vec_id, f.f as frame, pos - 8 * f.f + 8 as j, x from e, (select unnest(range(0, 9)) as f) f where pos - 8 * f.f + 8 between 0 and 15), d as (select vec_id, k.k as bin, frame, (pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 16)) * cos(2 * pi() * k.k * j / 16)), 2) + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 16)) * sin(2 * pi() * k.k * j / 16)), 2)) / 64 as v from f, (select unnest(range(0, 9)) as k) k group by vec_id, k.k, frame) select vec_id, bin, frame, round(v + 1e-7, 4) as v from d")
def power_spectrogram(spark, sf_dir):
    return _framed(_signals(spark, sf_dir).withColumn("y", signal.power_spectrogram(F.col("x"), 64.0, 16)), "bin")


@query(f"with {E}, d as (select vec_id, k.k as k, sqrt(pow(sum(x * cos(2 * pi() * k.k * (pos - 21) / 21)), 2) + pow(sum(x * sin(2 * pi() * k.k * (pos - 21) / 21)), 2)) as mag from e, (select unnest(range(0, 14)) as k) k where pos between 21 and 41 group by vec_id, k.k) select vec_id, round(sum(mag) filter (k between 6 and 13) / sum(mag) filter (k < 4), 4) as v from d group by vec_id")
def phase_power_ratio(spark, sf_dir):
    return _signals(spark, sf_dir).select("vec_id", r4(signal.phase_power_ratio(F.col("x"), 8000.0)).alias("v"))


@query(f"with {_MEL}, q as (select i, floor(17 * 700 * (pow(10, i * log10(1 + 32 / 700.0::double) / 7) - 1) / 64) as q from range(0, 8) t(i)), b as (select i - 2 as mel, lag(q, 2) over w as a, lag(q) over w as b, q as c from q window w as (order by i)) select vec_id, mel, frame, round(sum(pw / 64 * case when bin >= a and bin < b then (bin - a) / (b - a) when bin >= b and bin < c then 1 - (bin - b) / (c - b) else 0 end) + 1e-7, 4) as v from d, b where mel >= 0 group by vec_id, mel, frame")
def bin_mel_spectrogram(spark, sf_dir):
    return _framed(_signals(spark, sf_dir).withColumn("y", signal.bin_mel_spectrogram(F.col("x"), 64.0, 16, 4, 6)), "mel")


_MFCC_STATS = """c as (select vec_id, c.c as coefficient, frame, sqrt(2 / 6.0::double) * case when c.c = 0 then sqrt(0.5) else 1 end * sum(v * cos(pi() * (2 * mel + 1) * c.c / 12)) as v from (select vec_id, mel, frame, greatest(10 * log10(greatest(v, 1e-10)), max(10 * log10(greatest(v, 1e-10))) over (partition by vec_id) - 80) as v from s) t, (select unnest(range(0, 4)) as c) c group by vec_id, c.c, frame),
 g as (select vec_id, coefficient, a.f as frame, sum(v * j / 60) as d1, sum(v * (3 * j * j - 20) / 462) as d2 from c, range(0, 17) a(f), range(-4, 5) b(j) where frame = least(greatest(a.f, 4), 12) + j group by vec_id, coefficient, a.f),
 l as (select vec_id, coefficient, avg(v) as mean, stddev_pop(v) as std from c group by vec_id, coefficient), h as (select vec_id, coefficient, avg(d1) as delta, avg(d2) as delta2 from g group by vec_id, coefficient)"""


@query(f"with {_MEL}, {_MFCC_STATS} select vec_id, coefficient, round(mean + 1e-7, 4) as mean, round(std + 1e-7, 4) as std, round(delta + 1e-7, 4) as delta, round(delta2 + 1e-7, 4) as delta2 from l join h using (vec_id, coefficient)")
def mfcc_stats(spark, sf_dir):
    names = ("mean", "std", "delta", "delta2")
    s = _signals(spark, sf_dir).withColumn("s", signal.mfcc_stats(F.col("x"), 64.0, 4, 16, 4, 6))
    s = s.select("vec_id", F.posexplode(F.arrays_zip(*(F.col(f"s.{n}").alias(n) for n in names))).alias("coefficient", "z"))
    return s.select("vec_id", F.col("coefficient").cast("long"), *(r4(F.col(f"z.{n}") + 1e-7).alias(n) for n in names))


@query(f"with {E}, w as (select p, q, (1 + 2 * sum(cos(2 * pi() * k * (p / 48.0::double - q / 64.0::double)))) / 64 as w from range(0, 48) a(p), range(0, 64) b(q), range(1, 25) c(k) group by p, q) select vec_id, p as pos, round(sum(x * w) + 1e-7, 4) as v from e join w on q = pos group by vec_id, p")
def resample_fft(spark, sf_dir):
    return _filtered(spark, sf_dir, lambda x: signal.resample(x, 48))


@query(f"with {E}, y as (select vec_id, pos, n, x as v from e), {_SPLINE.format(k='vec_id')}, a as (select vec_id, p, v, slope, c, c1, p / 2.0::double - pos as d from piece, range(0, 127) t(p) where pos = least(p // 2, n - 2)) select vec_id, p as pos, round({_CURVE} + 1e-7, 4) as v from a")
def interpolate_spline(spark, sf_dir):
    return _filtered(spark, sf_dir, lambda x: signal.interpolate(x, 127))


#: A filter of four poles forwards and backwards over an odd extension of 15 samples. Its analogue form is a fraction of polynomials in s (c0 to c4 below, `top` above as powers of (1 - q) and (1 + q)), with s = (1 - q) / (1 + q) for the delay q; before the first sample its value has been there for ever.
_POLES = f"""{E}, u as (select {{c0}} as c0, {{c1}} as c1, {{c2}} as c2, {{c3}} as c3, {{k}} as k from (select {{given}})),
 o as (select 1 + c3 + c2 + c1 + c0 as a0, (-4 - 2 * c3 + 2 * c1 + 4 * c0) / a0 as a1, (6 - 2 * c2 + 6 * c0) / a0 as a2, (-4 + 2 * c3 - 2 * c1 + 4 * c0) / a0 as a3, (1 - c3 + c2 - c1 + c0) / a0 as a4, {{top}} as b, k / a0 as k, {{level}} as level from u),
 x0 as (select vec_id, pos + 15 as i, x from e union all select vec_id, 15 - pos, 2 * first - x from (select *, first_value(x) over (partition by vec_id order by pos) as first from e) where pos between 1 and 15 union all select vec_id, 15 + n - 1 + n - 1 - pos, 2 * last - x from (select *, first_value(x) over (partition by vec_id order by pos desc) as last from e) where pos between n - 16 and n - 2),
 {{pass1}}, x1 as (select vec_id, 93 - i as i, y1 as x from f0), {{pass2}} select vec_id, 78 - i as pos, round(y1 + 1e-7, 4) as v from f1 where i between 15 and 78"""
_PASS = """g{i} as (select vec_id, i, k * (b[1] * x + b[2] * coalesce(lag(x, 1) over w, f) + b[3] * coalesce(lag(x, 2) over w, f) + b[4] * coalesce(lag(x, 3) over w, f) + b[5] * coalesce(lag(x, 4) over w, f)) as g, f * level as l from (select *, first_value(x) over (partition by vec_id order by i) as f from x{i}), o window w as (partition by vec_id order by i)),
 f{i} as (select vec_id, i, g - (a1 + a2 + a3 + a4) * l as y1, l as y2, l as y3, l as y4 from g{i}, o where i = 0 union all select f.vec_id, g.i, g.g - a1 * f.y1 - a2 * f.y2 - a3 * f.y3 - a4 * f.y4, f.y1, f.y2, f.y3 from f{i} f join g{i} g on g.vec_id = f.vec_id and g.i = f.i + 1, o)"""
_PASSES = {"pass1": _PASS.format(i=0), "pass2": _PASS.format(i=1)}


@query("with recursive " + _POLES.format(given="tan(pi() * 10 / 64) as t, 2 * (cos(pi() / 8) + cos(3 * pi() / 8)) as r", c0="pow(t, 4)", c1="r * pow(t, 3)", c2="(2 + sqrt(2)) * t * t", c3="r * t", k="pow(t, 4)", top="[1, 4, 6, 4, 1]", level="1", **_PASSES))
def butterworth_lowpass(spark, sf_dir):
    return _filtered(spark, sf_dir, lambda x: signal.butterworth(x, 64.0, "lowpass", 10.0, 4, samples=64))


@query("with recursive " + _POLES.format(given="tan(pi() * 12 / 64) - tan(pi() * 5 / 64) as w, tan(pi() * 12 / 64) * tan(pi() * 5 / 64) as m", c0="m * m", c1="sqrt(2) * w * m", c2="2 * m + w * w", c3="sqrt(2) * w", k="w * w", top="[1, 0, -2, 0, 1]", level="0", **_PASSES))
def butterworth_bandpass(spark, sf_dir):
    return _filtered(spark, sf_dir, lambda x: signal.butterworth(x, 64.0, "bandpass", (5.0, 12.0), 2, "sosfiltfilt"))


def _draw(of: str, seed: int = 0) -> str:
    """A seeded draw in SQL: 52 bits of an MD5."""
    return f"(('0x' || substr(md5({of} || ':{seed}'), 1, 13))::bigint / 4503599627370496.0::double)"


_KNOT = "vec_id || ':' || i"


@query(f"with {E}, y as (select vec_id, i as pos, 5 as n, sum(sqrt(-2 * ln(1 - {_draw(_KNOT, 0)})) * cos(2 * pi() * {_draw(_KNOT, 1)})) over (partition by vec_id order by i) as v from embeddings, range(0, 5) t(i)), {_SPLINE.format(k='vec_id')}, a as (select vec_id, p, v, slope, c, c1, p / 15.75::double - pos as d from piece, range(0, 64) t(p) where pos = least(floor(p / 15.75::double), 3)), s as (select vec_id, p, {_CURVE} - first_value({_CURVE}) over (partition by vec_id order by p) as s from a) select vec_id, p as pos, round(x + s / max(abs(s)) over g * 0.5 * (max(x) over g - min(x) over g) + 1e-7, 4) as v from s join e using (vec_id) where p = pos window g as (partition by vec_id)")
def drift(spark, sf_dir):
    return _keyed(spark, sf_dir, augment.drifted)


@query(f"with {E}, u as (select vec_id, i, 1 + 2 * {_draw(_KNOT, 0)} as u from embeddings, range(0, 4) t(i)), k as (select vec_id, i, u / sum(u) over (partition by vec_id) * 63 as step, (sum(u) over (partition by vec_id order by i) - u) / sum(u) over (partition by vec_id) * 63 as start from u), a as (select vec_id, p, start + (p / 15.75::double - i) * step as place from k, range(0, 64) t(p) where i = least(floor(p / 15.75::double), 3)) select a.vec_id, p as pos, round(sum(x * greatest(0, 1 - abs(place - pos))) + 1e-7, 4) as v from a join e on e.vec_id = a.vec_id and abs(place - pos) <= 1 group by a.vec_id, p")
def time_warp(spark, sf_dir):
    return _keyed(spark, sf_dir, augment.time_warped)


def _keyed(spark, sf_dir, make):
    return _filtered(spark, sf_dir, lambda x: make(x, F.col("vec_id")))


#: The complex STFT of the signals (16 samples, every 4), and the way back from (vec_id, frame, bin, re, im) in z.
_HANN = "(0.5 - 0.5 * cos(2 * pi() * j / 16))"
_STFT = f"""{E}, f as (select vec_id, f.f as frame, pos - 4 * f.f + 8 as j, x from e, (select unnest(range(0, 17)) as f) f where pos - 4 * f.f + 8 between 0 and 15),
 z0 as (select vec_id, frame, bin, sum(x * {_HANN} * cos(2 * pi() * bin * j / 16)) as re, -sum(x * {_HANN} * sin(2 * pi() * bin * j / 16)) as im, sqrt(re * re + im * im) as mag from f, range(0, 9) k(bin) group by vec_id, frame, bin)"""
_ISTFT = f"sum(case when bin in (0, 8) then 1 else 2 end * (re * cos(2 * pi() * bin * j / 16) - im * sin(2 * pi() * bin * j / 16)) / 16 * {_HANN}) / (sum({_HANN} * {_HANN}) / 9)"
_MIDDLE = "select z0.vec_id, z0.{a}, z0.{b}, any_value(z0.re) as re, any_value(z0.im) as im, median(y.mag) as m from z0, range(-2, 3) o(o), z0 y where y.vec_id = z0.vec_id and y.{a} = z0.{a} and y.{b} = case when z0.{b} + o < 0 then -1 - z0.{b} - o when z0.{b} + o > {last} then 2 * {last} + 1 - z0.{b} - o else z0.{b} + o end group by z0.vec_id, z0.{a}, z0.{b}"


@query(f"with {_STFT}, h as ({_MIDDLE.format(a='bin', b='frame', last=16)}), p as ({_MIDDLE.format(a='frame', b='bin', last=8)}), m as (select h.vec_id, h.frame, h.bin, h.re, h.im, case when h.m + p.m = 0 then 0.5 else h.m * h.m / (h.m * h.m + p.m * p.m) end as mask from h join p using (vec_id, frame, bin)), y as (select kind, vec_id, frame, bin, re * case kind when 0 then mask else 1 - mask end as re, im * case kind when 0 then mask else 1 - mask end as im from m, range(0, 2) t(kind)), o as (select kind, vec_id, 4 * frame + j - 8 as pos, {_ISTFT} as v from y, range(0, 16) t(j) where 4 * frame + j - 8 between 0 and 63 group by kind, vec_id, pos) select vec_id, pos, round(max(v) filter (kind = 0) + 1e-7, 4) as harmonic, round(max(v) filter (kind = 1) + 1e-7, 4) as percussive from o group by vec_id, pos")
def hpss(spark, sf_dir):
    h = _signals(spark, sf_dir).withColumn("h", signal.hpss(F.col("x"), 16, 5))
    h = h.select("vec_id", F.posexplode(F.arrays_zip(F.col("h.harmonic").alias("a"), F.col("h.percussive").alias("b"))).alias("pos", "z"))
    return h.select("vec_id", F.col("pos").cast("long"), r4(F.col("z.a") + 1e-7).alias("harmonic"), r4(F.col("z.b") + 1e-7).alias("percussive"))


def _rebuilt(rounds: int) -> str:
    """Signals from magnitudes: each round goes to the signal and back, and keeps the phases of what it finds less a share of the round before."""
    back = f"select vec_id, 4 * frame + j - 8 as pos, {_ISTFT} as x from {{z}}, range(0, 16) t(j) where 4 * frame + j - 8 between 0 and 63 group by vec_id, pos"
    out = "y0 as materialized (select vec_id, frame, bin, mag, mag as re, 0 as im, 0 as now_re, 0 as now_im from z0)"
    for i in range(rounds):
        out += f""", x{i} as materialized ({back.format(z=f'y{i}')}), f{i} as (select vec_id, f as frame, pos - 4 * f + 8 as j, x from x{i}, range(0, 17) t(f) where pos - 4 * f + 8 between 0 and 15),
 n{i} as (select vec_id, frame, bin, sum(x * {_HANN} * cos(2 * pi() * bin * j / 16)) as re, -sum(x * {_HANN} * case when bin in (0, 8) then 0 else sin(2 * pi() * bin * j / 16) end) as im from f{i}, range(0, 9) k(bin) group by vec_id, frame, bin),
 s{i} as (select vec_id, frame, bin, mag, n.re as now_re, n.im as now_im, n.re - 99 / 199.0::double * y.now_re as a, n.im - 99 / 199.0::double * y.now_im as b from y{i} y join n{i} n using (vec_id, frame, bin)),
 y{i + 1} as materialized (select vec_id, frame, bin, mag, now_re, now_im, mag * a / (sqrt(a * a + b * b) + 1e-16) as re, mag * b / (sqrt(a * a + b * b) + 1e-16) as im from s{i})"""
    return f"{out}, o as ({back.format(z=f'y{rounds}')}) select vec_id, pos, round(x + 1e-7, 4) as v from o"


@query(f"with {_STFT}, {_rebuilt(8)}")
def griffin_lim(spark, sf_dir):
    return _filtered(spark, sf_dir, lambda x: signal.griffin_lim(x, 16, 8))


#: The STFT at another pace. Whole turns are nothing to a phase, so it is that of the first frame plus the differences of the frames passed.
_STRETCH = f"""{_STFT}, q as (select vec_id, frame, bin, mag, atan2(im, re) as angle from z0 union all select distinct vec_id, 17 + i, bin, 0, 0 from z0, range(0, 2) t(i)),
 s as (select m, m * {{rate}} as place, floor(place)::bigint as frame from range(0, {{frames}}) t(m)),
 v as (select vec_id, bin, frame, mag, angle, lead(mag) over w as mag1, lead(angle) over w - angle as turn, first_value(angle) over w as first from q window w as (partition by vec_id, bin order by frame)),
 a as (select vec_id, bin, m as frame, mag + (place - frame) * (mag1 - mag) as mag, first + coalesce(sum(turn) over (partition by vec_id, bin order by m rows between unbounded preceding and 1 preceding), 0) as phase from v join s using (frame)),
 y as (select vec_id, frame, bin, mag * cos(phase) as re, mag * sin(phase) as im from a),
 o as (select vec_id, 4 * frame + j - 8 as pos, sum(case when bin in (0, 8) then 1 else 2 end * (re * cos(2 * pi() * bin * j / 16) - case when bin in (0, 8) then 0 else im end * sin(2 * pi() * bin * j / 16)) / 16 * {_HANN}) / (sum({_HANN} * {_HANN}) / 9) as v from y, range(0, 16) t(j) where 4 * frame + j - 8 between 0 and {{length}} - 1 group by vec_id, pos)"""


@query(f"with {_STRETCH.format(rate=1.5, frames=12, length=43)} select vec_id, pos, round(v + 1e-7, 4) as v from o")
def time_stretch(spark, sf_dir):
    return _filtered(spark, sf_dir, lambda x: signal.time_stretch(x, 1.5, 16))


@query(f"with {_STRETCH.format(rate='pow(2, -0.25)', frames=21, length=76)}, w as (select p, q, (1 + 2 * sum(cos(2 * pi() * k * (p / 64.0::double - q / 76.0::double)))) / 76 as w from range(0, 64) a(p), range(0, 76) b(q), range(1, 33) c(k) group by p, q) select vec_id, p as pos, round(sum(v * w) + 1e-7, 4) as v from o join w on q = pos group by vec_id, p")
def pitch_shift(spark, sf_dir):
    return _filtered(spark, sf_dir, lambda x: signal.pitch_shift(x, 3, 16))


@query("with recursive g as (select vec_id, embedding::double[] as x, list_sort(embedding::double[]) as s from embeddings), c as (select vec_id, x, list_sort(list_distinct([s[1 + floor(h)::bigint] + (h - floor(h)) * (s[2 + floor(h)::bigint] - s[1 + floor(h)::bigint]) for h in [(len(x) - 1) * (i + 0.5::double) / 4 for i in range(0, 4)]])) as m, 0 as r, false as done from g union all select vec_id, x, n, r + 1, n = m from (select *, [coalesce(list_avg([v for v in x if (k = 1 or v > (m[k] + m[k - 1]) / 2) and (k = len(m) or v <= (m[k] + m[k + 1]) / 2)]), m[k]) for k in range(1, len(m) + 1)] as n from c where r < 100 and not done)), l as (select vec_id, arg_max(m, r) as m, any_value(x) as x from c group by vec_id) select vec_id, pos, round(m[1 + len([k for k in range(1, len(m)) if x[pos + 1] > (m[k] + m[k + 1]) / 2])] + 1e-7, 4) as v from l, range(0, 64) t(pos)")
def quantize_kmeans(spark, sf_dir):
    return _filtered(spark, sf_dir, lambda x: augment.quantized_kmeans(x, 4))


#: Filters of two poles in eight bands at once, over odd extensions of 9 samples: k, b1, b2 above and a1, a2 below for the delays, `level` for a value that has been there for ever.
_TWO = """w{i} as (select vec_id, band, pos, x, first_value(x) over v as first, last_value(x) over (v rows between unbounded preceding and unbounded following) as last from {x} window v as (partition by vec_id, band order by pos)),
 x{i} as (select vec_id, band, pos + 9 as i, x from w{i} union all select vec_id, band, 9 - pos, 2 * first - x from w{i} where pos between 1 and 9 union all select vec_id, band, 135 - pos, 2 * last - x from w{i} where pos between 54 and 62),
 {there}, z{i} as (select vec_id, band, 81 - i as i, y1 as x from f{i}), {back}, o{i} as (select vec_id, band, 72 - i as pos, y1 as x from fz{i} where i between 9 and 72)"""
_TWO_PASS = """g{i} as materialized (select vec_id, band, i, k * (x + b1 * coalesce(lag(x, 1) over w, f) + b2 * coalesce(lag(x, 2) over w, f)) as g, f * level as l, a1, a2 from (select *, first_value(x) over (partition by vec_id, band order by i) as f from {x}) join {o} using (band) window w as (partition by vec_id, band order by i)),
 f{i} as (select vec_id, band, i, g - (a1 + a2) * l as y1, l as y2 from g{i} where i = 0 union all select f.vec_id, f.band, g.i, g.g - g.a1 * f.y1 - g.a2 * f.y2, f.y1 from f{i} f join g{i} g on g.vec_id = f.vec_id and g.band = f.band and g.i = f.i + 1)"""


def _two(i: int, x: str, o: str) -> str:
    return _TWO.format(i=i, x=x, there=_TWO_PASS.format(i=i, x=f"x{i}", o=o), back=_TWO_PASS.format(i=f"z{i}", x=f"z{i}", o=o))


@query(f"""with recursive {E}, t as (select band, tan(pi() * (50 * band + 100) / 1000) - tan(pi() * (50 * band + 50) / 1000) as w, tan(pi() * (50 * band + 100) / 1000) * tan(pi() * (50 * band + 50) / 1000) as m, tan(pi() * 10 / 1000) as q from range(0, 8) t(band)),
 pass as (select band, w / (1 + w + m) as k, 0 as b1, -1 as b2, (2 * m - 2) / (1 + w + m) as a1, (1 - w + m) / (1 + w + m) as a2, 0 as level from t),
 low as (select band, q * q / (1 + sqrt(2) * q + q * q) as k, 2 as b1, 1 as b2, (2 * q * q - 2) / (1 + sqrt(2) * q + q * q) as a1, (1 - sqrt(2) * q + q * q) / (1 + sqrt(2) * q + q * q) as a2, 1 as level from t),
 each as (select vec_id, band, pos, x from e, range(0, 8) t(band)), {_two(0, "each", "pass")}, energy as (select vec_id, band, pos, x * x as x from o0), {_two(1, "energy", "low")},
 step as (select vec_id, band, pos, sign(lead(x) over (partition by vec_id, band order by pos) - x) as s from o1), turn as (select vec_id, band, s, lag(s) over (partition by vec_id, band order by pos) as before from step where s <> 0)
 select vec_id, band, count(*) filter (before > 0 and s < 0) as peaks from turn group by vec_id, band""")
def envelope_peaks(spark, sf_dir):
    d = _signals(spark, sf_dir).select("vec_id", F.posexplode(signal.envelope_peaks(F.col("x"), 1000.0)).alias("band", "peaks"))
    return d.select("vec_id", F.col("band").cast("long"), F.col("peaks").cast("long"))


def _rows_only(name: str, make: Callable[[DataFrame], DataFrame]) -> None:
    _QUERIES[name] = (lambda spark, sf_dir: make(_signals(spark, sf_dir)), None)


_X = F.col  # columns are made when a query runs
for _name, _make in {
    "mel_to_audio": lambda d: _long(d.withColumn("y", signal.mel_round_trip(_X("x"), 64.0, 16, 4, 6, 8)), "y"),
}.items():
    _rows_only(_name, _make)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql}


from . import extra  # noqa: E402, F401  (adds its queries)
