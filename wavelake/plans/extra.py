"""More named queries with their SQL twins: conversions, masks, seeded augmentation, row sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as K
from ..operators import augment, eda, events, pipelines, relations, signal
from .catalog import _QUERIES, CHANNELS, E, P, _draw, _long, _signals, _table, _users, query, r4


_AT = "(user_id || ':' || pos)"
_NORMAL = f"(sqrt(-2 * ln(1 - {_draw(_AT)})) * cos(2 * pi() * {_draw(_AT, 1)}))"


@query(f"with {P} select user_id, pos, round(value + 0.1 * stddev_pop(value) over (partition by user_id) * {_NORMAL} + 1e-6, 4) as v from p")
def white_noise(spark, sf_dir):
    return _users(spark, sf_dir).df.select("user_id", "pos", r4(augment.white_noise(F.col("value"), 0.1, ["user_id"]) + 1e-6).alias("v"))


@query(f"with {P}, u as (select *, {_draw(_AT)} - 0.5 as u from p) select user_id, pos, round(value + 0.1 * -sign(u) * ln(1 - 2 * abs(u) + 1e-300) * (max(value) over w - min(value) over w) + 1e-6, 4) as v from u window w as (partition by user_id)")
def laplace_noise(spark, sf_dir):
    return _users(spark, sf_dir).df.select("user_id", "pos", r4(augment.noise(F.col("value"), ["user_id"], distribution="laplace") + 1e-6).alias("v"))


@query(f"with {P} select user_id, pos, round(value * (1 + 0.1 * 2 * ({_draw(_AT)} - 0.5)) + 1e-6, 4) as v from p")
def multiplicative_noise(spark, sf_dir):
    return _users(spark, sf_dir).df.select("user_id", "pos", r4(augment.noise(F.col("value"), ["user_id"], distribution="uniform", kind="multiplicative") + 1e-6).alias("v"))


@query(f"with {P} select user_id, pos, round(value * (0.1 + (0.12 - 0.1) * {_draw('user_id')}) + 1e-6, 4) as v from p")
def random_gain(spark, sf_dir):
    return _users(spark, sf_dir).df.select("user_id", "pos", r4(augment.random_gain(F.col("value"), ["user_id"]) + 1e-6).alias("v"))


@query(f"""with {P}, k as (select user_id, pos, case when {_draw("(user_id || ':' || (pos // 2))")} >= 0.3 then value end as kept from p)
 select user_id, pos, coalesce(last_value(kept ignore nulls) over (partition by user_id order by pos rows between unbounded preceding and current row), first_value(kept ignore nulls) over (partition by user_id order by pos rows between current row and unbounded following)) as v from k""")
def dropout(spark, sf_dir):
    return _users(spark, sf_dir).df.select("user_id", "pos", augment.dropped_out(F.col("value"), 0.3, ["user_id"], size=2).alias("v"))


@query(f"with {E}, s as (select *, floor({_draw('vec_id')} * (n - 16 + 1))::bigint as s from e) select vec_id, pos - s as pos, round(x, 4) as v from s where pos - s between 0 and 15")
def crop(spark, sf_dir):
    return _long(_signals(spark, sf_dir).withColumn("y", augment.cropped(F.col("x"), 16, F.col("vec_id"))), "y").withColumn("pos", F.col("pos").cast("long"))


@query(f"with {P} select user_id, pos, case when {_draw('user_id', 7)} < 0.5 then -value else value end as v from p")
def sometimes_inverted(spark, sf_dir):
    return _users(spark, sf_dir).df.select("user_id", "pos", augment.maybe(augment.polarity_inverted(F.col("value")), F.col("value"), 0.5, F.col("user_id"), seed=7).alias("v"))


@query(f"with {P}, r as (select user_id, pos, value, least(floor(case when max(value) over w > min(value) over w then (value - min(value) over w) / (max(value) over w - min(value) over w) else 0 end * 5), 4) as l, min(value) over w as a, max(value) over w as b from p window w as (partition by user_id)) select user_id, pos, round(a + (l + 0.5) * (b - a) / 5 + 1e-6, 4) as v from r")
def quantized(spark, sf_dir):
    return _users(spark, sf_dir).df.select("user_id", "pos", r4(augment.quantized(F.col("value"), 5, ["user_id"]) + 1e-6).alias("v"))


@query("select event_id, round(20 * log10(value / 100), 4) as amplitude, round(10 * log10(value / 100), 4) as power from events")
def ratio_to_db(spark, sf_dir):
    x = F.col("value")
    return _table(spark, sf_dir, "events").select("event_id", r4(C.ratio_to_db(x, F.lit(100.0))).alias("amplitude"), r4(C.ratio_to_db(x / 100, amplitude=False)).alias("power"))


@query("select event_id, round(20 * log10(greatest(value / 100, 1e-5)), 4) as db, round(pow(10, value / 1000), 4) as power, round(pow(10, value / 2000), 4) as amplitude from events")
def decibel_inverses(spark, sf_dir):
    x = F.col("value") / 100
    return _table(spark, sf_dir, "events").select("event_id", r4(C.amplitude_to_db(x)).alias("db"), r4(C.db_to_power(x)).alias("power"), r4(C.db_to_amplitude(x)).alias("amplitude"))


_HZ = "value * 20"


@query(f"""select event_id, round(case when {_HZ} < 1000 then {_HZ} * 3 / 200 else 15 + 27 * ln(greatest({_HZ}, 1000) / 1000) / ln(6.4) end, 4) as mel, round(2595 * log10(1 + {_HZ} / 700), 4) as mel_htk,
 round(case when value / 10 < 15 then value / 10 * 200 / 3 else 1000 * exp((value / 10 - 15) * ln(6.4) / 27) end, 3) as hz, round(700 * (pow(10, value / 2595) - 1), 4) as hz_htk from events""")
def mel_scales(spark, sf_dir):
    f, m = F.col("value") * 20, F.col("value")
    return _table(spark, sf_dir, "events").select("event_id", r4(C.hz_to_mel(f)).alias("mel"), r4(C.hz_to_mel(f, True)).alias("mel_htk"), F.round(C.mel_to_hz(m / 10), 3).alias("hz"), r4(C.mel_to_hz(m, True)).alias("hz_htk"))


@query(f"with {E}, f as (select distinct vec_id, n, unnest(range(0, 70)) as pos from e) select f.vec_id, f.pos, round(coalesce(a.x, 0), 4) as fixed, round(coalesce(b.x, 0), 4) as centred from f left join e a on a.vec_id = f.vec_id and a.pos = f.pos left join e b on b.vec_id = f.vec_id and b.pos = f.pos - 3")
def fixed_lengths(spark, sf_dir):
    both = _signals(spark, sf_dir).select("vec_id", F.arrays_zip(C.fix_length(F.col("x"), 70).alias("a"), C.pad_center(F.col("x"), 70).alias("b")).alias("z"))
    return both.select("vec_id", F.posexplode("z").alias("pos", "z")).select("vec_id", F.col("pos").cast("long"), r4("z.a").alias("fixed"), r4("z.b").alias("centred"))


@query(f"with {P} select user_id, frame, frame * 16 + 32 as sample, round((frame * 16 + 32) / 100.0, 4) as seconds from (select distinct user_id, unnest(range(0, n // 16)) as frame from p)")
def frame_times(spark, sf_dir):
    n = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.floor(F.count("*") / 16).cast("int").alias("n")).where("n > 0")
    z = n.select("user_id", F.posexplode(F.arrays_zip(C.samples_like(F.col("n"), 16, 64).alias("s"), C.times_like(F.col("n"), 100.0, 16, 64).alias("t"))).alias("frame", "z"))
    return z.select("user_id", F.col("frame").cast("long"), F.col("z.s").alias("sample"), r4("z.t").alias("seconds"))


@query("select k as bin, k * 22050 / 64.0::double as hz from (select unnest(range(0, 33)) as k)")
def fft_bins(spark, sf_dir):
    return spark.range(1).select(F.posexplode(C.fft_frequencies(22050, 64)).alias("bin", "hz")).withColumn("bin", F.col("bin").cast("long"))


@query("select event_id, round(value * value / (value * value + 10000), 4) as mask, round(case when value > 0 then value / (value + 50) end, 4) as soft from events")
def soft_masks(spark, sf_dir):
    x = F.col("value")
    return _table(spark, sf_dir, "events").select("event_id", r4(C.softmask(x, F.lit(100.0), 2.0)).alias("mask"), r4(C.softmask(x, F.lit(50.0))).alias("soft"))


@query(f"with {E} select vec_id, pos, round(x / max(abs(x)) over w + 1e-7, 4) as peak, round(x / sum(abs(x)) over w + 1e-7, 4) as l1, round(x / sqrt(sum(x * x) over w) + 1e-7, 4) as l2 from e window w as (partition by vec_id)")
def normalized_vectors(spark, sf_dir):
    out = _signals(spark, sf_dir)
    for name, norm in (("peak", float("inf")), ("l1", 1), ("l2", 2)):
        out = out.withColumn(name, signal.on_arrays(lambda v, norm=norm: K.normalized(v, norm))(F.col("x")))
    out = out.select("vec_id", F.posexplode(F.arrays_zip("peak", "l1", "l2")).alias("pos", "z"))
    return out.select("vec_id", F.col("pos").cast("long"), *(r4(F.col(f"z.{c}") + 1e-7).alias(c) for c in ("peak", "l1", "l2")))


@query(f"with {P} select user_id, pos, value from p where pos < 3 or pos between 5 and 7")
def appended(spark, sf_dir):
    u = _users(spark, sf_dir)
    return u.iloc(0, 3).append(u.iloc(5, 8)).df.select("user_id", "pos", "value")


@query(f"with {P} select user_id, pos, case when pos < 5 then value * 2 else value end as value from p")
def replaced_values(spark, sf_dir):
    u = _users(spark, sf_dir)
    first = u.iloc(0, 5)
    return u.replaced(first._with(first.df.withColumn("value", F.col("value") * 2))).df.select("user_id", "pos", "value")


@query(f"with {P} select user_id, pos, value from p where pos between 5 and 9")
def labelled_rows(spark, sf_dir):
    return _users(spark, sf_dir).loc(5, 9, ["value"]).df.select("user_id", "pos", "value")


@query(f"with {P} select user_id, pos, event_type from p")
def dropped_channels(spark, sf_dir):
    u = _users(spark, sf_dir).drop(["value"])
    return u.df.select(*u.columns)


@query(f"with {P} select user_id, pos, value from p")
def shuffled_rows(spark, sf_dir):
    return _users(spark, sf_dir).shuffled(3).select("user_id", "pos", "value")


@query("select event_id, value from events where user_id in (select c_custkey from customer where c_acctbal > 0)")
def present_keys(spark, sf_dir):
    rich = _table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return relations.present(_table(spark, sf_dir, "events"), rich, ["user_id"]).select("event_id", "value")


@query("select event_id, value from events where user_id not in (select c_custkey from customer where c_acctbal > 0)")
def absent_keys(spark, sf_dir):
    rich = _table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return relations.absent(_table(spark, sf_dir, "events"), rich, ["user_id"]).select("event_id", "value")


def _sides(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.where("value < 60").select("user_id", "event_type"), e.where("value > 40").select("user_id", "event_type")


@query("select user_id, event_type from events where value < 60 intersect select user_id, event_type from events where value > 40")
def shared_rows(spark, sf_dir):
    return relations.shared_rows(*_sides(spark, sf_dir))


@query("select user_id, event_type from events except select user_id, event_type from events where value > 150")
def own_rows(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return relations.own_rows(e.drop("value"), e.where("value > 150").drop("value"))


@query("select distinct user_id, event_type from events")
def distinct_rows(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("user_id", "event_type").distinct()


@query("""with r as (select user_id, ts, max(value) as value from events where event_type = 'view' group by user_id, ts) select e.event_id, r.value as past_value from (select * from events where event_type = 'click') e asof left join r on e.user_id = r.user_id and e.ts >= r.ts""")
def as_of_join(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return relations.as_of(e.where("event_type = 'click'").drop("value"), e.where("event_type = 'view'"), ["user_id"], "ts", ["value"]).select("event_id", "past_value")


@query(f"""with {P}, g as (select user_id, pos, case when value >= 20 then value end as value from p) select user_id, pos, coalesce(last_value(value ignore nulls) over (partition by user_id order by pos rows between unbounded preceding and current row), first_value(value ignore nulls) over (partition by user_id order by pos rows between current row and unbounded following)) as value from g""")
def filled_gaps(spark, sf_dir):
    d = _users(spark, sf_dir).df.withColumn("value", F.when(F.col("value") >= 20, F.col("value")))
    return relations.filled(d, "value", ["user_id"]).select("user_id", "pos", "value")


@query("select event_id, value from events order by value desc, event_id limit 50")
def top_rows(spark, sf_dir):
    return relations.top(_table(spark, sf_dir, "events").select("event_id", "value"), 50, F.desc("value"), "event_id")


@query("select user_id, round(avg(value) filter (event_type = 'click'), 4) as click, round(avg(value) filter (event_type = 'view'), 4) as view from events group by user_id")
def pivoted_means(spark, sf_dir):
    return relations.pivoted(_table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", ["click", "view"]).select("user_id", r4("click").alias("click"), r4("view").alias("view"))


@query("select l_returnflag, l_linestatus, count(*) as n, grouping(l_returnflag) + grouping(l_linestatus) as level from lineitem group by rollup (l_returnflag, l_linestatus)")
def rolled_up_counts(spark, sf_dir):
    return relations.levels(_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(f"with {P} select user_id, pos, round(cos(value / 100), 4) as re, round(sin(value / 100), 4) as im from p")
def phasors(spark, sf_dir):
    return _users(spark, sf_dir).df.select("user_id", "pos", *(r4(c).alias(n) for n, c in C.phasor(F.col("value") / 100).items()))


@query("select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax from lineitem")
def without_redundant(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_quantity") * 3).alias("tripled"))
    return df.drop(*eda.redundant(df, [*CHANNELS, "tripled"], 0.99))


@query("with m as (select var_pop(l_quantity) as x, var_pop(l_extendedprice / 1000) as y, covar_pop(l_quantity, l_extendedprice / 1000) as c from lineitem) select 0 as component, round(((x + y) / 2 + sqrt(pow((x - y) / 2, 2) + c * c)) / (x + y), 4) as share from m union all select 1, round(((x + y) / 2 - sqrt(pow((x - y) / 2, 2) + c * c)) / (x + y), 4) from m")
def explained_variance(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("p"))
    return pipelines.explained_variance(df, ["q", "p"]).withColumn("share", r4("share"))


_SHAPE, _MOMENTS, _SLOPES = (_QUERIES[n][1] for n in ("spectral_shape", "spectral_moments", "spectral_slopes"))


@query(f"select * from ({_SHAPE}) join ({_MOMENTS}) using (vec_id) join ({_SLOPES}) using (vec_id)")
def spectral_values(spark, sf_dir):
    s = _signals(spark, sf_dir).withColumn("s", signal.spectral_features(F.col("x"), 64.0, high=32))
    return s.select("vec_id", *(F.col(f"s.{c}").alias(c) if c == "rolloff" else r4(f"s.{c}").alias(c) for c in ("centroid", "spread", "skewness", "kurtosis", "bandwidth", "rolloff", "flatness", "std", "slope", "decrease")))


@query(f"""with {P}, r as (select user_id, min(pos) as s, max(pos) + 1 as e from (select user_id, pos, pos - row_number() over (partition by user_id order by pos) as g from p where value > 20) group by user_id, g),
 a as (select user_id, s, e from r where s % 2 = 0), b as (select user_id, s + 1 as s, e + 1 as e from r)
 select a.user_id, a.s as start, round(max(greatest(0, least(a.e, b.e) - greatest(a.s, b.s))::double / greatest((a.e - a.s) + (b.e - b.s) - greatest(0, least(a.e, b.e) - greatest(a.s, b.s)), 1)), 4) as iou from a join b on a.user_id = b.user_id and a.s < b.e and b.s < a.e group by a.user_id, a.s""")
def best_overlaps(spark, sf_dir):
    u = _users(spark, sf_dir).df
    r = events.runs(u.withColumn("p", events.above(F.col("value"), 20.0)), ["user_id"], "p").withColumn("cls", F.lit(1)).withColumn("id", F.col("start"))
    out = events.classified(r.where("start % 2 = 0"), r.withColumn("start", F.col("start") + 1).withColumn("end", F.col("end") + 1), ["user_id"], 0.5, width=4)
    return out.where("iou > 0").select("user_id", "start", r4("iou").alias("iou"))


@query(f"with {P} select user_id, chunk, round(sum(value), 2) as total from (select user_id, pos // 8 as chunk, value from p where pos // 8 < least(n // 8, 3)) group by user_id, chunk")
def split_parts(spark, sf_dir):
    a = _users(spark, sf_dir).arrays().select("user_id", F.posexplode(augment.parts(F.col("value"), 8, 3)).alias("chunk", "x"))
    return a.select("user_id", F.col("chunk").cast("long"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 2).alias("total"))

