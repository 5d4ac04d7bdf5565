import numpy as np
import pytest
from pyspark.ml.feature import MinMaxScaler, StandardScaler
from pyspark.sql import functions as F

from wavelake.functions import kernels as K
from wavelake.operators import augment, eda, events, pipelines
from wavelake.operators.series import SeriesFrame


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, float(a), float(3 * a + b), float(b)) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))], "id int, a double, b double, c double")


def test_ml_steps_keep_names_and_can_be_saved(table, tmp_path):
    chain = pipelines.Chain([pipelines.MLStep(StandardScaler(withMean=True), ["a", "b"]), lambda d: d.withColumn("a", F.col("a") * 2), pipelines.MLStep(MinMaxScaler(min=-1.0, max=1.0), ["c"])])
    with pytest.raises(ValueError):
        chain.steps[0].transform(table)
    with pytest.raises(TypeError):
        pipelines.save(chain, str(tmp_path / "m"))
    fitted = chain.fit(table)
    out = fitted.transform(table)
    assert sorted(out.columns) == ["a", "b", "c", "id"]
    low, high, sd = out.agg(F.min("c"), F.max("c"), F.stddev("a")).first()
    assert (round(low, 9), round(high, 9), round(sd, 9)) == (-1, 1, 2)
    pipelines.save(fitted, str(tmp_path / "m"))
    again = pipelines.load(chain, str(tmp_path / "m")).transform(table)
    assert [tuple(r) for r in again.orderBy("id").collect()] == [tuple(r) for r in out.orderBy("id").collect()]


def test_column_steps_and_shapes(table):
    with pytest.raises(KeyError):
        pipelines.ColumnStep(("nothing",), F.abs).transform(table)
    wide = table.groupBy().agg(F.sort_array(F.collect_list("a")).alias("x"), F.sort_array(F.collect_list("b")).alias("y")).select(F.lit(1).alias("k"), F.slice("x", 1, 3).alias("x"), F.slice("y", 1, 3).alias("y"))
    flat = pipelines.flattened(wide, ["x", "y"], 3)
    assert flat.columns == ["k", "0,x", "0,y", "1,x", "1,y", "2,x", "2,y"]
    assert pipelines.unflattened(flat, ["x", "y"], 3).first() == wide.first()
    doubled = pipelines.channelwise(pipelines.signal_features(table, ["a", "b"], {"m": lambda a, b: a + b}), ["m"], lambda x: x * 2)
    assert all(abs(r.m - 2 * (r.a + r.b)) < 1e-12 for r in doubled.collect())


def test_principal_components(table):
    x = np.array([[r.a, r.b, r.c] for r in table.orderBy("id").collect()])
    out = pipelines.principal_components(table, ["a", "b", "c"], 0.999)
    ours = np.array([[r.pc_0, r.pc_1] for r in out.orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert "pc_2" not in out.columns and np.allclose(np.abs(ours), np.abs(u * s)[:, :2])


def test_quantile_transformer_and_redundant(spark, table):
    out = eda.quantile_transformed(table, "a", 60, "u").orderBy("a").collect()
    assert np.allclose([r.u for r in out], np.linspace(0, 1, 60))
    ties = spark.createDataFrame([(v,) for v in [1.0, 1.0, 2.0, 2.0, 2.0, 3.0, None]], "v double")
    got = {r.v: r.u for r in eda.quantile_transformed(ties, "v", 6, "u").collect()}
    assert got[1.0] == 0 and got[3.0] == 1 and got[2.0] == pytest.approx(0.6) and got[None] is None
    assert eda.redundant(table, ["a", "b", "c"], 0.9) == ["b"] and eda.highly_correlated(table, ["a", "b", "c"], 0.9) == ["a", "b"]


def test_rolling_windows(spark):
    df = spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    s = SeriesFrame.ordered(df, ["k"], ["t"], ["v"])
    for centred, n, first in ((True, 9, 0), (False, 8, 1)):
        w = s.rolling_windows(20, 10, centred)
        assert w.groupBy("win").count().where("count = 20").count() == n and w.agg(F.min("start")).first()[0] == first


def test_robustness_of_a_perfect_model(spark):
    """Ten windows of class 0, ten of class 1: two events, both found."""
    p = spark.createDataFrame([("f", i, r, c, 0.97 if (i >= 10) == (c == 1) else 0.03) for i in range(20) for r in range(2) for c in range(2)], "file string, instance int, repeat int, cls int, p double")
    items = spark.createDataFrame([("f", [(0.0, 10.0, "rest", "time"), (100.0, 200.0, "run", "samples"), (1.0, 2.0, "unknown", "time")])], "file string, items array<struct<start: double, end: double, label: string, type: string>>")
    truth = events.true_events(items, ["rest", "run"], 10.0)
    assert [tuple(r) for r in truth.orderBy("id").collect()] == [("f", 0, 0, 100, 0), ("f", 1, 100, 200, 1), ("f", 2, 10, 20, None)]
    out = events.robustness(p, truth.where("cls is not null"), ["file"], 10.0, 1.0, 0.0, 2.0)
    score = out["scores"].first()
    assert (score.insertions, score.corrects, score.substitutions, score.deletions, score.dr) == (0, 2, 0, 0, 1.0)
    stats = out["statistics"].where("instance = 12").first()
    assert stats.predicted == 1 and stats.mean_pred == pytest.approx(0.97) and stats["std"] == pytest.approx(0)
    inside = out["thresholded"].where("p > 0").groupBy("cls").count().collect()
    assert {r.cls for r in inside} == {0, 1} and out["smoothed"].count() == 400


def test_probabilities_by_batches(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "i int, x array<double>")
    out = events.probabilities(df, "x", lambda m: m / m.sum(1, keepdims=True), 2)
    assert out.count() == 20 and all(abs(r.p - r.i / (r.i + 1)) < 1e-12 for r in out.where("cls = 0").collect())


def test_augmentations(spark):
    s = spark.range(40).select(F.lit("k").alias("k"), F.col("id").alias("pos"), F.col("id").cast("double").alias("v"))
    for d in ("gaussian", "laplace", "uniform"):
        for kind in ("additive", "multiplicative"):
            made = s.withColumn("w", augment.noise(F.col("v"), ["k"], distribution=d, kind=kind)).collect()
            assert any(r.v != r.w for r in made) and all(np.isfinite(r.w) for r in made)
    for fill in ("ffill", "bfill", "mean", -1.0):
        got = s.withColumn("w", augment.dropped_out(F.col("v"), 0.3, ["k"], fill=fill, size=2)).orderBy("pos").collect()
        assert 0 < sum(r.v != r.w for r in got) < 40 and all(r.w is not None for r in got)
    levels = augment.quantized_by_rank(s, "v", 4, ["k"]).groupBy("v").count().collect()
    assert len(levels) == 4 and all(9 <= r["count"] <= 11 for r in levels)
    arrays = s.agg(F.sort_array(F.collect_list("v")).alias("x"))
    row = arrays.select(augment.resized(F.col("x"), 79).alias("r"), augment.parts(F.col("x"), 15).alias("p"), augment.parts(F.col("x"), 15, 1).alias("q"), augment.quantized_kmeans(F.col("x"), 2).alias("m")).first()
    assert np.allclose(row.r, np.arange(79) / 2) and [len(p) for p in row.p] == [15, 15] and len(row.q) == 1 and sorted(set(row.m)) == [9.5, 29.5]


def test_spectrogram_kernels():
    fs, t = 1000.0, np.arange(1000) / 1000
    x = np.sin(2 * np.pi * 125 * t)
    f, at, z = K.plain_spectrogram(x, fs, 64, low=50, high=200)
    assert f[0] == 62.5 and f[-1] == 187.5 and at[0] == 0.032 and np.allclose(np.abs(z[f == 125.0]), 0.5)
    f, at, z = K.plain_spectrogram(x, fs, 64, extended=True)
    assert at[0] == 0 and z.shape == (33, 1 + int(np.ceil(1000 / 32)))
    bank = K.bin_mel_filters(16000, 512, 20)
    assert bank.shape == (20, 257) and bank.min() >= 0 and bank.max() == 1
    assert K.bin_mel_spectrogram(x, fs, 128, 32, 8).shape[0] == 8
    mel = K.melspectrogram(x, fs, 64, 16, 12)
    again = K.mel_filters(fs, 64, 12) @ K.mel_to_stft(mel, fs, 64) ** 2
    assert np.allclose(again, mel, atol=1e-3 * mel.max())
    mag, phase = K.magphase(np.array([0, 3 + 4j]), 2)
    assert mag.tolist() == [0, 25] and np.allclose(phase, [1, 0.6 + 0.8j])
    steady = K.window_sumsquare("hann", 20, 4, 16)[16:-16]
    assert np.allclose(steady, steady[0])
    assert K.smoothing(22050, 512, 0.4) == pytest.approx(0.0564, abs=1e-3)


def test_normalized():
    s = np.array([[3.0, 0.0], [-4.0, 0.0]])
    assert np.allclose(K.normalized(s, 2)[:, 0], [0.6, -0.8]) and np.allclose(K.normalized(s)[:, 0], [0.75, -1])
    assert np.allclose(K.normalized(s, 2, fill=True)[:, 1], np.sqrt(0.5)) and np.allclose(K.normalized(s, 1, fill=False)[:, 1], 0)
    assert K.normalized(s, None) is s and np.allclose(K.normalized(s, 0)[:, 0], [1.5, -2])
    with pytest.raises(ValueError):
        K.normalized(s, threshold=0)
