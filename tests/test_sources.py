import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.operators import augment, eda
from wavelake.operators.series import SeriesFrame
from wavelake.sources import loaders


def test_csv_and_json_dirs(spark, tmp_path):
    for label in ("a", "b"):
        (tmp_path / label).mkdir()
        (tmp_path / label / "one.csv").write_text("x,y\n" + "".join(f"{i},{i * 2}\n" for i in range(5)))
        (tmp_path / label / "one.json").write_text('{"foo": 1}')
    (tmp_path / "a" / "bad.json").write_text("{nothing")
    df = loaders.csv_dir(spark, str(tmp_path), ["y"], ["b"])
    assert [tuple(r) for r in df.orderBy("pos").collect()] == [("b", "one.csv", i, i * 2) for i in range(5)]
    assert {(r.label, r.id) for r in loaders.json_dir(spark, str(tmp_path)).select("label", "id").collect()} == {("a", "one"), ("b", "one")}
    with pytest.raises(ValueError):
        loaders.csv_file(spark, str(tmp_path / "a" / "one.csv"), ["only"])


def test_wav_dir(spark, tmp_path):
    (tmp_path / "k").mkdir()
    x = (np.sin(np.arange(800)) * 20000).astype("<i2")
    with wave.open(str(tmp_path / "k" / "t.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000), w.writeframes(x.tobytes())
    (tmp_path / "k" / "bad.wav").write_bytes(b"no wave")
    rows = {r.id: r for r in loaders.wav_dir(spark, str(tmp_path)).collect()}
    assert rows["bad.wav"].error and rows["t.wav"].sr == 8000 and np.allclose(rows["t.wav"].channels, x.reshape(-1, 2).T / 32768)


def test_series_operators(spark):
    df = spark.createDataFrame([("s", i, float(i), i % 2) for i in range(10)], "k string, t int, v double, y int")
    s = SeriesFrame.ordered(df, ["k"], ["t"], ["v"], ["y"])
    assert s.iloc(2, 4).df.count() == 2 and s.loc(2, 4).df.count() == 3
    assert s.append(s).df.count() == 20 and s.rename({"v": "w"}).channels == ("w",) and s.drop(["v"]).channels == ()
    with pytest.raises(ValueError):
        s.rename({"v": "y"})
    with pytest.raises(ValueError):
        s.windows(5, 5)
    assert s.windows(4, 2).select("win").distinct().count() == 4
    half = SeriesFrame(s.df.where("pos < 3").withColumn("v", F.lit(-1.0)), s.key, s.channels)
    assert [r.v for r in s.replaced(half).df.orderBy("pos").collect()] == [-1.0] * 3 + [float(i) for i in range(3, 10)]
    assert s.split(0.25, seed=3).where("train").count() == 7 and s.split(0.25, up=True).where("train").count() == 8


def test_kendall_and_augment(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (4, 4), (4, 4)], "a int, b int")
    assert abs(eda.kendall(df, "a", "b").first().tau - 7 / 9) < 1e-9
    s = spark.range(50).select(F.lit("k").alias("k"), F.col("id").alias("pos"), F.col("id").cast("double").alias("v"))
    noisy = augment.augmented(s, [lambda d, k: d.withColumn("v", augment.white_noise(F.col("v"), 0.1, ["k"], seed=k))], 2)
    assert noisy.count() == 150 and noisy.where("repeat = 1").agg(F.avg("v")).first()[0] != noisy.where("repeat = 2").agg(F.avg("v")).first()[0]


def test_ranks_without_a_global_sort(spark):
    rng = np.random.default_rng(5)
    x = np.where(rng.random(3000) < 0.3, 7.0, np.round(rng.normal(size=3000) * 300))
    y = np.round(x / 50 + rng.normal(size=3000) * 3)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0)], "x double, y double")
    ranks = {r.x: r.before for r in eda.value_ranks(df, "x").collect()}
    assert ranks == {v: int((x < v).sum()) for v in set(x.tolist())}
    sign = np.sign(x[:, None] - x[None]) * np.sign(y[:, None] - y[None])
    n = len(x) * (len(x) - 1) / 2
    ties = [sum(k * (k - 1) / 2 for k in np.unique(v, return_counts=True)[1]) for v in (x, y)]
    want = sign.sum() / 2 / np.sqrt((n - ties[0]) * (n - ties[1]))
    assert eda.kendall(df, "x", "y").first().tau == pytest.approx(want, abs=1e-12)
    assert eda.correlation(df, ["x", "y"], "kendall").first().r == pytest.approx(want, abs=1e-12)
    assert eda.kendall(df.limit(0), "x", "y").first().tau is None


def test_row_numbers_and_dispatch(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "one.csv").write_text("x\n" + "".join(f"{i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = loaders.csv_file(spark, str(tmp_path / "k" / "one.csv"))
        assert df.count() == 5000 and df.where("pos <> x").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert loaders.file_types(spark, str(tmp_path)) == ["csv"] and loaders.load_dir(spark, str(tmp_path)).count() == 5000
    with pytest.raises(ValueError):
        loaders.load_dir(spark, str(tmp_path), "mp3")
    with wave.open(str(tmp_path / "k" / "t.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\0" * 400)
    (tmp_path / "k" / "bad.wav").write_bytes(b"no")
    rows = {r.id: r for r in loaders.wav_headers(spark, str(tmp_path)).collect()}
    assert (rows["t.wav"].nchannels, rows["t.wav"].framerate, rows["t.wav"].nframes) == (2, 8000, 100) and rows["bad.wav"].error
    with pytest.raises(ValueError):
        loaders.load_dir(spark, str(tmp_path))
