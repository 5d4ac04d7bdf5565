import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavelake.functions import kernels as K
from wavelake.operators import augment, signal
from wavelake.sources import loaders, memory


def test_round_trips(spark):
    x = np.arange(24.0).reshape(2, 4, 3)
    s = memory.from_numpy(spark, x, [7, 8], ["a", "b", "c"])
    got, y = memory.to_numpy(s)
    assert (got == x).all() and y[:, 0, 0].tolist() == [7, 8] and s.targets == ("y_0",)
    one, _ = memory.to_numpy(memory.from_numpy(spark, x[0]))
    assert (one == x[0]).all()
    f = pd.DataFrame({"v": [1.0, 2.0], "w": [3.0, 4.0], "k": ["p", "q"]})
    t = memory.from_pandas(spark, [f, f.iloc[:1]], ["k"], ["one", "two"])
    assert [(k, a.shape, b[:, 0].tolist()) for k, a, b in memory.to_list(t)] == [(("one",), (2, 2), ["p", "q"]), (("two",), (1, 2), ["p"])]
    with pytest.raises(ValueError):
        memory.to_numpy(t)
    assert memory.to_dict(memory.from_dict(spark, {"v": [1, 2]}))["v"] == [1, 2]
    u = memory.from_list(spark, [[[1, 2]], [[3, 4], [5, 6]]], y=["a", "b"])
    assert {r.series: r.n for r in u.lengths().collect()} == {0: 1, 1: 2}
    for bad in (lambda: memory.from_numpy(spark, x, [1, 2, 3]), lambda: memory.from_numpy(spark, x, names=["a"]), lambda: memory.from_list(spark, [[[1, 2]], [[3]]]), lambda: memory.from_pandas(spark, [f, f[["v"]]])):
        with pytest.raises(ValueError):
            bad()


def test_indexing(spark):
    x = np.arange(30.0).reshape(10, 3)
    s = memory.from_numpy(spark, x, names=["a", "b", "c"])
    for at, rows, cols in (((slice(2, 9, 3), slice(None)), [2, 5, 8], [0, 1, 2]), ((4, "b"), [4], [1]), (([1, 7], ["c", "a"]), [1, 7], [2, 0]), ((slice(None), slice("b", "c")), range(10), [1, 2]), ((slice(3), -1), range(3), [2])):
        got, _ = memory.to_numpy(s[at])
        assert (got == x[list(rows)][:, cols]).all()
    assert memory.to_numpy(s[3])[0].tolist() == [x[3].tolist()]
    with pytest.raises(KeyError):
        s[0, "d"]
    with pytest.raises(IndexError):
        s[-2:]


def _wav(kind, dtype, x, sr=8000):
    raw, width = x.astype(dtype).tobytes(), np.dtype(dtype).itemsize
    fmt = struct.pack("<HHIIHH", kind, x.shape[1], sr, sr * width * x.shape[1], width * x.shape[1], 8 * width)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(raw)) + raw
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_files_with_roles(spark, tmp_path):
    (tmp_path / "k").mkdir()
    x = np.sin(np.arange(40.0)).reshape(20, 2)
    (tmp_path / "k" / "f.wav").write_bytes(_wav(3, "<f4", x))
    (tmp_path / "k" / "d.wav").write_bytes(_wav(3, "<f8", x[:, :1]))
    (tmp_path / "k" / "odd.wav").write_bytes(_wav(1, "<f8", x))
    rows = {r.id: r for r in loaders.wav_dir(spark, str(tmp_path)).collect()}
    assert np.allclose(rows["f.wav"].channels, x.T) and np.allclose(rows["d.wav"].channels, x[:, :1].T) and rows["odd.wav"].error
    assert {r.id: r.nframes for r in loaders.wav_headers(spark, str(tmp_path)).collect()} == {"f.wav": 20, "d.wav": 20, "odd.wav": None}
    got, _ = memory.to_numpy(memory.load_file(spark, str(tmp_path / "k" / "f.wav")))
    assert np.allclose(got, x, atol=1e-6)
    (tmp_path / "k" / "one.csv").write_text("x,y,t\n" + "".join(f"{i},{i * 2},{i % 2}\n" for i in range(5)))
    s = memory.load_file(spark, str(tmp_path / "k" / "one.csv"), targets=["t"])
    assert s.channels == ("x", "y") and memory.to_numpy(s)[0].tolist() == [[i, 2 * i] for i in range(5)]
    d = memory.load_dir(spark, str(tmp_path), channels=["y"], schema="x int, y int, t int")
    assert memory.to_list(d)[0][0] == ("k", "one.csv") and memory.to_pandas(d)["class"].tolist() == ["k"] * 5


def test_draws_and_nulls(spark):
    df = spark.createDataFrame([(1, [float(i % 5) for i in range(16)]), (2, [float(i % 5) for i in range(16)]), (3, None), (4, [1.0, 2.0, 5.0] * 10)], "k long, x array<double>")
    for f in (augment.drifted, augment.time_warped):
        a, b = ({r.k: r.y for r in df.select("k", f(df.x, df.k).alias("y")).collect()} for _ in range(2))
        assert a == b and a[1] != a[2] and a[3] is None and len(a[4]) == 30
    got = {r.k: r.y for r in df.select("k", signal.gaussian_filter(df.x, 1.0, samples=16).alias("y")).collect()}
    assert got[1] == got[2] and got[3] is None and len(got[4]) == 30


def test_long_spline():
    x = np.linspace(0, 20, 100_001)
    at = np.linspace(0.3, 19.7, 1000)
    assert np.allclose(K.cubic_spline(x, np.sin(x), at), np.sin(at), atol=1e-9)
    for n in (4, 5, 9):
        t = np.sort(np.random.default_rng(n).random(n)) * 5
        assert np.allclose(K.cubic_spline(t, t**3 - 2 * t, at / 4), (at / 4) ** 3 - at / 2)  # a cubic is its own spline


def test_warps_of_odd_signals(spark):
    """Null, empty, single and constant signals; a row's draws depend on its key alone."""
    df = spark.createDataFrame([(1, None), (2, []), (3, [5.0]), (4, [2.0] * 6), (5, [0.0, 1.0, 0.0, 3.0]), (5, [0.0, 1.0, 0.0, 3.0])], "k long, x array<double>")
    for f in (augment.drifted, augment.time_warped):
        got = [r.y for r in df.select("k", f(F.col("x"), F.col("k")).alias("y")).collect()]
        assert got[0] is None and got[1] == [] and got[2] == [5.0]
        assert got[3] == pytest.approx([2.0] * 6)
        assert got[4] == got[5] and len(got[4]) == 4
