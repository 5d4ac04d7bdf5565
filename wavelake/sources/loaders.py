"""Labelled file collections as DataFrames: the class is the parent folder, the id the file name."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _place(path: Column) -> tuple[Column, Column]:
    return F.regexp_extract(path, r"([^/]+)/[^/]*$", 1), F.url_decode(F.regexp_extract(path, r"([^/]+)$", 1))


def _roots(path: str, classes: list[str] | None) -> list[str]:
    """With classes, only their folders are listed at all."""
    return [f"{path.rstrip('/')}/{c}" for c in classes] if classes else [path]


def csv_dir(spark: SparkSession, path: str, channels: list[str] | None = None, classes: list[str] | None = None, schema: str | None = None, **options) -> DataFrame:
    """(label, id, pos, channels...): every CSV below `path`. With a `schema` the files are read once, without one twice, to infer it. An unreadable file fails the job; ignoreCorruptFiles=True skips it."""
    read = spark.read.options(header=True, inferSchema=schema is None, recursiveFileLookup=True, pathGlobFilter="*.csv", enforceSchema=False).options(**options)
    read = read.schema(schema) if schema else read
    df = read.csv(_roots(path, classes))
    keep = channels or df.columns
    label, name = _place(F.col("_metadata.file_path"))
    df = df.select(label.alias("label"), name.alias("id"), F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_n"), *(F.col(f"`{c}`") for c in keep))
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("_f").orderBy("_n")) - 1).select("label", "id", "pos", *(f"`{c}`" for c in keep))


def numbered(df: DataFrame, name: str = "pos") -> DataFrame:
    """Row numbers in the order of the files: places within the read partitions, plus the sizes of those before. Nothing is sorted, and the table of partitions alone is gathered."""
    own = df.withColumn("_n", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_n", 33))
    sizes = own.groupBy("_part").agg(F.count("*").alias("_k"))
    sizes = sizes.select("_part", (F.sum("_k").over(Window.orderBy("_part")) - F.col("_k")).alias("_before"))  # a row for each partition
    return own.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))).drop("_n", "_part", "_before")


def csv_file(spark: SparkSession, path: str, names: list[str] | None = None, **options) -> DataFrame:
    """One CSV, with row numbers; without a header if names are given."""
    df = spark.read.options(header=names is None, inferSchema=True).options(**options).csv(path)
    if names is not None:
        if len(names) != len(df.columns):
            raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
        df = df.toDF(*names)
    return numbered(df)


def json_dir(spark: SparkSession, path: str, classes: list[str] | None = None) -> DataFrame:
    """(label, id, value): each JSON file whole, as a VARIANT; files that don't parse are left out."""
    df = spark.read.options(recursiveFileLookup=True, pathGlobFilter="*.json", wholetext=True).text(_roots(path, classes))
    label, name = _place(F.col("_metadata.file_path"))
    value = F.try_parse_json("value")
    return df.select(label.alias("label"), F.regexp_replace(name, r"\.json$", "").alias("id"), value.alias("value")).where("value is not null")


def _chunks(content: bytes) -> dict[bytes, bytes]:
    """The parts of a RIFF file, the first of each name."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    out, at = {}, 12
    while at + 8 <= len(content):
        name, size = struct.unpack_from("<4sI", content, at)
        out.setdefault(name, content[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def _format(chunks: dict[bytes, bytes]) -> tuple[int, int, int, int]:
    """Kind (1: integers, 3: floats), channels, sampling rate, bytes of a sample."""
    if len(chunks.get(b"fmt ", b"")) < 16:
        raise ValueError("a WAV file without a format")
    kind, n, sr, _, _, bits = struct.unpack_from("<HHIIHH", chunks[b"fmt "])
    if kind == 0xFFFE and len(chunks[b"fmt "]) >= 26:  # the extended form names the kind further on
        kind = struct.unpack_from("<H", chunks[b"fmt "], 24)[0]
    if (kind, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)} or not n:
        raise ValueError(f"unknown WAV format {kind} of {bits} bits")
    return kind, n, sr, bits // 8


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Sampling rate and samples (channel, position): integers as floats in [-1, 1], floats as they are."""
    chunks = _chunks(content)
    kind, n, sr, width = _format(chunks)
    raw = chunks.get(b"data", b"")
    raw = raw[: len(raw) // (n * width) * n * width]
    if kind == 3:
        return sr, np.frombuffer(raw, f"<f{width}").astype(float).reshape(-1, n).T
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) - 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(float)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(float)
    return sr, (x / 2.0 ** (8 * width - 1)).reshape(-1, n).T


def wav_dir(spark: SparkSession, path: str, classes: list[str] | None = None, target_sr: int | None = None) -> DataFrame:
    """(label, id, sr, channels, error): every WAV below `path`, an array for each channel; a file that can't be read has an error instead."""
    df = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.wav").load(_roots(path, classes))
    label, name = _place(F.col("path"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for content in p["content"]:
                try:
                    sr, x = decode_wav(content)
                    if target_sr and target_sr != sr:
                        n = int(x.shape[1] / sr * target_sr)
                        x = np.stack([np.interp(np.linspace(0, x.shape[1] - 1, n), np.arange(x.shape[1]), c) for c in x])
                    out.append((target_sr or sr, [c.tolist() for c in x], None))
                except (struct.error, ValueError) as e:
                    out.append((None, None, str(e) or type(e).__name__))
            yield p[["label", "id"]].assign(sr=pd.array([o[0] for o in out], dtype="Int32"), channels=[o[1] for o in out], error=[o[2] for o in out])

    return df.select(label.alias("label"), name.alias("id"), "content").mapInPandas(run, "label string, id string, sr int, channels array<array<double>>, error string")


def wav_header(content: bytes) -> dict:
    chunks = _chunks(content)
    _, n, sr, width = _format(chunks)
    return {"nchannels": n, "sampwidth": width, "framerate": sr, "nframes": len(chunks.get(b"data", b"")) // (n * width)}


def wav_headers(spark: SparkSession, path: str, classes: list[str] | None = None) -> DataFrame:
    """(label, id, nchannels, sampwidth, framerate, nframes, error) of every WAV below `path`."""
    df = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.wav").load(_roots(path, classes))
    label, name = _place(F.col("path"))
    fields = ["nchannels", "sampwidth", "framerate", "nframes"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = []
            for content in p["content"]:
                try:
                    found.append(wav_header(content) | {"error": None})
                except (struct.error, ValueError) as e:
                    found.append(dict.fromkeys(fields) | {"error": str(e) or type(e).__name__})
            out = pd.DataFrame(found, columns=[*fields, "error"]).astype(dict.fromkeys(fields, "Int64"))
            yield pd.concat([p[["label", "id"]].reset_index(drop=True), out], axis=1)

    return df.select(label.alias("label"), name.alias("id"), "content").mapInPandas(run, "label string, id string, nchannels long, sampwidth long, framerate long, nframes long, error string")


def file_types(spark: SparkSession, path: str) -> list[str]:
    """Lower-cased extensions of the files below `path`: a handful, from a listing that reads no contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    kinds = files.select(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind")).distinct()
    return sorted(r.kind for r in kinds.collect() if r.kind)


def load_dir(spark: SparkSession, path: str, kind: str | None = None, classes: list[str] | None = None, **options) -> DataFrame:
    """CSV, JSON or WAV files below `path`; the kind may be left out if there is only one."""
    readers = {"csv": csv_dir, "json": json_dir, "wav": wav_dir}
    if kind is None:
        kinds = file_types(spark, path)
        if len(kinds) != 1:
            raise ValueError(f"one kind of file is needed, found {kinds}")
        kind = kinds[0]
    if kind not in readers:
        raise ValueError(f"unknown kind {kind}; known are {sorted(readers)}")
    return readers[kind](spark, path, classes=classes, **options)


def yaml_config(path: str) -> dict:
    """A YAML file on the driver, read safely. PyYAML is optional; without it this raises ImportError."""
    import yaml

    with open(path, encoding="utf-8") as f:
        try:
            return yaml.safe_load(f)
        except yaml.YAMLError as e:
            raise ValueError(f"{path} is no valid YAML: {e}") from e
