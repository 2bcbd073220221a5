"""Logs and binary packet files as tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): lines that are JSON objects give their ``msg`` (and ``ts``), others themselves; torn lines stay text."""
    raw = spark.read.text(path).withColumn("file", F.input_file_name())
    own = F.try_parse_json("value")
    msg = F.coalesce(F.try_variant_get(own, "$.msg", "string"), F.col("value"))
    return raw.select("file", msg.alias("line"), F.try_variant_get(own, "$.ts", "double").alias("ts"))


def extracted(lines: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Lines that match, with the pattern's groups under these names."""
    hit = lines.filter(F.col("line").rlike(pattern))
    return hit.withColumns({n: F.regexp_extract("line", pattern, i) for i, n in enumerate(names, 1)})


def line_classes(lines: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Lines by the first class whose pattern they match, with their number."""
    kind: Column = F.coalesce(*[F.when(F.col("line").rlike(p), n) for n, p in classes.items()], F.lit("other"))
    return lines.groupBy("file", kind.alias("kind")).agg(F.count("*").alias("lines"))


def read_packets(spark: SparkSession, path: str, header: str, fields: list[str], size_field: str) -> DataFrame:
    """Files of packets, each a header (a struct format, of whole numbers) and so many bytes of payload; what a file
    holds after its last whole packet is left out.  One row per packet."""
    width = struct.calcsize(header)
    schema = "path string, seq long, " + ", ".join(f"{f} long" for f in fields) + ", payload binary"

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"], strict=True):
                rows, at = [], 0
                while at + width <= len(data):
                    own = dict(zip(fields, struct.unpack_from(header, data, at), strict=True))
                    end = at + width + own[size_field]
                    if end > len(data):
                        break
                    rows.append((file, len(rows), *own.values(), data[at + width : end]))
                    at = end
                yield pd.DataFrame(rows, columns=["path", "seq", *fields, "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(split, schema)


def decoded_matrix(df: DataFrame, values: str, rows: int, columns: int, planes: int, scale: float) -> DataFrame:
    """Force matrices stored as differences of neighbouring rows in 16 bits, which wrap, as forces."""
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes if n != values), f"`{values}` array<double>"])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v in pdf[values]:
                m = None if v is None else np.asarray(v, np.int16).reshape(rows, columns, planes)
                out.append(None if m is None else (np.cumsum(m, 0, dtype=np.int16) / scale).ravel())
            yield pdf.drop(columns=values).assign(**{values: out})

    return df.mapInPandas(decode, schema)


def encoded_matrix(df: DataFrame, values: str, rows: int, columns: int, planes: int, scale: float) -> DataFrame:
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes if n != values), f"`{values}` array<smallint>"])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v in pdf[values]:
                m = None if v is None else np.clip(np.rint(np.asarray(v, float) * scale), -32768, 32767).astype(np.int16).reshape(rows, columns, planes)
                out.append(None if m is None else np.diff(m, axis=0, prepend=np.zeros_like(m[:1])).ravel())
            yield pdf.drop(columns=values).assign(**{values: out})

    return df.mapInPandas(encode, schema)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Trajectories as text: time, place and quaternion in a line, comments after #."""
    schema = "t double, x double, y double, z double, qx double, qy double, qz double, qw double"
    return spark.read.schema(schema).option("comment", "#").option("sep", " ").option("mode", "DROPMALFORMED").csv(path)
