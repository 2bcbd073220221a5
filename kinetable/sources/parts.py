"""Parts of large files as rows: row groups of Parquet files, and packets of binary files that are cut into byte ranges.

Files are listed by Spark; which parts there are is found in tasks, and each part is a row that goes to a task of its
own choice, so that one large file is read by many tasks.  Tasks open files through pyarrow, which knows local, HDFS, S3
and GCS paths.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinetable.sources.datasets import stored

#: Bytes of a range; bytes of payload that a task holds before it hands packets on; headers that have to follow one
#: another where a range is entered.
RANGE, HELD, CHAIN = 64 << 20, 16 << 20, 8
#: Partitions for each core that parts are dealt to.
PER_CORE = 4


def opened(path: str) -> pa.NativeFile:
    store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_file(name)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of all files below a path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length")


def dealt(parts: DataFrame) -> DataFrame:
    """Parts over many tasks: they are few rows that stand for much."""
    n = min(max(1, parts.count()), PER_CORE * parts.sparkSession.sparkContext.defaultParallelism)
    return parts.repartition(n)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(path, group, rows, of): the row groups of Parquet files from their footers; ``of`` are the file's rows."""

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["path"]:
                with opened(p) as f:
                    meta = pq.ParquetFile(f).metadata
                    yield pd.DataFrame({"path": p, "group": range(meta.num_row_groups), "rows": [meta.row_group(i).num_rows for i in range(meta.num_row_groups)], "of": meta.num_rows})

    return dealt(files(spark, path, "*.parquet").select("path")).mapInPandas(footers, "path string, group int, rows long, of long")


def sampled_groups(spark: SparkSession, path: str, every: int = 3, columns: list[str] | None = None) -> DataFrame:
    """The rows of every ``every``-th row group of each file, from the first on, and ``weight``: for how many rows of the
    file each stands, so that sums of it are counts of all.  No other row group is read."""
    schema = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path).schema
    own = T.StructType([f for f in schema.fields if columns is None or f.name in columns])
    kept = stored(row_groups(spark, path).filter(F.col("group") % every == 0), "groups")
    weights = kept.groupBy("path").agg((F.max("of") / F.sum("rows")).alias("weight"))
    want = to_arrow_schema(own).append(pa.field("weight", pa.float64()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for p, group, weight in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                with opened(p) as f:
                    for batch in pq.ParquetFile(f).iter_batches(10_000, [group], columns=own.names):
                        table = pa.Table.from_batches([batch]).append_column("weight", pa.array([weight] * batch.num_rows, pa.float64()))
                        yield from table.select(want.names).cast(want).to_batches()

    parts = dealt(kept.join(weights, "path").select("path", "group", "weight"))
    return parts.mapInArrow(read, T.StructType([*own.fields, T.StructField("weight", T.DoubleType())]))


def packets(spark: SparkSession, path: str, header: str, fields: list[str], size_field: str, size: int = RANGE, plausible: Callable[[dict], bool] | None = None) -> DataFrame:
    """Packets as ``logs.read_packets`` gives them, of files of any size: (path, seq, fields, payload).

    A file is cut into byte ranges.  A range is entered at the first place from which CHAIN plausible headers follow one
    another, or all up to the file's end, and tells where its last packet ends.  That has to be where the next range was
    entered; a range that was entered elsewhere is read again from there.  The first range begins at the file's first
    byte, so where all agree every packet is right, whatever the guesses were.  ``plausible`` is asked of each header's
    fields; without it a packet only has to end within its file.
    """
    width = struct.calcsize(header)
    at_field = fields.index(size_field)

    def header_at(data: bytes, at: int, start: int, length: int) -> tuple | None:
        """The header at a place of the file, if there is a whole and plausible packet."""
        if at + width > length:
            return None
        own = struct.unpack_from(header, data, at - start)
        if own[at_field] < 0 or at + width + own[at_field] > length or (plausible and not plausible(dict(zip(fields, own, strict=True)))):
            return None
        return own

    def walked(f: pa.NativeFile, entry: int, stop: int, length: int) -> Iterator[tuple[int, tuple]]:
        """Packets that begin before ``stop``, from ``entry`` on: place and header."""
        data, base, at = b"", entry, entry
        while at < stop:
            if at + width > base + len(data):
                f.seek(at)
                data, base = f.read(min(HELD, length - at)), at
            own = header_at(data, at, base, length) if at + width <= base + len(data) else None
            if own is None:
                return
            yield at, own
            at += width + own[at_field]

    def entered(f: pa.NativeFile, start: int, stop: int, length: int) -> int | None:
        """The first place in a range from which headers follow one another."""
        f.seek(start)
        data = f.read(min(stop - start + width, length - start))
        for at in range(start, stop):
            if at + width > start + len(data) or header_at(data, at, start, length) is None:
                continue
            seen, end = 0, at
            for end, own in walked(f, at, length, length):
                seen, end = seen + 1, end + width + own[at_field]
                if seen == CHAIN:
                    break
            if seen == CHAIN or end == length:
                return at
        return None

    def index(guess: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for p, start, stop, length, entry in pdf[["path", "start", "stop", "length", "entry"]].itertuples(index=False):
                    with opened(p) as f:
                        if guess:
                            entry = 0 if start == 0 else entered(f, start, stop, length)
                        n, after = 0, entry
                        if entry is not None:
                            for at, own in walked(f, int(entry), stop, length):
                                n, after = n + 1, at + width + own[at_field]
                    yield pd.DataFrame({"path": [p], "start": [start], "stop": [stop], "length": [length], "entry": pd.array([entry], "Int64"), "after": pd.array([after], "Int64"), "n": [n]})

        return run

    schema = "path string, start long, stop long, length long, entry long, after long, n long"
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    ranges = files(spark, path).filter("length > 0").withColumn("start", starts).withColumn("stop", F.least(F.col("start") + size, F.col("length")))
    ranges = stored(ranges.withColumn("entry", F.lit(None).cast("long")), "ranges")
    known = stored(dealt(ranges.select("path", "start", "stop", "length", "entry")).mapInPandas(index(True), schema), "entries")
    turn = Window.partitionBy("path").orderBy("start")
    while True:
        asked = known.withColumn("want", F.when(F.col("start") == 0, 0).otherwise(F.lag("after").over(turn)))
        # Where packets end for good, in a torn one or at damage, nothing begins in later ranges.
        wrong = asked.filter("want is not null and (entry is null or entry <> want)")
        wrong = stored(wrong.select("path", "start", "stop", "length", F.col("want").alias("entry")), "entries")
        if wrong.isEmpty():
            break
        again = dealt(wrong).mapInPandas(index(False), schema)
        known = stored(known.join(wrong.select("path", "start"), ["path", "start"], "left_anti").unionByName(again), "entries")
    first = F.coalesce(F.sum("n").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = stored(known.withColumn("seq", first).filter("n > 0").select("path", "entry", "stop", "length", "seq"), "packets")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, entry, stop, length, seq in pdf.itertuples(index=False):
                rows, held = [], 0
                with opened(p) as f, opened(p) as g:
                    for at, own in walked(f, entry, stop, length):
                        g.seek(at + width)
                        rows.append((p, seq, *own, g.read(own[at_field])))
                        seq, held = seq + 1, held + own[at_field]
                        if held > HELD:
                            yield pd.DataFrame(rows, columns=["path", "seq", *fields, "payload"])
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=["path", "seq", *fields, "payload"])

    return dealt(parts).mapInPandas(read, "path string, seq long, " + ", ".join(f"{x} long" for x in fields) + ", payload binary")
