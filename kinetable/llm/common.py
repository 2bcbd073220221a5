"""What the corpus operators share: table access, shared storage, skew-proof joins, components.

Intermediate tables are Parquet under ``spark.checkpoint.dir``, which every executor sees, so a lost
executor costs only the tasks it ran.  Nothing here collects rows that grow with the corpus.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a side that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Rows of one key that a task of a join takes; keys with more go to several tasks.
HOT_ROWS = 1_000
#: Edges that a task reduces to a forest at once.
EDGES = 1_000_000
#: Bytes of text that a function over a batch gets at once, beyond those of the first text.
TEXT_BYTES = 4_000_000

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a local one where that is unset and all is on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors see")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = _own_dir[0]
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and is computed once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(name: str, columns: Sequence[str]) -> str:
    """The name with as many underscores before it as it takes to be none of these, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def gives_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker returns the memory that it no longer needs: workers outlive their tasks, and what they
    hold on to is missing in the stages to come."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError, TypeError):
            pass  # not every platform's allocator can

    return wrapped


def _sizes(column: pa.Array) -> np.ndarray:
    """The bytes of each value: of texts their own, of structs and lists those of all that they hold."""
    kind = column.type
    if pa.types.is_struct(kind):
        return sum((_sizes(column.field(i)) for i in range(kind.num_fields)), np.zeros(len(column), np.int64))
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        ends = np.concatenate([[0], np.cumsum(_sizes(column.values), dtype=np.int64)])[column.offsets.to_numpy()]
        return ends[1:] - ends[:-1]
    if any(f(kind) for f in (pa.types.is_string, pa.types.is_binary, pa.types.is_large_string, pa.types.is_large_binary)):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return np.full(len(column), -(-column.nbytes // max(1, len(column))), np.int64)


def pieces(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about TEXT_BYTES of the texts in column ``at``, whatever structs or lists hold them: what Python
    makes of texts takes several times their bytes, which has to be held for a piece only."""
    ends = np.cumsum(_sizes(batch.column(at)), dtype=np.int64) // TEXT_BYTES
    cuts = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1).tolist(), batch.num_rows]
    for a, z in zip(cuts, cuts[1:], strict=False):
        if z > a:
            yield batch.slice(a, z - a)


def map_texts(docs: DataFrame, keep: list[str], fields: str, fn: Callable[[list], Sequence], column: str = "text") -> DataFrame:
    """The columns ``keep`` as they are, and new ``fields``: ``fn`` gets a batch's texts and returns a sequence for each field."""
    new = to_arrow_schema(T.StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, b.num_columns - 1)):
            made = fn(batch.column(batch.num_columns - 1).to_pylist())
            old = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*old, *(pa.array(x, f.type, from_pandas=False) for x, f in zip(made, new, strict=True))], names)

    rows = numbered(docs.select(*map(quoted, keep), quoted(column)))
    fields_in = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rows.schema.fields[:-1])]
    out = T.StructType([*fields_in, *(T.StructField(f"n{i}", f.dataType) for i, f in enumerate(T.StructType.fromDDL(fields).fields))])
    names = out.names
    return rows.mapInArrow(gives_back(run), out).toDF(*keep, *T.StructType.fromDDL(fields).names)


def numbered(df: DataFrame) -> DataFrame:
    """The columns under plain names, as functions over batches can't take names with dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def filter_texts(docs: DataFrame, fn: Callable[[list], Sequence[bool]]) -> DataFrame:
    """The rows, with all their columns, for whose texts ``fn`` says true."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, at)):
            yield batch.filter(pa.array([bool(x) for x in fn(batch.column(at).to_pylist())], pa.bool_()))

    rows = numbered(docs)
    return rows.mapInArrow(gives_back(run), rows.schema).toDF(*docs.columns)


def by_group(df: DataFrame, key: str, fn: Callable[[pa.Table], list[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over all rows of each ``key``; groups have to be small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            if rest and rest[0].column(0)[0].as_py() != keys[0]:
                yield from fn(pa.Table.from_batches(rest))
                rest = []
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                rest.append(batch.slice(a, z - a))
                if z < len(keys):
                    yield from fn(pa.Table.from_batches(rest))
                    rest = []
        if rest:
            yield from fn(pa.Table.from_batches(rest))

    other = [c for c in df.columns if c != key]
    return df.select(key, *other).repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(gives_back(run), schema)


def small_join(df: DataFrame, side: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a stored side that has one row per key: by broadcast if it is counted small, else by shuffle."""
    few = side.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(side) if few else side, on, how)


def salted_join(df: DataFrame, side: DataFrame, key: str, how: str = "left", counts: DataFrame | None = None) -> DataFrame:
    """Join a side with unique keys where some keys of ``df`` may be very frequent.

    Rows of each key are counted (or ``counts`` (key, n) says how many there are); a key's rows go to one task for
    every HOT_ROWS of them, and only such keys of the side are copied.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    hot = stored(counts.filter(F.col("n") > HOT_ROWS).select(key, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("_k")), "hot")
    if hot.isEmpty():
        return df.join(side, key, how)
    tasks = F.when(F.col(key).isNull(), 1009).otherwise(F.coalesce("_k", F.lit(1)))
    left = small_join(df, hot, key, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), tasks).cast("int"))
    right = small_join(side, hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1)))
    return left.drop("_k").join(right.drop("_k"), [key, "_salt"], how).drop("_salt")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges of a task fewer that join the same nodes: each node with one that it reaches."""
    held, rows = [], 0

    def reduced(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        both = pa.chunked_array([b.column(i) for i in (0, 1) for b in parts]).combine_chunks().dictionary_encode()
        n = len(both) // 2
        code = both.indices.to_numpy()
        a, b, root, last = code[:n], code[n:], np.arange(len(both.dictionary)), None
        while last is None or (root != last).any():
            last = root.copy()
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            np.minimum.at(root, last, root)  # what a node learns its root learns
            root = root[root]
        far = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([both.dictionary.take(pa.array(root[far])), both.dictionary.take(pa.array(far))], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= EDGES:
            held, rows = [reduced(held)], 0
    if held:
        yield reduced(held)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) with the smallest node reachable, for every node of ``edges`` (a, b).

    Edges are first reduced to forests within tasks, so that a dense group costs as much as its nodes.  Each round
    takes the smallest label among a node's neighbours (summed before the shuffle) and then the label's own label, so
    that chains halve; labels live in the shared folder between rounds.
    """
    every = stored(edges.select("a", "b"), "edges")
    few = every.coalesce(max(1, every.count() // EDGES)).mapInArrow(_forest, every.schema)
    both = stored(few.union(few.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    degrees = stored(both.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ROWS), "degrees")
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")),
        "labels",
    )
    for _ in range(rounds):
        near = (
            salted_join(both, labels.select(F.col("node").alias("a"), "label"), "a", "inner", degrees)
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        step = stored(step, "steps")
        step = stored(salted_join(step, jump, "label").select("node", "was", F.coalesce("root", "label").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.filter("was <> label").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
