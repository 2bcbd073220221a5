"""Near-duplicate embeddings by NN-descent.

Equal vectors are one from the start.  A neighbour graph begins with what lies side by side in several orders by
random hyperplanes, and is refined in rounds: at each vector the neighbours, of both directions, are compared with
one another, and each keeps the nearest that it has met.  A list that is full of links is saturated and is enlarged,
twice at most.  After the rounds, recall is audited against brute force over a bounded sample of queries; while it is
too low, more orders and rounds follow.  Edges at the threshold are kept and make components.

A list takes no more than K vectors of a group and ends at 4 K, so links of vectors that have K or more can be crowded
out of it.  All such vectors are in components of more than K; these are cut into blocks of near vectors, each with a
centre and the largest angle from it.  By the triangle inequality the links of two blocks, of one component or of two,
may be all of them, none, or unsure; unsure ones are compared whole, of the others only numbers are added up.  So
links are counted whole however many a vector has, and a dense group costs little more than its vectors.  The counts
are audited against brute force, without a cap; where too many links are missing, all pairs are compared.

Vectors of different lengths don't link.  Each length with many vectors has a graph of its own; the others, with up to
FEW vectors each, are compared whole.  Null vectors, vectors with null or non-finite components, zero vectors and rows
without a vec_id link with nothing.  Rows that repeat a vector count as vectors; rows of one vec_id should hold one
vector.  An empty table gives no rows.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import by_group, components, salted_join, stored

LEAST = 0.95
#: Neighbours of a list, and of one that has been enlarged once and twice.
K = 12
#: Orders of the first graph, the bits of each, and the vectors of a window of neighbours.
ORDERS, BITS, WINDOW = 8, 30, 32
ROUNDS, MORE = 3, 3
#: Neighbours, of both directions, that are compared at a vector; a vector with more has a random part compared each round.
MOST = 48
#: Rounds end when fewer than this share of the entries are new; queries of the audit; recall that ends the search.
STILL, AUDIT, RECALL = 0.002, 500, 0.98
#: Vectors of a block in the final count; blocks whose centres are compared at once; bits that tell which vectors are near.
BLOCK, BALLS, CELL_BITS = 256, 1024, 16
#: What angles may be off by.
SLACK = 1e-6
#: Vectors of a length that are compared whole, if it isn't the most frequent one.
FEW = 4096
_log = logging.getLogger(__name__)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of length one, in double precision; scaled by their largest component first, so that no square is lost."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    if not len(column):
        return x
    _, power = np.frexp(np.abs(x).max(1, keepdims=True))
    x = np.ldexp(x, -power)  # by powers of two, which is exact
    return x / np.sqrt((x * x).sum(1, keepdims=True))


PAIRS = "v bigint, u bigint, cos double"
_PAIRS = ["v", "u", "cos"]


def hyperplane_code(x: np.ndarray, seed: int, bits: int) -> np.ndarray:
    """On which sides of random hyperplanes vectors lie."""
    code = np.zeros(len(x), np.int64)
    for bit in (x @ np.random.default_rng(seed).normal(size=(bits, x.shape[1])).T > 0).T:
        code = code * 2 + bit
    return code


def _ordered(vectors: DataFrame, seeds: list[int]) -> DataFrame:
    """Pairs of vectors that are near in an order by random hyperplanes, the nearest K of each; one shuffle for all orders."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            for seed in seeds if len(x) else ():
                code = hyperplane_code(x, seed, BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), seed, np.int32)), pa.array(code), *batch.columns], names=["seed", "code", "v", "vector"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        for batch in batches:
            own = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            ids, x = own.column("v").to_numpy(), matrix(own.column("vector").combine_chunks())
            last = batch.slice(max(0, batch.num_rows - WINDOW))
            for start in range(0, max(1, len(ids) - WINDOW // 2), WINDOW // 2):
                i, y = ids[start : start + WINDOW], x[start : start + WINDOW]
                yield from nearest(i, y @ y.T, np.full(len(i), -2.0))

    kind = vectors.schema["vector"].dataType.simpleString()
    coded_rows = vectors.select("v", "vector").mapInArrow(coded, f"seed int, code bigint, v bigint, vector {kind}")
    order = coded_rows.withColumn("_n", F.xxhash64("v"))
    order = order.repartitionByRange("seed", "code", "_n").sortWithinPartitions("seed", "code", "_n")
    return order.select("v", "vector").mapInArrow(near, PAIRS)  # a window over the end of an order does no harm


def nearest(ids: np.ndarray, cos: np.ndarray, above: np.ndarray, use: np.ndarray | None = None) -> list[pa.RecordBatch]:
    """For each vector of a group the K others nearest to it, of those above its bound."""
    np.fill_diagonal(cos, -2.0)
    if len(ids) > K:
        above = np.maximum(above, -np.partition(-cos, K - 1, axis=1)[:, K - 1] - 1e-12)
    good = cos > above[:, None]
    if use is not None:
        good &= use
    a, b = np.nonzero(good & (cos > -1.5))
    return [pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(cos[a, b])], names=_PAIRS)] if len(a) else []


def _joined(group: pa.Table) -> list[pa.RecordBatch]:
    ids, x = group.column("m").to_numpy(), matrix(group.column("vector").combine_chunks())
    fresh, bound = group.column("fresh").to_numpy(), group.column("bound").to_numpy()
    return nearest(ids, x @ x.T, bound, fresh[:, None] | fresh[None, :])


def shortlist(met: DataFrame, k: int, least: float) -> DataFrame:
    """(v, u, cos, fresh, bound): the best ``k`` of what each has met, 2k or 4k if those before are links all."""
    once = met.groupBy("v", "u").agg(F.max("cos").alias("cos"), F.min("fresh").alias("fresh"))
    ranked = once.groupBy("v").agg(F.sort_array(F.collect_list(F.struct((-F.col("cos")).alias("far"), "u", "fresh"))).alias("own"))
    full = lambda n: F.coalesce(F.get("own", F.lit(n - 1))["far"] <= -least, F.lit(False))
    size = F.when(full(2 * k), 4 * k).when(full(k), 2 * k).otherwise(k)
    own = ranked.select("v", F.slice("own", F.lit(1), size).alias("own"), F.when(F.size("own") >= size, -F.get("own", size - 1)["far"]).otherwise(-2.0).alias("bound"))
    return own.select("v", "bound", F.inline("own")).select("v", "u", (-F.col("far")).alias("cos"), "fresh", "bound")


def refined(lists: DataFrame, vectors: DataFrame, k: int, least: float, seed: int) -> DataFrame:
    """One round: the neighbours of each vector are compared with one another."""
    bounds = lists.groupBy("v").agg(F.first("bound").alias("bound"))
    both = lists.select(F.col("v").alias("c"), F.col("u").alias("m"), "fresh").union(lists.select("u", "v", "fresh"))
    both = stored(both.groupBy("c", "m").agg(F.max("fresh").alias("fresh")), "neighbours")
    many = both.groupBy("c").agg(F.count("*").alias("n"))
    crowded = stored(many.filter(F.col("n") > MOST), "crowded")
    if not crowded.isEmpty():
        both = salted_join(both, crowded, "c", "left", crowded).withColumnRenamed("n", "nc")
        both = salted_join(both, crowded.withColumnsRenamed({"c": "m", "n": "nm"}), "m", "left", crowded.withColumnRenamed("c", "m"))
        most = F.greatest(F.coalesce("nc", F.lit(1)), F.coalesce("nm", F.lit(1)))
        both = both.filter(F.pmod(F.xxhash64(F.least("c", "m"), F.greatest("c", "m"), F.lit(seed)), most) < MOST).select("c", "m", "fresh")
    # No vector is here more than a few times MOST.
    sent = both.join(vectors.join(bounds, "v", "left").select(F.col("v").alias("m"), "vector", F.coalesce("bound", F.lit(-2.0)).alias("bound")), "m")
    met = by_group(sent.select("c", "m", "vector", "fresh", "bound"), "c", _joined, PAIRS)
    old = lists.select("v", "u", "cos", F.lit(False).alias("fresh"))
    return stored(shortlist(old.union(met.withColumn("fresh", F.lit(True))), k, least), "lists")


def _brute_force(vectors: DataFrame, least: float, queries: int) -> DataFrame | None:
    """(v, n): the links of a bounded sample of (v, vector, copies) with all others, each as often as it is repeated."""
    n = vectors.count()
    drawn = vectors.filter(F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1 << 30)) < int(min(1.0, queries / max(1, n)) * (1 << 30))).limit(4 * queries)
    table = drawn.select("v", "vector").toArrow().combine_chunks()
    if not table.num_rows:
        return None
    ids, q = table.column("v").to_numpy(), matrix(table.column("vector").combine_chunks())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                count += ((q @ matrix(batch.column(1)).T >= least) & (ids[:, None] != batch.column(0).to_numpy())) @ batch.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(count)], names=["v", "n"])

    rows = vectors.select("v", "vector", F.col("copies").cast("long"))
    return rows.mapInArrow(search, "v bigint, n bigint").groupBy("v").agg(F.sum("n").alias("n"))


def audited(lists: DataFrame, vectors: DataFrame, least: float, queries: int = AUDIT) -> float:
    """The share of links of a bounded sample of vectors, by brute force over all, that their lists hold (up to their size)."""
    true = _brute_force(vectors.withColumn("copies", F.lit(1)), least, queries)
    if true is None:
        return 1.0
    have = lists.filter(F.col("cos") >= least).groupBy("v").agg(F.count("*").alias("k"))
    got = true.join(have, "v", "left").agg(F.sum(F.least("n", F.lit(4 * K))).alias("n"), F.sum(F.least("n", F.coalesce("k", F.lit(0)))).alias("k")).first()
    return float((got["k"] or 0) / got["n"]) if got["n"] else 1.0


def recall_of(counts: DataFrame, vectors: DataFrame, least: float, queries: int = AUDIT) -> float:
    """The share of links of a bounded sample of vectors, by brute force over all, that have been counted."""
    true = _brute_force(vectors, least, queries)
    if true is None:
        return 1.0
    got = true.join(counts.withColumnRenamed("n", "k"), "v", "left").agg(F.sum("n").alias("n"), F.sum(F.coalesce("k", F.lit(0))).alias("k")).first()
    return float(got["k"] / got["n"]) if got["n"] else 1.0


def neighbour_graph(vectors: DataFrame, least: float = LEAST, k: int = K) -> DataFrame:
    """(v, u, cos): the lists of NN-descent over (v, vector)."""
    lists = None
    for attempt in range(1 + MORE):
        every = _ordered(vectors, list(range(1 + attempt * ORDERS, 1 + (attempt + 1) * ORDERS))).withColumn("fresh", F.lit(True))
        if lists is not None:
            every = every.union(lists.select("v", "u", "cos", F.lit(False)))
        lists = stored(shortlist(every, k, least), "lists")
        total = lists.count()
        for r in range(ROUNDS):
            lists = refined(lists, vectors, k, least, 100 * attempt + r)
            if lists.filter("fresh").count() <= STILL * total:
                break
        recall = audited(lists, vectors, least)
        _log.info("recall of the neighbour graph: %.4f", recall)
        if recall >= RECALL:
            break
    return lists.select("v", "u", "cos")


def _linked(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of side 0, rows of side 1 (those of side 0 if there are none), and which of them are links."""
    x, side = matrix(group.column("vector").combine_chunks()), group.column("side").to_numpy()
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if (side == 1).any() else a
    linked = x[a] @ x[b].T >= group.column("least")[0].as_py()
    if b is a:
        np.fill_diagonal(linked, False)
    return a, b, linked


def _edges(a: np.ndarray, b: np.ndarray) -> list[pa.RecordBatch]:
    return [pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])] if len(a) else []


def _spanned(group: pa.Table) -> list[pa.RecordBatch]:
    """Edges that join what links of a pair of blocks join: each vector with the smallest that it reaches."""
    ids = group.column("v").to_numpy()
    a, b, linked = _linked(group)
    root, last, top = ids.copy(), None, np.iinfo(np.int64).max
    while last is None or (root != last).any():
        last = root.copy()
        root[a] = np.minimum(root[a], np.where(linked, root[b][None, :], top).min(1, initial=top))
        root[b] = np.minimum(root[b], np.where(linked, root[a][:, None], top).min(0, initial=top))
    return _edges(ids[root != ids], root[root != ids])


def _compared(group: pa.Table) -> list[pa.RecordBatch]:
    """Of a pair of blocks, or a block with itself: (v, n) links of each vector, and (v, u) one edge for each two labels with a link."""
    ids, weight, label = (group.column(c).to_numpy() for c in ("v", "copies", "label"))
    a, b, linked = _linked(group)
    out, n = ids[a], linked @ weight[b]
    if b is not a:
        out, n = np.concatenate([out, ids[b]]), np.concatenate([n, linked.T @ weight[a]])
    x, y = np.nonzero(linked & (label[a][:, None] != label[b][None, :]))
    found = np.unique(np.sort(np.stack([label[a[x]], label[b[y]]], 1), 1), axis=0)
    n, none = pa.array(n.astype(np.int64)), pa.nulls(len(out), pa.int64())
    counts = pa.RecordBatch.from_arrays([pa.array(out), none, n], names=["v", "u", "n"])
    return [counts, pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.nulls(len(found), pa.int64())], names=["v", "u", "n"])]


BALL = "block bigint, label bigint, length int, vector array<double>, radius double, copies bigint"
_BALL = [x.split()[0] for x in BALL.split(", ")]


def _ball(group: pa.Table) -> list[pa.RecordBatch]:
    """The centre of a block, the largest angle from it, and its vectors with their repeats."""
    x = matrix(group.column("vector").combine_chunks())
    centre = x.sum(0)
    size = np.sqrt(centre @ centre)
    centre = centre / size if size > 0 else x[0]
    radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
    own = [group.column(c).slice(0, 1).combine_chunks() for c in _BALL[:3]]
    return [pa.RecordBatch.from_arrays([*own, pa.array([centre.tolist()]), pa.array([radius]), pa.array([int(group.column("copies").to_numpy().sum())])], names=_BALL)]


NEAR = "a bigint, b bigint, label_a bigint, label_b bigint, copies_a bigint, copies_b bigint, all boolean"
_NEAR = [x.split()[0] for x in NEAR.split(", ")]


def _near_balls(group: pa.Table) -> list[pa.RecordBatch]:
    """Pairs of blocks (each with itself too) that a link can be between, and whether all links are there."""
    block, label, radius, copies = (group.column(c).to_numpy() for c in ("block", "label", "radius", "copies"))
    x, side = matrix(group.column("vector").combine_chunks()), group.column("side").to_numpy()
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if (side == 1).any() else a
    apart, most = np.arccos(np.clip(x[a] @ x[b].T, -1, 1)), np.arccos(group.column("least")[0].as_py())
    if b is a:
        np.fill_diagonal(apart, 0)
    reach = radius[a][:, None] + radius[b][None, :] + SLACK
    near = apart <= most + reach
    i, j = np.nonzero(np.triu(near) if b is a else near)
    whole = (apart + reach <= most)[i, j]
    p, q = a[i], b[j]
    return [pa.RecordBatch.from_arrays([pa.array(c) for c in (block[p], block[q], label[p], label[q], copies[p], copies[q], whole)], names=_NEAR)]


def _in_pairs(rows: DataFrame, key: str, number: str, least: float) -> DataFrame:
    """Rows of each ``key``, which has ``k`` blocks, once for each pair of blocks ``c`` that they are in."""
    own = rows.withColumn("at", F.pmod(F.xxhash64(number), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pair = F.xxhash64(key, F.least("at", "other"), F.greatest("at", "other"))
    return own.select(pair.alias("c"), *[c for c in rows.columns if c != "k"], F.when(F.col("at") <= F.col("other"), 0).otherwise(1).alias("side"), F.lit(float(least)).alias("least"))


def all_links(vectors: DataFrame, least: float) -> DataFrame:
    """(a, b): edges that join what the links of all pairs of one length join."""
    size = vectors.groupBy("length").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    own = vectors.join(F.broadcast(size), "length").select("length", "k", "v", "vector")
    return stored(by_group(_in_pairs(own, "length", "v", least).drop("length"), "c", _spanned, "a bigint, b bigint").distinct(), "edges")


def in_blocks(dense: DataFrame) -> DataFrame:
    """(block, label, length, v, vector, copies) of (label, n, length, v, vector, copies): up to BLOCK vectors or so of one
    label, near ones where there are more; ``n`` are the label's vectors."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, vectors = batch.column("length").to_numpy(), batch.column("vector")
            code = np.zeros(batch.num_rows, np.int64)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                code[at] = hyperplane_code(matrix(vectors.take(pa.array(at))), 0, CELL_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=[*batch.schema.names, "code"])

    rows = dense.mapInArrow(coded, ", ".join([*(f"{c} {t}" for c, t in dense.dtypes), "code bigint"]))
    bits = F.when(F.col("n") > BLOCK, F.least(F.lit(CELL_BITS), F.ceil(F.log2(F.col("n") / BLOCK)) + 1)).otherwise(0)
    rows = stored(rows.withColumn("cell", F.xxhash64("label", F.floor(F.col("code") / F.pow(F.lit(2.0), CELL_BITS - bits)))), "cells")
    cells = stored(rows.groupBy("cell").agg(F.count("*").alias("own")), "cell_sizes")
    rows = salted_join(rows, cells, "cell", "inner", cells.withColumnRenamed("own", "n"))
    block = F.xxhash64("cell", F.pmod(F.xxhash64("v"), F.ceil(F.col("own") / BLOCK)))
    return rows.select(block.alias("block"), "label", "length", "v", "vector", "copies")


def counted_links(vectors: DataFrame, labels: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(v, n): links of each vector with others of its component, and of other large ones, each as often as it is repeated;
    (a, b): an edge for each two large components that have a link."""
    size = stored(labels.groupBy("label").agg(F.count("*").alias("n")), "sizes")
    own = vectors.join(labels.withColumnRenamed("node", "v"), "v")
    own = stored(salted_join(own, size, "label", "inner", size).select("label", "n", "length", "v", "vector", F.col("copies").cast("long").alias("copies")), "labelled")
    sided = [F.lit(float(least)).alias("least")]
    few = own.filter(F.col("n") <= K).select(F.col("label").alias("c"), "label", "v", "vector", "copies", F.lit(0).alias("side"), *sided)
    met = by_group(few, "c", _compared, "v bigint, u bigint, n bigint")
    dense = stored(in_blocks(own.filter(F.col("n") > K)), "dense")
    balls = stored(by_group(dense.drop("v"), "block", _ball, BALL), "balls")
    k = F.lit(max(1, -(-balls.count() // BALLS)))
    pairs = stored(by_group(_in_pairs(balls.withColumn("k", k), "length", "block", least).drop("length"), "c", _near_balls, NEAR), "pairs")
    # What is sure is added up block by block.
    sure = pairs.filter("all")
    sums = sure.select(F.col("a").alias("block"), F.col("copies_b").alias("n"), (F.col("a") == F.col("b")).alias("itself"))
    sums = sums.union(sure.filter("a <> b").select("b", "copies_a", F.lit(False)))
    sums = sums.groupBy("block").agg(F.sum("n").alias("n"), F.bool_or("itself").alias("itself"))
    added = dense.select("block", "v", "copies").join(sums, "block").select("v", F.lit(None).cast("long").alias("u"), (F.col("n") - F.when(F.col("itself"), F.col("copies")).otherwise(0)).alias("n"))
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b").alias("block"), F.lit(1).alias("side"))))
    unsure = pairs.filter("not all").select(F.xxhash64("a", "b").alias("c"), F.explode(sides).alias("s")).select("c", "s.*")
    rows = dense.join(unsure, "block").select("c", "label", "v", "vector", "copies", "side", *sided)
    met = stored(met.union(added).union(by_group(rows, "c", _compared, "v bigint, u bigint, n bigint")), "met")
    edges = met.filter("u is not null").select(F.col("v").alias("a"), F.col("u").alias("b"))
    edges = edges.union(sure.filter("label_a <> label_b").select(F.least("label_a", "label_b"), F.greatest("label_a", "label_b"))).distinct()
    return stored(met.filter("u is null").groupBy("v").agg(F.sum("n").alias("n")), "counts"), stored(edges, "edges")


def every_count(vectors: DataFrame, least: float) -> DataFrame:
    """(v, n) by all pairs of one length."""
    size = vectors.groupBy("length").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    own = vectors.join(F.broadcast(size), "length").select("length", "k", "v", "vector", F.col("copies").cast("long").alias("copies"), F.lit(0).cast("long").alias("label"))
    found = by_group(_in_pairs(own, "length", "v", least).drop("length"), "c", _compared, "v bigint, u bigint, n bigint")
    return found.groupBy("v").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding)."""
    rows = vectors.select("vec_id", "embedding")
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    fine = F.coalesce(fine & F.col("vec_id").isNotNull(), F.lit(False))
    key = F.when(fine, F.sha2(F.to_json(F.struct("embedding")), 256))
    keyed = stored(rows.withColumn("key", key), "keyed")
    distinct = keyed.filter("key is not null").groupBy("key").agg(F.min("vec_id").cast("long").alias("v"), F.count("*").alias("copies"), F.any_value("embedding").alias("vector"))
    distinct = stored(distinct, "vectors")
    nodes = distinct.select("v", "vector", "copies", F.size("vector").alias("length"))
    sizes = nodes.groupBy("length").count()
    first = sizes.orderBy(F.desc("count"), "length").first()
    long = [first["length"], *(r["length"] for r in sizes.filter((F.col("count") > FEW) & (F.col("length") != first["length"])).collect())] if first else []
    edges = all_links(nodes.filter(~F.col("length").isin(long)), least)
    for n in long:
        graph = neighbour_graph(nodes.filter(F.col("length") == n).select("v", "vector"), least)
        edges = edges.union(graph.filter(F.col("cos") >= least).select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct())
    edges = stored(edges, "links")
    labels = components(edges)
    n, more = counted_links(nodes, labels, least)
    if not more.isEmpty():
        edges = edges.union(more)
        labels = components(edges)
    low = []
    for length in long:
        recall = recall_of(n, nodes.filter(F.col("length") == length), least)
        _log.info("recall of the counted links of length %d: %.4f", length, recall)
        low += [length] * (recall < RECALL)
    if low:
        of_low = nodes.filter(F.col("length").isin(low))
        labels = components(edges.union(all_links(of_low, least)))
        n = n.join(of_low, "v", "left_anti").union(stored(every_count(of_low, least), "counts"))
    found = distinct.select("key", "v", "copies").join(labels.withColumnRenamed("node", "v"), "v", "left").join(n, "v", "left")
    found = found.select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("label", "v").alias("component_id"))
    out = salted_join(keyed.select("vec_id", "key"), found, "key")
    component = F.coalesce(F.col("component_id").cast(vectors.schema["vec_id"].dataType), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


#: The same links and components by all pairs.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL
    AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), n AS (
  SELECT a, count(*) AS n FROM p GROUP BY 1
), r(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), m AS (
  SELECT a, min(b) AS c FROM r GROUP BY 1
)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(vec_id = coalesce(c, vec_id), true) AS kept FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN m ON vec_id = m.a
"""
