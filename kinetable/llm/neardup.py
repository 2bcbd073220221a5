"""Near-duplicate documents by ProbMinHash, banding and verification.

Documents are weighted sets of five-word shingles.  All are sketched with a weight of 1 for each shingle, for which
probability Jaccard is the Jaccard similarity that is verified; documents that repeat a shingle are sketched again with
a weight of 1 + ln n for one that occurs n times, and have the bands of both.  Each shingle is a Poisson process of its
weight's rate whose arrivals fall into random registers; a register keeps the shingle of its first arrival, and
arrivals end where they can't change a register any more.  Two documents agree in a register with their probability
Jaccard similarity.  Documents that agree in a whole band of registers are candidates; those whose sets of shingles
have a Jaccard similarity of ``SIMILARITY`` or more are linked, and what links join is a class.

Exact copies (the same words in the same order) are one text from the start.  In each bucket of a band texts are
first compared with one text only; buckets that then still hold more than one class are compared whole, in pairs of
blocks, as products of matrices within a task.  So no pair that shares a bucket is left out, and none is a row.  What
is compared are hashed shingles; texts are never shuffled.

A text of one to four words is one shingle.  Texts without words (null, empty) are copies of one another.  A row is
its text: where a doc_id has several texts, each is in its own text's class, and ``class_id`` is the smallest doc_id of
any row of that class.  A row whose doc_id is null links with nothing (class_id null, kept).  Repeated rows give
repeated results, an empty table none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm import tokens
from kinetable.llm.common import by_group, components, map_texts, salted_join, small_join, stored, unused

SHINGLE, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 a pair shares no band once in 4,500 times, at 0.85 once in 100,000.
BANDS, ROWS = 16, 4
#: Texts of a block of a bucket, shingles of all of a block's texts (one text may have more), and those compared at once.
BLOCK, SHINGLES, COLUMNS = 256, 500_000, 4096
#: Texts that a task compares with the first of their bucket.
RAYS = 64
#: Texts whose registers are filled at once.
LANES = 1500
#: Texts of the audit, and shingles of all of them, at most.
AUDIT, AUDIT_SHINGLES = 300, 1_000_000


def probminhash(items: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """(n, m): for each of n sets the items that came first in its m registers."""
    first = np.full(n * m, np.inf)
    sketch = np.zeros(n * m, np.uint64)
    time, k = np.zeros(len(items)), 0
    while len(items):
        k += 1
        draw = tokens.mix(items + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        at = owner * m + (tokens.mix(draw + np.uint64(0x632BE59BD9B4E019)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        sketch[at[won]] = items[won]
        last = first.reshape(n, m).max(1)
        going = time < last[owner]  # later arrivals of the others come after every register's first
        items, owner, weight, time = items[going], owner[going], weight[going], time[going]
    return sketch.reshape(n, m)


def banded(items: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """(n, BANDS): a hash of each band of the sketches of n sets."""
    rows = probminhash(items, owner, weight, n, BANDS * ROWS).reshape(n, BANDS, ROWS) * tokens.powers(0xD6E8FEB86659FD93, ROWS)
    return tokens.mix(rows.sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def band_hashes(texts: list[str | None]) -> tuple[list[bytes], list[np.ndarray], list[int]]:
    """A key of each text's words, the bands of its sketch, or of both where shingles are repeated, and its shingles' number."""
    words = tokens.words_of(texts)
    hashes, owner = tokens.shingles(words, SHINGLE)
    items, owner, times = tokens.counted(hashes, owner)
    items = tokens.mix(items)
    bands = list(banded(items, owner, np.ones(len(items)), len(texts)))
    repeats = np.unique(owner[times > 1])
    some = np.isin(owner, repeats)
    again = banded(items[some], np.searchsorted(repeats, owner[some]), 1 + np.log(times[some]), len(repeats))
    for i, own in zip(repeats.tolist(), again, strict=True):
        bands[i] = np.unique(np.concatenate([bands[i], own]))
    return tokens.text_keys(words), bands, np.bincount(owner, minlength=len(texts)).tolist()


def shingle_sets(texts: list[str | None]) -> tuple[list[bytes], list[bytes], list[int]]:
    """A key of each text's words, its distinct shingles as sorted hashes of six bytes each, and their number."""
    words = tokens.words_of(texts)
    items, owner, _ = tokens.counted(*tokens.shingles(words, SHINGLE))
    packed = items.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    return tokens.text_keys(words), [packed[6 * a : 6 * z] for a, z in zip(ends, ends[1:], strict=False)], np.diff(ends).tolist()


def unpacked(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of sets, and the set of each."""
    size = np.array([len(x) // 6 for x in sets], np.int64)
    out = np.zeros((int(size.sum()), 8), np.uint8)
    out[:, :6] = np.frombuffer(b"".join(sets), np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel(), np.repeat(np.arange(len(sets)), size)


def in_lanes(fn, texts: list[str | None]) -> tuple[list, list, list]:
    """``fn`` over texts, a bounded number of characters and texts at a time."""
    out: tuple[list, list, list] = ([], [], [])
    for own in tokens.blocks(texts):
        for a in range(own.start, own.stop, LANES):
            for all_of, part in zip(out, fn(texts[a : min(own.stop, a + LANES)]), strict=True):
                all_of += part
    return out


def shared_counts(sets: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many hashes each of the sets ``a`` has in common with each of ``b``."""
    items, owner = unpacked(sets)
    _, column, times = np.unique(items, return_inverse=True, return_counts=True)
    more = times[column] > 1  # what one set alone has is shared with none
    column, owner = (np.cumsum(times > 1) - 1)[column[more]], owner[more]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(a), len(b)))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[lo:hi], column[lo:hi] - start] = 1
        both += held[a] @ held[b].T
    return both


def _links_between(least: float):
    def links(group: pa.Table) -> list[pa.RecordBatch]:
        """One link for each two classes of a pair of blocks (of a block with itself) that have one."""
        side, label = group.column("side").to_numpy(), group.column("label").to_numpy()
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if (side == 1).any() else a
        both = shared_counts(group.column("shingles").to_pylist(), a, b)
        size = group.column("size").to_numpy()
        near = both >= least * (size[a][:, None] + size[b][None, :] - both)
        x, y = np.nonzero(near & (label[a][:, None] != label[b][None, :]))
        if not len(x):
            return []
        _, one = np.unique(np.sort(np.stack([label[a[x]], label[b[y]]], 1), 1), axis=0, return_index=True)
        node = group.column("node").to_numpy()
        return [pa.RecordBatch.from_arrays([pa.array(node[a[x[one]]]), pa.array(node[b[y[one]]])], names=["a", "b"])]

    return links


def tasks_for(n: str, total: str, most: int):
    """Blocks of so many texts at most, with so many shingles in all."""
    return F.ceil(F.greatest(F.col(n) / most, F.col(total) / SHINGLES)).cast("int")


def linked(sides: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links of texts of side 0 with those of side 1 of each group (c, node, label, side), or of side 0 alone."""
    rows = sides.join(sets, "node").select("c", "node", "label", "side", "size", "shingles")
    return by_group(rows, "c", _links_between(least), "a bigint, b bigint").distinct()


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, key (of the text's words), class_id and keeper for every row of (doc_id, text); each class has one keeper,
    a text of its smallest doc_id."""
    docs = docs.select("doc_id", "text")
    rows = stored(map_texts(docs, ["doc_id"], "key binary, bands array<bigint>, size int", lambda t: in_lanes(band_hashes, t)), "sketches")
    texts = rows.filter("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.any_value("bands").alias("bands"), F.any_value("size").alias("size"))
    texts = stored(texts.withColumn("node", F.monotonically_increasing_id()), "texts")  # numbers that last, as they are stored
    buckets = texts.select("node", "size", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1")
    shared = stored(shared, "shared")
    members = stored(salted_join(buckets, shared.select("bucket", "a"), "bucket", "inner", shared), "members")

    nodes = stored(members.select("node").distinct().join(texts.select("node", "key", F.col("first").alias("doc_id")), "node"), "nodes")
    # Rows are found by their id, and told by their text: an id with many texts costs each of its rows once.
    own = small_join(docs, stored(nodes.select("doc_id").distinct(), "ids"), "doc_id", "left_semi")
    sets = map_texts(own, ["doc_id"], "key binary, shingles binary, size int", lambda t: in_lanes(shingle_sets, t))
    sets = small_join(sets, nodes, ["doc_id", "key"]).select("node", "shingles", F.col("size").cast("double").alias("size"))
    if not docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty():
        sets = sets.dropDuplicates(["node"])  # repeated rows would be compared again and again
    sets = stored(sets, "sets")

    # Stars: each text against the first of its buckets.
    stars = members.groupBy("node").agg(F.min("a").alias("a"), F.first("size").alias("size")).filter("a < node")
    stars = stored(stars, "stars")
    hubs = stored(stars.groupBy("a").agg(F.count("*").alias("n"), F.sum("size").alias("total")).withColumn("k", tasks_for("n", "total", RAYS)), "hubs")
    rays = salted_join(stars.select("a", "node"), hubs.select("a", "k"), "a", "inner", hubs.select("a", "n"))
    rays = rays.select(F.xxhash64("a", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).alias("c"), "node", F.lit(1).alias("side"))
    centres = hubs.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("at"))
    centres = centres.select(F.xxhash64("node", "at").alias("c"), "node", F.lit(0).alias("side"))
    links = stored(linked(rays.unionByName(centres).withColumn("label", F.col("node")), sets, least), "links")
    labels = components(links)

    # Buckets of the same texts are compared once, and only where they hold more than one class.
    placed = members.select("node", "size", "bucket").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    same = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.min("node").alias("a"), F.max("node").alias("z"), F.min("label").alias("l"), F.max("label").alias("m"))
    mixed = same.filter("l < m").groupBy("n", "total", "x", "a", "z").agg(F.min("bucket").alias("bucket"))
    mixed = stored(mixed.select("bucket", "n", tasks_for("n", "total", BLOCK).alias("k")), "mixed")
    placed = salted_join(placed, mixed.select("bucket", "k"), "bucket", "inner", mixed.select("bucket", "n"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pair = F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))
    sides = placed.select(pair.alias("c"), "node", "label", F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"))
    more = stored(linked(sides, sets, least), "more")
    if not more.isEmpty():
        labels = components(links.union(more))

    # Of each class the smallest doc_id, and a text of it.
    rooted = texts.select("node", "key", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rooted = stored(rooted, "rooted")
    best = rooted.groupBy("label").agg(F.min(F.struct("first", "key")).alias("best"))
    found = salted_join(rooted.select("key", "label"), best, "label")
    found = stored(found.select("key", F.col("best.first").alias("class_id"), (F.col("key") == F.col("best.key")).alias("chosen")), "classes")
    out = salted_join(rows.select("doc_id", "key"), found, "key")
    there = F.col("doc_id").isNotNull()
    return out.select("doc_id", "key", F.when(there, F.col("class_id")).alias("class_id"), F.coalesce(F.col("chosen") & (F.col("doc_id") == F.col("class_id")), ~there).alias("keeper"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and kept for every row of (doc_id, text)."""
    found = classes(docs, least)
    return found.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class, with all its columns, and the rows without a doc_id.

    Rows whose doc_id occurs once are told by it, and only ids are shuffled; rows that share a doc_id are told by their
    text, and of equal ones one stays.
    """
    found = stored(classes(docs, least).filter("doc_id is not null"), "found")
    many = stored(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    gone = found.filter("not keeper").select("doc_id").distinct()
    if many.isEmpty():
        return small_join(docs, stored(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)
    single = small_join(docs, stored(gone.unionByName(many).distinct(), "gone"), "doc_id", "left_anti")
    own, key = small_join(docs, many, "doc_id", "left_semi"), unused("key", docs.columns)
    keyed = map_texts(own.select("*", F.col("text").alias(key)), docs.columns, f"`{key}` binary", lambda t: in_lanes(shingle_sets, t)[:1], key)
    chosen = found.filter("keeper").join(many, "doc_id", "left_semi").select("doc_id", F.col("key").alias(key)).distinct()
    keyed = keyed.join(chosen, ["doc_id", key], "left_semi")
    one = keyed.groupBy("doc_id", key).agg(F.min_by(F.struct(*docs.columns), F.struct(F.col("text"), F.xxhash64(*docs.columns))).alias("row"))
    return single.select(*docs.columns).unionByName(one.select("row.*"))


def recall(docs: DataFrame, found: DataFrame, least: float = SIMILARITY, queries: int = AUDIT) -> float:
    """The share of links, of a bounded sample of texts with all rows by brute force, whose ends are in one class.

    ``found`` are results of ``near_duplicates`` for ``docs``, whose doc_ids should be unique.
    """
    n = docs.count()
    drawn = docs.filter("doc_id is not null and text is not null").filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, queries / max(1, n)) * (1 << 30)))
    table = map_texts(drawn.select("doc_id", "text"), ["doc_id"], "key binary, shingles binary, size int", lambda t: in_lanes(shingle_sets, t)).limit(4 * queries).toArrow()
    sizes = np.cumsum(table.column("size").to_numpy())
    table = table.slice(0, max(1, int(np.searchsorted(sizes, AUDIT_SHINGLES, "right"))))
    if not table.num_rows:
        return 1.0
    ids, (items, whose) = table.column("doc_id").to_pylist(), unpacked(table.column("shingles").to_pylist())
    order, size = np.argsort(items, kind="stable"), table.column("size").to_numpy()
    items, whose = items[order], whose[order]

    def linked_to(texts: list) -> tuple[list]:
        _, sets, sizes = in_lanes(shingle_sets, texts)
        out = []
        for own, k in zip(sets, sizes, strict=True):
            h, _ = unpacked([own])
            lo, hi = np.searchsorted(items, h, "left"), np.searchsorted(items, h, "right")
            at = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(int((hi - lo).sum()))
            both = np.bincount(whose[at], minlength=len(ids))
            out.append([ids[i] for i in np.flatnonzero((both > 0) & (both >= least * (size + k - both)))])
        return (out,)

    kind = docs.schema["doc_id"].dataType.simpleString()
    links = map_texts(docs.select("doc_id", "text"), ["doc_id"], f"others array<{kind}>", linked_to).select("doc_id", F.explode("others").alias("other")).filter("doc_id <> other")
    a, b = found.select("doc_id", "class_id"), found.select(F.col("doc_id").alias("other"), F.col("class_id").alias("other_class"))
    got = links.join(a, "doc_id").join(b, "other").agg(F.count("*").alias("n"), F.count_if(F.col("class_id") == F.col("other_class")).alias("k")).first()
    return got["k"] / got["n"] if got["n"] else 1.0


#: The same classes by all pairs of documents that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), p AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8::DOUBLE * (x.n + y.n - k)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), m AS (
  SELECT a, min(b) AS class_id FROM r GROUP BY 1
)
SELECT doc_id, class_id, coalesce(doc_id = class_id, true) AS kept FROM documents LEFT JOIN m ON doc_id = a
"""
