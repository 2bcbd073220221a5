"""Exact duplicates by two passes over a Bloom filter, with DataFrame functions only.

Texts are equal if they are without their white space.  A first pass reads the texts and stores one slim row for each:
id, number of code points and digest.  Digests are counted in the cells of a blocked Bloom filter, two cells of one
block for each; cells that were met twice or more are its bits.  In the second pass a row is possibly repeated if both
its bits are set, and only such rows are shuffled, grouped by their digest; the rest pass straight through.  A digest
met twice sets its bits for certain, so no repeat is missed, and a bit too many costs a row's shuffle only.

The filter has BITS cells for a row and at most MOST_BITS in all, 128 MB, which is the bound of what is broadcast; a
table of more rows than it was made for shuffles more of its slim rows, with the same result.

Of equal texts that with the most code points in the original stays, then the smallest doc_id; a null doc_id comes
last.  Of rows that agree in all that, one stays, whichever.  A null text counts as empty, and empty texts are equal to
one another.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import BROADCAST_ROWS, quoted, salted_join, stored, unused

#: Cells of a block (what a bitmap of Spark's holds); cells for each row; the most of all, a power of two.
BLOCK, BITS, MOST_BITS = 1 << 15, 16, 1 << 30
SPACE = " \t\n\x0b\f\r"


def digest(text: Column) -> Column:
    """The SHA-256 of a text without white space, as 32 bytes."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACE, "").cast("binary"), 256))


def blocks_for(rows: int, most_bits: int = MOST_BITS) -> int:
    """How many blocks the filter of so many rows has: a power of two."""
    cells = 1 << max(rows * BITS - 1, 1).bit_length()
    return max(1, min(cells, most_bits) // BLOCK)


def places(sha: Column, blocks: int) -> tuple[Column, Column, Column]:
    """The block of a digest and two different cells of it."""
    h = F.xxhash64(sha)
    first = h.bitwiseAND(BLOCK - 1)
    step = F.shiftrightunsigned(h, 15).bitwiseAND((1 << 17) - 1) % (BLOCK - 1) + 1
    return F.shiftrightunsigned(h, 32) % blocks, first, (first + step) % BLOCK


def repeated_cells(rows: DataFrame, blocks: int) -> DataFrame:
    """The filter: (block, bitmap) of the cells that rows met twice or more."""
    block, first, second = places(F.col("sha"), blocks)
    met = rows.select(F.explode(F.array(block * BLOCK + first, block * BLOCK + second)).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    often = met.filter("n > 1")
    return often.groupBy(F.shiftright("cell", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("cell").bitwiseAND(BLOCK - 1)).alias("bitmap"))


def is_set(bitmap: Column, cell: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(cell, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.bit_get(byte, (cell % 8).cast("int")) == 1


def possibly_repeated(rows: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``maybe``: both bits of the row are set."""
    block, first, second = places(F.col("sha"), blocks)
    seen = rows.withColumn("block", block).join(F.broadcast(bloom), "block", "left")
    both = is_set(F.col("bitmap"), first) & is_set(F.col("bitmap"), second)
    return seen.withColumn("maybe", F.coalesce(both, F.lit(False))).drop("block", "bitmap")


def groups_of(maybe: DataFrame) -> DataFrame:
    """Of the digests that are there twice or more: sha, the best row's id, code points and number, how many tie with it, and the rows."""
    first = maybe.groupBy("sha", "chars", "id").agg(F.count("*").alias("n"), F.min("nth").alias("nth"))
    best = F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("no_id"), "id", "nth", "n")
    by = first.groupBy("sha").agg(F.sum("n").alias("n"), F.min(best).alias("best")).filter("n > 1")
    return by.select("sha", "n", F.col("best.id").alias("keep_id"), (-F.col("best.chars")).alias("most"), F.col("best.nth").alias("best"), F.col("best.n").alias("ties"))


def by_digest(df: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    """Join the groups: by broadcast if they are counted few, else by shuffle, with hot groups split."""
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(groups), "sha", how)
    return salted_join(df, groups.withColumnRenamed("n", "rows"), "sha", how, groups.select("sha", "n")).withColumnRenamed("rows", "n")


def passes(docs: DataFrame, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows that pass straight through, the possibly repeated ones, and the groups of the latter: all of slim rows."""
    slim = docs.select(
        F.col("doc_id").alias("id"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
        digest(F.col("text")).alias("sha"),
        F.monotonically_increasing_id().alias("nth"),  # to tell repeated rows apart, from here on
    )
    rows = stored(slim, "digests")
    blocks = blocks_for(rows.count(), most_bits)
    bloom = stored(repeated_cells(rows, blocks), "bloom")
    seen = possibly_repeated(rows, bloom, blocks)
    maybe = stored(seen.filter("maybe").drop("maybe"), "maybe")
    return seen.filter("not maybe").drop("maybe"), maybe, stored(groups_of(maybe), "groups")


def duplicates(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of (doc_id, text)."""
    alone, maybe, groups = passes(docs, most_bits)
    once = alone.select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    more = by_digest(maybe, groups, "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("nth") == F.col("best"), F.lit(True)).alias("kept"),
        "sha",
    )
    every = once.unionByName(more)
    return every.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; texts move only where rows tie in id and length."""
    groups = passes(docs, most_bits)[2]
    name = unused("row", docs.columns)
    rows = docs.select(
        F.struct(*map(quoted, docs.columns)).alias(name),
        digest(F.col("text")).alias("sha"),
        F.col("doc_id").alias("_id"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("_chars"),
    )
    stays = by_digest(rows, groups, "left").filter(F.col("n").isNull() | ((F.col("_chars") == F.col("most")) & F.col("_id").eqNullSafe(F.col("keep_id"))))
    own = stays.filter("ties is null or ties = 1").select(name)
    tied = stays.filter("ties > 1").groupBy("sha").agg(F.first(name).alias(name)).select(name)
    return own.union(tied).select(*(F.col(name).getField(c).alias(c) for c in docs.columns))


SQL = r"""
WITH r AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size, first_value(doc_id) OVER o AS keep_id, row_number() OVER o AS i
  FROM r WINDOW o AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, i = 1 AS kept, text_sha256 FROM g
"""
