"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Sources share ``TOTAL`` of all words by their weights; no target passes ``MOST`` times its source, and what is
above is shared again by weight.  Each document first gets the whole copies that its source's target holds for
certain.  For the rest, documents have inclusion probabilities in proportion to the bit length of their size
(one at most), are ranked by random odds over inclusion odds, and are taken in that order up to the words that
remain; the document at the cut is taken if that comes nearer.

A null text has size 0 and gets no copy beyond the certain ones; a null source is a source of its own, the last; a null
doc_id is drawn like any other, by its text.  Repeated rows are drawn separately and have equal draws; where the cut
falls among them, as many are taken as come nearest, whichever.  An empty table gives no rows.  No source is ever
gathered: the cut is found through two levels of histogram over the ranks, and only ranks of one bucket in 2**20 are put
in order; if it falls among repeated rows, a third level over random numbers of theirs finds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.llm.common import quoted, small_join, stored, unused

WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
FINE = 1024


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """A number between 0 and 1 that depends on the document and its text alone."""
    own = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    digits = F.substring(F.md5(own.cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def allot(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """(key, source, source_size) to the same with ``target``: one row per source, so windows over all of them."""
    every = Window.partitionBy()
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int")))
    # Sources fill up in the order of cap over weight; the level is what the others share once those are full.
    rank = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    cap = F.col("source_size") * most
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        weighted.withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("full", F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("all_size") * total - F.col("full")) / F.col("open"))
        .withColumn("fits", F.col("level") * F.col("weight") <= cap)
    )
    level = F.max(F.when(F.col("fits"), F.col("level"))).over(every)  # the first that fits; those after it are lower
    return levels.withColumn("level", level).select(
        "key", "source", "source_size", F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("weight"), cap.cast("double"))).alias("target")
    )


def chances(by: DataFrame, rest: DataFrame) -> DataFrame:
    """Per source, the factor that turns a document's bit length into its inclusion probability, from sums by bit length."""
    above = Window.partitionBy("key").orderBy(F.desc("bits")).rowsBetween(Window.unboundedPreceding, -1)
    at = Window.partitionBy("key").orderBy("bits").rowsBetween(Window.unboundedPreceding, 0)
    factor = (F.col("rest") - F.coalesce(F.sum("s").over(above), F.lit(0))) / F.sum("m").over(at)
    return (
        by.join(rest, "key")
        .withColumn("factor", F.when(F.sum("m").over(at) > 0, factor))
        .filter(F.col("factor") * F.col("bits") <= 1)
        .groupBy("key")
        .agg(F.max_by("factor", "bits").alias("factor"))
    )


def crossing(part: DataFrame, bucket: str, amount: str = "size", until: str = "rest") -> DataFrame:
    """The bucket of each source in which what is summed up in order passes ``until``, and the sum before that bucket."""
    own = Window.partitionBy("key").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    by = part.groupBy("key", bucket).agg(F.sum(amount).alias("s"), F.first(until).alias("until"), F.first("before").alias("base"), F.count("*").alias("n"))
    by = by.withColumn("upto", F.sum("s").over(own) + F.col("base"))
    return (
        by.filter("upto > until and upto - s <= until")
        .groupBy("key")
        .agg(F.min(bucket).alias("cut_" + bucket), F.min(F.col("upto") - F.col("s")).alias("before"), F.min_by("n", bucket).alias("n"), F.min_by("s", bucket).alias("s"))
    )


def drawn(docs: DataFrame, keep: list[str], weights: tuple = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """row (a struct of the columns ``keep``), size, source_size, target and copies for every row of (doc_id, source, text)."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = docs.select(
        F.struct(*map(quoted, keep)).alias("row"),
        F.col("source"),
        key.alias("key"),
        words(F.col("text")).alias("size"),
        uniform(F.col("doc_id"), F.col("text")).alias("u"),
        F.monotonically_increasing_id().alias("nth"),  # to tell repeated rows apart, from here on
    )
    rows = stored(rows, "sizes").withColumn("bits", F.length(F.bin("size")))
    by = rows.groupBy("key", "bits").agg(F.sum("size").alias("s"), F.sum(F.col("size") * F.col("bits")).alias("m"), F.first("source").alias("source"))
    by = stored(by, "bits")  # a few dozen rows for each source
    sizes = by.groupBy("key").agg(F.first("source").alias("source"), F.sum("s").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = allot(sizes, weights, total, most).withColumn("whole", whole)
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = stored(plan.join(chances(by, plan.select("key", "rest")), "key", "left").drop("source"), "plan")

    u, chance = F.col("u"), F.least(F.lit(1.0), F.col("factor") * F.col("bits"))
    ranked = small_join(rows, plan, "key").withColumn("chance", chance)
    ranked = ranked.withColumn("rank", F.when((F.col("chance") > 0) & (F.col("size") > 0), (u / (1 - u)) * ((1 - F.col("chance")) / F.col("chance"))))
    place = F.col("rank") / (F.col("rank") + 1)
    ranked = ranked.withColumn("coarse", F.floor(place * FINE)).withColumn("fine", F.floor(place * FINE * FINE))
    there = ranked.filter("rank is not null")

    def inside(cut: DataFrame, name: str) -> DataFrame:
        return small_join(there, cut.select("key", f"cut_{name}", "before"), "key").filter(F.col(name) == F.col(f"cut_{name}")).drop(f"cut_{name}")

    coarse = stored(crossing(there.withColumn("before", F.lit(0)), "coarse"), "coarse")
    fine = stored(crossing(inside(coarse, "coarse"), "fine"), "fine")
    cut = crossing(inside(fine, "fine"), "rank")
    # Of the rows at the cut, which are repeats of one, those are taken with which the words come nearest.
    size = F.col("s") / F.col("n")
    near = F.floor((2 * F.col("rest") - 2 * F.col("before") + size) / (2 * size))
    cut = cut.join(plan.select("key", "rest"), "key").select("key", "cut_rank", "n", F.greatest(F.least(near, F.col("n")), F.lit(0)).alias("take"))
    cut = stored(cut, "cut")
    some = cut.filter("take > 0 and take < n")
    marked = small_join(ranked, cut, "key", "left")
    extra = (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("take") == F.col("n")))
    if not some.isEmpty():
        tie = F.pmod(F.xxhash64("nth"), F.lit(FINE * FINE))
        among = small_join(ranked.drop("before"), some, "key").filter("rank = cut_rank").select("key", "nth", "take", tie.alias("tie"))
        at = stored(crossing(among.withColumn("before", F.lit(0)).withColumn("one", F.lit(1)), "tie", "one", "take"), "tie")
        last = small_join(among, at.select("key", "cut_tie", "before"), "key").filter("tie <= cut_tie")
        order = F.row_number().over(Window.partitionBy("key", "tie").orderBy("nth"))
        edge = last.filter("tie = cut_tie").withColumn("i", order).filter(F.col("i") <= F.col("take") - F.col("before"))
        lucky = edge.select("key", "nth", "tie")
        marked = small_join(marked, at.select("key", "cut_tie"), "key", "left").withColumn("tie", tie)
        marked = marked.join(stored(lucky, "lucky").select("key", "nth", F.lit(True).alias("lucky")), ["key", "nth"], "left")
        extra = extra | ((F.col("rank") == F.col("cut_rank")) & ((F.col("tie") < F.col("cut_tie")) | F.coalesce("lucky", F.lit(False))))
    copies = F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")
    return marked.select("row", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and source for every row of (doc_id, source, text)."""
    out = drawn(docs, ["doc_id"], weights, total, most)
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns and ``copies`` (with underscores before it if there is such a column)."""
    out = drawn(docs, docs.columns, weights, total, most).filter("copies > 0")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("copies").alias(unused("copies", docs.columns)))


SQL = r"""
WITH r AS (
  SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source
), w AS (
  SELECT *, list_value(5, 2, 1)[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, coalesce(max(CASE WHEN level * weight <= 2 * source_size THEN level END) OVER () * weight, (2 * source_size)::DOUBLE)) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), q AS (
  SELECT *, target - whole * source_size AS rest FROM p
), b AS (
  SELECT source, len(bin(size)) AS bits, sum(size)::DOUBLE AS s, sum(size * len(bin(size)))::DOUBLE AS m FROM r GROUP BY ALL
), f AS (
  SELECT b.source, bits, (rest - coalesce(sum(s) OVER (PARTITION BY b.source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(m) OVER (PARTITION BY b.source ORDER BY bits ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS factor
  FROM b JOIN q ON b.source IS NOT DISTINCT FROM q.source
), c AS (
  SELECT source, max_by(factor, bits) AS factor FROM f WHERE factor * bits <= 1 GROUP BY source
), d AS (
  SELECT r.doc_id, r.size, q.source, q.source_size, q.target, q.whole, q.rest, least(1.0::DOUBLE, c.factor * len(bin(r.size))) AS chance,
    (CAST(('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(md5(text), ''))), 1, 13)) AS UBIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source LEFT JOIN c ON r.source IS NOT DISTINCT FROM c.source
), k AS (
  SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) * ((1 - chance) / chance) END AS rank FROM d
), z AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k
), y AS (
  SELECT *, CAST(whole + CASE WHEN rank IS NOT NULL AND size > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM z
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies, source FROM y
"""
