"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.session import cut_lineage

LEVELS = 5  # refinements
BITS = 12  # of the hash, each
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """How many runs of characters other than ASCII white space a text holds; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of an md5 of id and text: the same on every run and every engine."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text.cast("string"), F.lit(""))))
    return F.conv(F.substring(F.md5(both), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def numbered(rows: DataFrame, *key: str) -> DataFrame:
    """`rows(at, ...)` with `number`: 0, 1, 2 among the rows of a key, in the order of the row number `at`.

    Rows are numbered inside blocks of 4,096 row numbers and blocks are summed in order, so a key that all rows share is many small groups.
    """
    blocked = rows.withColumn("block", F.shiftright("at", 12))
    counts = blocked.groupBy(*key, "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*key, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*key, "block").orderBy("at")
    return blocked.withColumn("k", F.row_number().over(within) - 1).join(bases, [*key, "block"]).withColumn("number", F.col("base") + F.col("k")).drop("block", "k", "base")


def targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """`sizes(key, source, source_size)` -> the same rows and `target`.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes. A target above
    `most` times its source's size stops there and the excess goes to the others by weight, again and again; that is one water level: ordered by
    size over weight, the level at which the sources already full leave the rest exactly its share. One row a source is ordered, nothing else.
    """
    named = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    weighed = sizes.withColumn("weight", ((F.row_number().over(named) - 1) % 3 + 1).cast("double"))
    fullest = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "key").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "key").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(fullest), F.lit(0))) / F.sum("weight").over(rest)
    leveled = weighed.withColumn("level", level)
    # The water level is that of the first source which it does not fill; the levels before it rise up to there.
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.struct(F.col("source_size") / F.col("weight"), "key", "level"))).over(everything)["level"]
    water = leveled.withColumn("water", open_level)
    capped = most * F.col("source_size")
    return water.select("key", "source", "source_size", F.when(F.col("water").isNull(), capped).otherwise(F.least(F.col("water") * F.col("weight"), capped)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: float = 3.0, keep: list[str] | None = None) -> DataFrame:
    """`(doc, size, source_size, target, times)` per row: how often the mix takes each document; `doc` is the row as it came, or its
    columns `keep`.

    A source whose target is k sizes and a rest takes every document k times, and once more those whose hash lies under the
    source's threshold. Sizes are summed by source and hash bucket; the bucket where the sum passes the rest is summed
    again by the next 12 bits, and so on for 60 bits, so a threshold is found without sorting documents and only one
    bucket of each source is ever looked at again. At the end the bucket is one hash: the document on the boundary is taken if that comes nearer to the
    rest, and of equal rows there (same id, same text) as many as come nearest, so what is taken misses the rest by at most half a document.

    Hashes are of id and text, so null and repeated ids with differing texts are drawn apart. A null source is a source of its own; a null or blank
    text has size 0 and counts for nothing. All columns travel in one struct, so none can clash. Reruns take the same rows. An empty table, or one without
    words, takes nothing. A hot source is many (source, bucket) sums. What is joined back by source is one written row for each; sources are
    ordered in one task for their weights, one row each.
    """
    d = F.col("doc")
    key = F.coalesce(F.concat(F.lit("="), d.getField(source_col).cast("string")), F.lit(""))
    held = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("at"))
    rows = cut_lineage(
        held.select((F.struct(*[d.getField(c).alias(c) for c in keep]) if keep else d).alias("doc"), "at", key.alias("key"), d.getField(source_col).cast("string").alias("source"), n_words(d.getField(text_col)).alias("size"), hash60(d.getField(id_col), d.getField(text_col)).alias("h"))
    )
    sizes = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goals = targets(sizes, most).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goals = cut_lineage(goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    state = goals.select("key", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("under"))
    hashes = rows.select("key", "size", "h")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = hashes.join(state, "key").where(F.shiftright("h", shift + BITS) == F.col("prefix")) if level > 1 else hashes.join(state, "key")
        buckets = inside.groupBy("key", "rest", "under", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = buckets.withColumn("upto", F.col("under") + F.sum("n").over(upto))
        passing = summed.where(F.col("upto") > F.col("rest")).groupBy("key").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("under"))).alias("b"))
        state = cut_lineage(state.select("key", "rest").join(passing, "key").select("key", "rest", F.col("b.bucket").alias("prefix"), "b.under"))
    limits = cut_lineage(goals.join(state.select("key", F.col("prefix").alias("threshold"), "under"), "key", "left"))
    placed = rows.join(limits.drop("source"), "key")
    on_boundary = F.coalesce((F.col("h") == F.col("threshold")) & (F.col("size") > 0), F.lit(False))
    below = F.when(F.col("size") > 0, F.col("epochs") + F.coalesce(F.col("h") < F.col("threshold"), F.lit(False)).cast("long")).otherwise(F.lit(0)).cast("long")
    edge = numbered(placed.where(on_boundary), "key")
    nearest = F.floor((F.col("rest") - F.col("under")) / F.col("size") + 0.5)
    columns = ["doc", "size", "source_size", "target"]
    return placed.where(~on_boundary).select(*columns, below.alias("times")).unionByName(
        edge.select(*columns, (F.col("epochs") + (F.col("number") < nearest).cast("long")).cast("long").alias("times"))
    )
