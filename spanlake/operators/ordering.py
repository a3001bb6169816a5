"""Global order without a one-partition window: bucketed prefix sums, dense numbering, running values, rank picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.session import cut_lineage

SAMPLE_ROWS = 4096
# Ranges that values are cut into when one rank is looked for: so many, and one more for each so many values.
RANGES, RANGE_ROWS = 32, 500_000


def splitters(df: DataFrame, key: str, buckets: int) -> list:
    """Up to `buckets - 1` key values that cut `df` into about equal ranges.

    They come from a hash sample of a few thousand keys, the only rows that reach the driver.
    """
    keep = max(1, int((1 << 30) * min(1.0, SAMPLE_ROWS / max(1, df.count()))))
    sample = sorted(
        r[0] for r in df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < keep).select(key).dropna().collect()
    )
    step = max(1, len(sample) // buckets)
    return sorted(set(sample[step::step]))


def range_bucket(key: Column, cuts: list) -> Column:
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= key))


def prefix_offsets(counts: DataFrame, key: str, value: str, buckets: int = 256) -> DataFrame:
    """For each key, the sum of `value` over all smaller keys, as `offset`.

    Keys are cut into ranges; each range is summed on its own and only the few range totals are ordered together.
    """
    cuts = splitters(counts, key, buckets)
    b = counts.withColumn("_b", range_bucket(F.col(key), cuts))
    totals = b.groupBy("_b").agg(F.sum(value).alias("_t"))
    before = F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("_b", F.coalesce(before, F.lit(0)).alias("_base"))
    inside = F.sum(value).over(
        Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    )
    return b.join(totals, "_b").withColumn("offset", F.col("_base") + F.coalesce(inside, F.lit(0))).drop("_b", "_base")


def dense_index(rows: DataFrame, key: str, by: list[str] | None = None, name: str = "idx") -> DataFrame:
    """Numbers 0..n-1 per group for distinct keys in md5 order; md5 prefixes are numbered apart and stitched.

    The prefix order is the md5 order, so numbering 4096 slices and adding their few totals gives one global order
    that any rerun of a lost task reproduces.
    """
    by = by or []
    h = rows.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    totals = h.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*by, "_b", F.coalesce(before, F.lit(0)).alias("_base"))
    rn = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    return (
        h.withColumn("_rn", rn)
        .join(totals, [*by, "_b"])
        .withColumn(name, F.col("_base") + F.col("_rn") - 1)
        .drop("_h", "_b", "_rn", "_base")
    )


def carried(df: DataFrame, keys: list[str], chunk: str, aggs: dict[str, tuple[Column, str]]) -> DataFrame:
    """Per (keys, chunk): each aggregate taken over all earlier chunks of the same keys.

    `aggs` maps a name to (aggregate over rows, "sum" | "max" | "last"). Rows are reduced to one per chunk first.
    """
    per = df.groupBy(*keys, chunk).agg(*[expr.alias(n) for n, (expr, _) in aggs.items()])
    w = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    return per.select(*keys, chunk, *[fold[how](n).over(w).alias(n) for n, (_, how) in aggs.items()])


def rank_pick(df: DataFrame, keys: list[str], value: str, targets: dict[str, Column]) -> DataFrame:
    """For each group, the values that stand at given 1-based ranks of the sorted values.

    `targets` maps an output name to a rank computed from the column `n` (the group's size). Equal values are
    counted once, a group's value range is cut at its approximate quantiles, and only the one range that holds
    a wanted rank is sorted, so a group with a third of all rows is never sorted as a whole.
    """
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")))
    ranges = RANGES + counts.count() // RANGE_ROWS
    probes = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    heads = counts.groupBy(*keys).agg(
        F.percentile_approx(value, probes, F.lit(20 * ranges)).alias("_cuts"), F.sum("_c").alias("n")
    )
    want = F.map_from_arrays(
        F.array(*[F.lit(k) for k in targets]), F.array(*[c.cast("long") for c in targets.values()])
    )
    heads = heads.withColumn("_want", want)
    if keys:
        b = counts.join(heads, keys)
    else:
        b = counts.withColumn("_k", F.lit(0)).join(heads.withColumn("_k", F.lit(0)), "_k").drop("_k")
    b = b.withColumn("_b", F.size(F.filter("_cuts", lambda s: s < F.col(value))))
    per = b.groupBy(*keys, "_b").agg(F.sum("_c").alias("_t"), F.first("_want").alias("_want"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("_upto", F.sum("_t").over(w)).select(
        *keys, "_b", (F.col("_upto") - F.col("_t")).alias("_before"), "_upto", F.explode("_want").alias("_name", "_rank")
    )
    per = per.where((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_upto")))
    inner = b.select(*keys, value, "_c", "_b").join(per.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi")
    wi = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    inner = inner.withColumn("_cum", F.sum("_c").over(wi))
    hit = per.join(inner, [*keys, "_b"]).where(
        (F.col("_before") + F.col("_cum") >= F.col("_rank")) & (F.col("_before") + F.col("_cum") - F.col("_c") < F.col("_rank"))
    )
    picked = hit.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == k, F.col(value))).alias(k) for k in targets]
    )
    return picked


def index_percentile_rank(q: float) -> Column:
    """1-based rank of `sorted[min(n - 1, int(q * n))]`."""
    return F.least(F.col("n"), F.floor(F.lit(q) * F.col("n")) + 1)


def nearest_rank(p: float) -> Column:
    """1-based nearest rank for percent `p`."""
    return F.greatest(F.lit(1), F.ceil(F.lit(p) / 100 * F.col("n")))
