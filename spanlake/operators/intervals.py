"""Interval joins and merging of half-open spans, both safe for a key with very many spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.operators.ordering import carried

BIN = 4096


def merge_spans(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = BIN) -> DataFrame:
    """Overlapping or touching spans merged per key.

    Spans with one start are folded map-side, then each (key, bin of starts) is scanned apart; a bin learns from one
    row per earlier bin how far their spans reach and how many merged spans they open.
    """
    d = spans.groupBy(*keys, start).agg(F.max(end).alias(end)).withColumn("_bin", F.floor(F.col(start) / width))
    reach = carried(d, keys, "_bin", {"_reach": (F.max(end), "max")})
    d = d.join(reach, [*keys, "_bin"])
    w = Window.partitionBy(*keys, "_bin").orderBy(start)
    before = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    opens = before.isNull() | (F.col(start) > before)
    d = d.withColumn("_open", opens.cast("int"))
    d = d.withColumn("_island", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    base = carried(d, keys, "_bin", {"_base": (F.sum("_open"), "sum")})
    d = d.join(base, [*keys, "_bin"]).withColumn("_island", F.col("_island") + F.coalesce("_base", F.lit(0)))
    merged = d.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end))
    return merged.drop("_island")


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end - 1) / width)))


def overlap_join(
    left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], width: int = BIN
) -> DataFrame:
    """Pairs of spans of one key that share a character, by an equi-join on key and offset bin.

    A pair that shares several bins is kept only in the bin where the later span starts, so nothing is deduplicated
    afterwards.
    """
    a = left.withColumn("_bin", _bins(F.col(l[0]), F.col(l[1]), width))
    b = right.withColumn("_bin", _bins(F.col(r[0]), F.col(r[1]), width))
    later = F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / width)
    return (
        a.join(b, [*keys, "_bin"])
        .where((F.col(l[0]) < F.col(r[1])) & (F.col(r[0]) < F.col(l[1])) & (F.col("_bin") == later))
        .drop("_bin")
    )
