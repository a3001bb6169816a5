"""Character-span helpers: regex spans as rows or as an array column, and interval arithmetic on columns.

Spans are half-open code-point offsets. Spark's regex functions give matched texts, not positions; `many_places` adds up the lengths of the matches and
of what lies between them, all JVM-side. `span_finder` takes positions from Python's `re` in one Arrow batch per call.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("label", T.StringType()),
    ]
)


def span_finder(patterns: dict[str, str], flags: int = 0, whole: bool = False):
    """A pandas UDF: every match of every pattern as (kind, start, end, first group or the `whole` match), by start."""

    @F.pandas_udf(T.ArrayType(SPAN))
    def find(text: pd.Series) -> pd.Series:
        compiled = [(kind, re.compile(p, flags)) for kind, p in patterns.items()]

        def one(s):
            if s is None:
                return None
            found = [
                (kind, m.start(), m.end(), m.group(1) if rx.groups and not whole else m.group())
                for kind, rx in compiled
                for m in rx.finditer(s)
            ]
            found.sort(key=lambda x: x[1])
            return found

        return text.map(one)

    return find


def many_places(df: DataFrame, keys: list[str], text: str, patterns: dict[str, tuple[str, int]]) -> DataFrame:
    """(keys, kind, n, start, end, match, label): every match of every Java pattern, in order, from one pass over the texts; `label` is the group. Keys tell
    texts apart; texts are not shuffled."""

    def listed(kind: str, pattern: str, group: int) -> Column:
        found = {"match": F.regexp_extract_all(text, F.lit(pattern), F.lit(0))}
        if group:
            found["label"] = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        sizes = F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("gap")
        zipped = F.arrays_zip(*[c.alias(name) for name, c in found.items()], sizes)
        met = F.filter(zipped, lambda m: m["match"].isNotNull())  # the last gap has no match
        return F.transform(met, lambda m, n: F.struct(
            F.lit(kind).alias("kind"), n.alias("n"), m["gap"].alias("gap"), m["match"].alias("match"), m["label" if group else "match"].alias("label")
        ))

    rows = df.select(*keys, F.explode(F.concat(*[listed(kind, *p) for kind, p in patterns.items()])).alias("m"))
    rows = rows.select(*keys, "m.*").withColumn("len", F.length("match").cast("long"))
    upto = Window.partitionBy(*keys, "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(upto)
    return rows.withColumn("end", end).select(*keys, "kind", "n", (F.col("end") - F.col("len")).alias("start"), "end", "match", "label")


def match_places(df: DataFrame, keys: list[str], text: str, pattern: str, group: int = 1) -> DataFrame:
    """(keys, n, start, end, match, label): every match of one pattern, as in `many_places`."""
    return many_places(df, keys, text, {"": (pattern, group)}).drop("kind")


BLOCK = 4096


def span_texts(spans: DataFrame, start: str, end: str, texts: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """`spans` (equal rows once) with the characters [start, end) of their text as `name`; an empty span has none.

    Texts are cut once into blocks of 4,096 characters that meet the spans touching them, so a span costs its own length, not its text's.
    """
    columns = spans.columns
    block = texts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))).alias("_block", "_chars"))
    lo, hi, base = F.col(start), F.col(end), F.col("_block").cast("long") * BLOCK
    touched = spans.where(hi > lo).withColumn("_block", F.explode(F.sequence(F.floor(lo / BLOCK).cast("int"), F.floor((hi - 1) / BLOCK).cast("int"))))
    from_ = F.greatest(lo - base, F.lit(0))
    cut = F.substring(F.col("_chars"), (from_ + 1).cast("int"), (hi - base - from_).cast("int"))
    met = touched.join(block, [key, "_block"]).select(*columns, F.struct("_block", cut.alias("_cut")).alias("_piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("_piece")), lambda x: x["_cut"]), "")
    return met.groupBy(*columns).agg(whole.alias(name))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


# Fixed value: the overlap that makes a passage relevant to a gold span (or the whole span, if shorter).
MIN_OVERLAP = 20


def touches(a0: Column, a1: Column, g0: Column, g1: Column) -> Column:
    return overlap(a0, a1, g0, g1) >= F.least(F.lit(MIN_OVERLAP), g1 - g0)
