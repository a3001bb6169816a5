"""Filter interaction audit: what each filter removes, alone and behind others, in every order of the filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.byte_words import COUNTS, measure
from spanlake.session import cut_lineage

FILTERS = "ABCDE"


def measured(docs: DataFrame, symbols: str, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row with `COUNTS` of its text and the text's sha256, in one Arrow pass over the scan.

    A null text is empty. `symbols` are ASCII characters. Texts of any length are read whole, a slice at a time.
    """
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("text"))
    head = rows.schema.fields[:-1]
    schema = T.StructType([*head, *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("digest", T.BinaryType())])
    marks = symbols.encode("ascii")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            counts = measure(texts, marks)
            digests = pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, pa.int64()) for c in counts.T], digests], schema.names)

    return rows.mapInArrow(run, schema)


def failures(
    docs: DataFrame, labels: DataFrame, least_words: int = 50, distinct_percent: int = 65, capital_percent: int = 5, symbols: str = "#$%&*|",
    id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
) -> DataFrame:
    """`(part, failing, n, good, toxic)`: how many documents of a part fail exactly the filters of the bit set `failing`.

    Bit k stands for `FILTERS[k]`. A: under `least_words` words. B: under `distinct_percent` percent of the words distinct. C: over
    `capital_percent` percent of the code points in A-Z. D: holds a symbol. E: the same text stands under a smaller id anywhere. A
    document is good or toxic if a label row of its id says so.

    Equal rows are added up before anything is joined. A text's smallest id is then found over sums (one row for each text,
    part, label and set of the first four), so thousands of copies of one text are a few rows when they meet their smallest id.
    """
    keep = [F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")]
    rows = measured(docs, symbols, keep, text_col)
    fails = (
        F.col("words") < least_words,
        100 * F.col("distinct_words") < distinct_percent * F.col("words"),
        100 * F.col("capitals") > capital_percent * F.col("code_points"),
        F.col("symbols") > 0,
    )
    first_four = sum((x.cast("int") * (1 << k) for k, x in enumerate(fails)), F.lit(0))
    alike = cut_lineage(rows.groupBy("doc_id", "part", "digest", first_four.alias("first_four")).agg(F.count("*").alias("n")))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = alike.join(marks, F.col("doc_id") == F.col("labelled"), "left").select("doc_id", "part", "digest", "first_four", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    named = F.col("doc_id").isNotNull()
    groups = cut_lineage(
        marked.groupBy("digest", "part", "first_four", "good", "toxic").agg(
            F.sum("n").alias("n"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(~named, F.col("n")).otherwise(0)).alias("unnamed")
        )
    )
    # One id may stand in several rows of `alike` for one text only if its parts differ, so a group's smallest id is one row.
    least = groups.groupBy(F.col("digest").alias("text")).agg(F.min("first.doc_id").alias("least"))
    found = groups.join(least, F.col("digest") == F.col("text"))
    only = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    each = found.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("first_four").alias("failing"), only.alias("n")),
        F.struct((F.col("first_four") + (1 << 4)).alias("failing"), (F.col("n") - only).alias("n")),
    )).alias("x"))
    return each.groupBy("part", F.col("x.failing").alias("failing")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def interactions(failed: DataFrame) -> DataFrame:
    """`failures` -> one row for each part, order and step, zeros included.

    A part is one row with 32 sums for each count: the documents that fail none of a set of filters. Every count of every order is a
    difference of two of them, so nothing but these sums is shuffled, however many documents a part has.
    """
    sets, orders = 1 << len(FILTERS), factorial(len(FILTERS))
    whole = ("n", "good", "toxic")
    maps = failed.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("failing", c))).alias(c) for c in whole])
    exact = maps.select("part", *[F.expr(f"transform(sequence(0, {sets - 1}), m -> coalesce(try_element_at({c}, m), 0L))").alias(c) for c in whole])
    over = lambda value, test: f"aggregate(sequence(0, {sets - 1}), 0L, (a, m) -> a + IF({test}, {value}, 0L))"
    passing = exact.select(
        "part",
        *[F.expr(f"transform(sequence(0, {sets - 1}), s -> {over(f'{c}[m]', '(m & s) = 0')})").alias(c) for c in whole],
        # Of all orders, a document that fails k filters is removed by each of them in one of k.
        F.expr(f"transform(sequence(0, {len(FILTERS) - 1}), f -> {over(f'n[m] * ({orders} DIV bit_count(m))', '(m & shiftleft(1, f)) <> 0')})").alias("shares"),
    )
    every = ",".join("".join(x) for x in permutations(FILTERS))
    bit_at = f"shiftleft(1, locate(substr(filter_order, k, 1), '{FILTERS}') - 1)"
    ordered = passing.select("*", F.explode(F.split(F.lit(every), ",")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    rows = ordered.withColumns({
        "f": F.expr(f"locate(substr(filter_order, step, 1), '{FILTERS}') - 1"),
        "before": F.expr(f"aggregate(sequence(1, {len(FILTERS)}), 0, (a, k) -> a + IF(k < step, {bit_at}, 0))"),
    }).withColumn("bit", F.expr("shiftleft(1, f)"))
    here = lambda c: f"{c}[before] - {c}[before | bit]"
    return rows.selectExpr(
        "part", "filter_order", "step",
        "n[before | bit] AS kept",
        f"{here('n')} AS removed",
        f"n[0] - n[bit] - ({here('n')}) AS redundant",
        f"n[{sets - 1} - bit] - n[{sets - 1}] AS unique_fails",
        f"{here('good')} AS good_lost",
        f"{here('toxic')} AS toxic_lost",
        "shares[f] AS shapley",
    )


def audit(docs: DataFrame, labels: DataFrame, **rules) -> DataFrame:
    """`(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`: five filters in every order.

    `rules` are those of `failures`. A row is one part (a source; null is the empty string), one of the 120 orders and one step of it:
    `kept` documents are left after the step, `removed` go here, `redundant` ones fail the step's filter but went earlier,
    `unique_fails` fail no other filter, `good_lost` and `toxic_lost` are the removed ones with such a label, and `shapley` is what the filter
    removes summed over all orders. Null and empty texts are equal and fail A. Repeated rows each count; rows that share the smallest id of a
    text all pass E, as does a row with a null id, which makes no other row fail. Labels with a null id are left out, and of
    several label rows of one id any counts. Other columns are not read. An empty table has no part and gives no row.
    """
    return interactions(failures(docs, labels, **rules))
