"""Cluster bootstrap intervals, paired comparisons, rank correlation, majority answers."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.operators.ordering import dense_index
from spanlake.session import cut_lineage

# The interval's ends and the baseline that leaves no room.
CI_LOW, CI_HIGH = 0.025, 0.975
CEILING_LO = 0.95
DRAW_CHUNK = 1 << 20  # slots that a task draws at once
HELD_CLUSTERS = 16_384  # clusters of a slice, which a task holds
DIGITS = 10
BATCH_ROWS, BATCH_SIZE = 10_000, 4 << 20

# RFC 1321.
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
MD5_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def _md5_heads(messages: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 of padded 64-byte messages, all rows at once."""
    words = [np.ascontiguousarray(column) for column in messages.view("<u4").T]
    a, b, c, d = (np.full(len(messages), x, np.uint32) for x in MD5_START)
    for i in range(64):
        turn = i >> 4
        if turn == 0:
            mixed, j = d ^ (b & (c ^ d)), i
        elif turn == 1:
            mixed, j = c ^ (d & (b ^ c)), 5 * i + 1
        elif turn == 2:
            mixed, j = b ^ c ^ d, 3 * i + 5
        else:
            mixed, j = c ^ (b | ~d), 7 * i
        mixed += a
        mixed += words[j & 15]
        mixed += np.uint32(MD5_ADDED[i])
        by = MD5_TURNS[turn][i & 3]
        a, d, c, b = d, c, b, b + ((mixed << np.uint32(by)) | (mixed >> np.uint32(32 - by)))
    return (a + np.uint32(MD5_START[0])).byteswap()


def drawn_numbers(seed: int, b: int, start: int, stop: int) -> np.ndarray:
    """The numbers drawn in slots `start` to `stop` of a replicate: heads of the MD5 of `seed|b|slot`, so a lost task redraws the same ones."""
    found, prefix = [np.empty(0, np.uint32)], f"{seed}|{b}|".encode()
    while start < stop:
        digits = len(str(start))
        slots = np.arange(start, min(stop, start + 8192, 10**digits))
        size = len(prefix) + digits
        messages = np.zeros((len(slots), 64), np.uint8)
        messages[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
        for k in range(digits):
            messages[:, len(prefix) + k] = slots // 10 ** (digits - 1 - k) % 10 + ord("0")
        messages[:, size] = 0x80
        messages[:, 56:58] = size * 8 & 255, size * 8 >> 8
        found.append(_md5_heads(messages))
        start = int(slots[-1]) + 1
    return np.concatenate(found)


def _draw(keys: list[str], seed: int, bits: int):
    """Chunks of slots (keys, c, known, b, _lo), those of one replicate and start after each other, to (keys, b, _slice, _places): which clusters of a
    slice the chunk draws, 16 bits each. Groups share the numbers; each takes them modulo its clusters."""

    def run(batches):
        held, numbers = None, np.empty(0, np.uint32)
        for batch in batches:
            rows, slices, places, size = [], [], [], 0

            def table():
                own = batch.select([*keys, "b"]).take(pa.array(rows, pa.int64()))
                more = [pa.array(slices, pa.int64()), pa.array(places, pa.binary())]
                return pa.RecordBatch.from_arrays([*own.columns, *more], [*keys, "b", "_slice", "_places"])

            for row, (c, known, b, lo) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("c", "known", "b", "_lo")), strict=True)):
                if held != (b, lo):
                    held, numbers = (b, lo), numbers[:0]
                wanted = min(DRAW_CHUNK, c - lo)
                if len(numbers) < wanted:
                    numbers = np.concatenate([numbers, drawn_numbers(seed, b, lo + len(numbers), lo + wanted)])
                picks = numbers[:wanted].astype(np.int64) % c
                if known < c:  # a cluster that is null has no number
                    picks = picks[picks < known]
                at = picks >> bits
                if known <= 1 << bits:
                    found = [(0, picks)]
                else:
                    order = np.argsort(at.astype(np.min_scalar_type(int(at.max(initial=0)))), kind="stable")
                    at, picks = at[order], picks[order]
                    cuts = np.flatnonzero(np.diff(at)) + 1
                    found = [(int(part[0]) >> bits, part) for part in np.split(picks, cuts) if len(part)] or [(0, picks)]
                for number, part in found:
                    rows.append(row)
                    slices.append(number)
                    places.append((part & ((1 << bits) - 1)).astype("<u2").tobytes())
                    size += len(places[-1])
                if len(rows) >= BATCH_ROWS or size >= BATCH_SIZE:
                    yield table()
                    rows, slices, places, size = [], [], [], 0
            if rows:
                yield table()

    return run


def _add_up(keys: list[str], totals: list[str]):
    """A slice's clusters (`b` null), then its draws, to the sums of each row of draws. A sum without a value is null."""

    def run(batches):
        held: dict[str, tuple] = {}
        for batch in batches:
            rows, sums = [], {name: [] for name in totals}
            for row, (b, places) in enumerate(zip(batch.column("b"), batch.column("_places"), strict=True)):
                if not b.is_valid:
                    for name in totals:
                        values = batch.column(name)[row].values
                        held[name] = values.fill_null(0).to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False) if values.null_count else None
                    continue
                at = np.frombuffer(places.as_buffer(), "<u2")
                rows.append(row)
                for name in totals:
                    values, valid = held[name]
                    some = len(at) if valid is None else np.count_nonzero(valid[at])
                    sums[name].append(values[at].sum().item() if some else None)
            if rows:
                own = batch.select([*keys, "b"]).take(pa.array(rows, pa.int64()))
                more = [pa.array(sums[name], pa.int64() if name == "n" else pa.float64()) for name in totals]
                yield pa.RecordBatch.from_arrays([*own.columns, *more], [*keys, "b", *totals])

    return run


def replicates(per: DataFrame, keys: list[str], sums: list[str], n_boot: int, seed: int, held: int = HELD_CLUSTERS) -> DataFrame:
    """(keys, b, sums..., n): totals of every bootstrap replicate. `per`: keys, cluster, sums..., n.

    Each replicate draws, in every group of `c` clusters, `c` cluster numbers with replacement. Draws are dealt by replicate and chunk of slots and leave
    a task as 16-bit places in slices of `held` clusters; a slice's clusters meet its draws in one sorted stream, so a task holds one chunk or one slice,
    whatever the group, and only sums go on.
    """
    spark = per.sparkSession
    bits = max(8, min(16, held.bit_length() - 1))
    totals = [*sums, "n"]
    per = cut_lineage(per)
    idx = dense_index(per.where("cluster IS NOT NULL"), "cluster", keys, "pick")  # a null cluster is drawn but has no values, as ever
    sizes = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.count("cluster").alias("known"))
    sizes = cut_lineage(sizes.where(reduce(and_, [F.col(k).isNotNull() for k in keys])).where("known > 0"))
    slots = n_boot * (sizes.agg(F.max("c")).first()[0] or 0)
    parts = max(1, min(4 * spark.sparkContext.defaultParallelism, slots // 10_000))
    reps = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    chunks = reps.select("*", F.explode(F.expr(f"sequence(0L, c - 1, {DRAW_CHUNK}L)")).alias("_lo"))
    chunks = chunks.repartition(parts, "b", "_lo").sortWithinPartitions("b", "_lo")
    of_key = [per.schema[k] for k in keys]
    b = T.StructField("b", T.IntegerType())
    draws = chunks.mapInArrow(_draw(keys, seed, bits), T.StructType([*of_key, b, *T.StructType.fromDDL("_slice long, _places binary").fields]))
    values = F.struct("pick", *[F.col(s).cast("double" if s != "n" else "long").alias(s) for s in totals])
    slices = idx.groupBy(*keys, F.shiftright("pick", bits).alias("_slice")).agg(F.array_sort(F.collect_list(values)).alias("_v"))
    slices = slices.select(*keys, "_slice", *[F.col(f"_v.{s}").alias(s) for s in totals])
    both = draws.unionByName(slices, allowMissingColumns=True).repartition(*keys, "_slice").sortWithinPartitions(*keys, "_slice", "b")
    sums_of = [T.StructField(s, T.LongType() if s == "n" else T.DoubleType()) for s in totals]
    added = both.mapInArrow(_add_up(keys, totals), T.StructType([*of_key, b, *sums_of]))
    return added.groupBy(*keys, "b").agg(*[F.sum(s).alias(s) for s in totals])


def interval_ranks(n: Column) -> tuple[Column, Column]:
    """0-based positions of the interval's ends among n sorted values."""
    return F.floor(F.lit(CI_LOW) * n), F.least(n - 1, F.floor(F.lit(CI_HIGH) * n))


def interval(stats: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, lo, hi) from at most `n_boot` values per group."""
    w = Window.partitionBy(*keys)
    ranked = stats.where(F.col(value).isNotNull()).select(
        *keys, value, (F.row_number().over(w.orderBy(value)) - 1).alias("_at"), F.count(F.lit(1)).over(w).alias("_n")
    )
    lo, hi = interval_ranks(F.col("_n"))
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_at") == lo, F.col(value))).alias("lo"), F.max(F.when(F.col("_at") == hi, F.col(value))).alias("hi")
    )


def cluster_bootstrap(values: DataFrame, keys: list[str], cluster: str, value: str, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Mean and interval per group, resampling whole clusters.

    Values are summed per cluster before anything is drawn; a cluster with a third of all rows is one row by then.
    """
    keys = list(keys)
    v = values.where(F.col(value).isNotNull())
    if not keys:
        v, keys = v.withColumn("_one", F.lit(0)), ["_one"]
    per = v.groupBy(*keys, F.col(cluster).alias("cluster")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    whole = per.groupBy(*keys).agg(
        (F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_clusters")
    )
    reps = replicates(per, keys, ["s"], n_boot, seed)
    stats = reps.select(*keys, F.round(F.col("s") / F.col("n"), DIGITS).alias("stat"))
    out = whole.join(interval(stats, keys, "stat"), keys)
    return out.select(*keys, F.round("mean", DIGITS).alias("mean"), "lo", "hi", "n_items", "n_clusters").drop("_one")


def unmatched_items(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many items only one of two runs scored; both must be zero before a comparison."""
    both = a.select("item_id", F.lit(1).alias("_a")).join(b.select("item_id", F.lit(1).alias("_b")), "item_id", "full_outer")
    return both.agg(
        F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second")
    )


def paired_bootstrap(a: DataFrame, b: DataFrame, keys: list[str], n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """b minus a on the same items, per group, resampling clusters. `a`, `b`: item_id, cluster, value, keys (in a)."""
    pairs = a.join(b.select("item_id", F.col("value").alias("_b")), "item_id").withColumn("diff", F.col("_b") - F.col("value"))
    pairs = pairs.withColumn("_all", F.lit(0))
    grouped = [*keys, "_all"]
    means = pairs.groupBy(*grouped).agg(F.round(F.avg("value"), DIGITS).alias("a_mean"), F.round(F.avg("_b"), DIGITS).alias("b_mean"))
    ci = cluster_bootstrap(pairs, grouped, "cluster", "diff", n_boot, seed).withColumnRenamed("mean", "delta")
    return ci.join(means, grouped).drop("_all")


def verdict(lo: Column, hi: Column) -> Column:
    return F.when(lo > 0, "helps").when(hi < 0, "hurts").otherwise("no measurable change")


def at_ceiling(lo: Column) -> Column:
    return lo >= CEILING_LO


def tau_b(points: Column) -> Column:
    """Kendall's tau-b of an array of (x, y) structs over a fixed short list such as the rungs; null when undefined."""
    def sign(a, b):
        return F.signum((a - b).cast("double"))

    pairs = F.flatten(
        F.transform(
            points,
            lambda p, i: F.transform(
                F.slice(points, i + 2, F.size(points)),
                lambda q: F.struct(sign(p["x"], q["x"]).alias("dx"), sign(p["y"], q["y"]).alias("dy")),
            ),
        )
    )

    def count(rule):
        return F.size(F.filter(pairs, rule)).cast("double")

    conc = count(lambda d: (d["dx"] * d["dy"]) > 0)
    disc = count(lambda d: (d["dx"] * d["dy"]) < 0)
    tx = count(lambda d: (d["dx"] == 0) & (d["dy"] != 0))
    ty = count(lambda d: (d["dx"] != 0) & (d["dy"] == 0))
    base = F.sqrt((conc + disc + tx) * (conc + disc + ty))
    return F.when(base > 0, (conc - disc) / F.nullif(base, F.lit(0.0)))


def tier_report(rows: DataFrame, rungs: tuple[str, ...], n_boot: int = 2000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """How two answer keys rank the rungs.

    `rows`: item_id, cluster, match (0/1), and per rung the recall under both keys as `<rung>_human`, `<rung>_machine`.
    Returns (rung means under both keys) and one row: match rate, tau, its interval and how many replicates define it.
    """
    cols = [f"{r}_{k}" for r in rungs for k in ("human", "machine")]
    per = rows.groupBy("cluster").agg(
        *[F.sum(c).alias(c) for c in cols], F.sum("match").alias("match"), F.count(F.lit(1)).alias("n")
    ).withColumn("_all", F.lit(0))

    def points(n):
        return F.array(
            *[
                F.struct(F.round(F.col(f"{r}_human") / n, DIGITS).alias("x"), F.round(F.col(f"{r}_machine") / n, DIGITS).alias("y"))
                for r in rungs
            ]
        )

    whole = per.agg(*[F.sum(c).alias(c) for c in [*cols, "match"]], F.sum("n").alias("n"))
    reps = replicates(per, ["_all"], [*cols, "match"], n_boot, seed)
    taus = reps.select("_all", F.round(tau_b(points(F.col("n"))), DIGITS).alias("tau"))
    rates = reps.select("_all", F.round(F.col("match") / F.col("n"), DIGITS).alias("rate"))
    ci = interval(taus, ["_all"], "tau").withColumnsRenamed({"lo": "tau_lo", "hi": "tau_hi"})
    rate_ci = interval(rates, ["_all"], "rate").withColumnsRenamed({"lo": "match_lo", "hi": "match_hi"})
    defined = taus.groupBy("_all").agg(F.count("tau").alias("tau_defined"))
    report = (
        whole.select(
            F.lit(0).alias("_all"), F.col("n").alias("items"), F.round(F.col("match") / F.col("n"), DIGITS).alias("match_rate"),
            F.round(tau_b(points(F.col("n"))), DIGITS).alias("tau"),
        )
        .join(ci, "_all").join(rate_ci, "_all").join(defined, "_all").drop("_all")
    )
    means = whole.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(r).alias("rung"), F.round(F.col(f"{r}_human") / F.col("n"), DIGITS).alias("human"),
                        F.round(F.col(f"{r}_machine") / F.col("n"), DIGITS).alias("machine"),
                    )
                    for r in rungs
                ]
            )
        ).alias("m")
    ).select("m.*")
    return means, report


def rung_order(means: DataFrame, key: str) -> DataFrame:
    """One row: rungs by mean under one key, best first, ties by name."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col(key)).alias("k"), F.col("rung").alias("rung"))))
    return means.agg(listed.alias("l")).select(F.lit(key).alias("answer_key"), F.array_join(F.col("l.rung"), " > ").alias("order"))


def majority_answers(answers: DataFrame, question: str, answer: str) -> DataFrame:
    """The most frequent answer of each question, ties by name. Votes are counted map-side."""
    votes = answers.groupBy(question, answer).agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy(question).agg(F.min_by(answer, F.struct(-F.col("votes"), answer)).alias("majority"), F.max("votes").alias("votes"))
