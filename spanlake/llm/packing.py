"""Sequence packing as a cutting-stock problem: column generation over the length histogram, then ranks take the slots."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.token_ids import encoder
from spanlake.session import cut_lineage

ID_BYTES = 4


@dataclass(frozen=True)
class Pattern:
    """`lengths[k]` appears `counts[k]` times in a sequence; `copies` sequences are cut so."""

    lengths: tuple[int, ...]
    counts: tuple[int, ...]
    copies: int


def padded(total: int, size: int) -> int:
    """What a sequence of `total` ids costs: nothing is added at a power of two, else it is padded to `size`."""
    return total if total & (total - 1) == 0 else size


def _price(duals: np.ndarray, lengths: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The pattern of largest (value - cost): an unbounded knapsack over exact fills, then the fill whose padded cost leaves most."""
    worth = np.full(size + 1, -np.inf)
    worth[lengths] = duals
    value, last = np.full(size + 1, -np.inf), np.zeros(size + 1, dtype=np.int64)
    value[0] = 0
    for t in range(1, size + 1):
        options = value[t - 1 :: -1] + worth[1 : t + 1]
        last[t] = options.argmax() + 1
        value[t] = options[last[t] - 1]
    gains = value - np.array([padded(t, size) for t in range(size + 1)], dtype=float)
    end = int(gains[1:].argmax()) + 1
    column = np.zeros(len(lengths))
    at, rest = {int(n): k for k, n in enumerate(lengths)}, end
    while rest > 0:
        column[at[int(last[rest])]] += 1
        rest -= int(last[rest])
    return float(gains[end]), column


def _start(need: dict[int, int], size: int) -> tuple[list[dict[int, int]], list[float]]:
    """A feasible basis close to the optimum: patterns without padding where there are any, each used until one of its lengths is spent.

    For the longest length left, the rest of the sequence is filled by one length, by two, or by the longest that fits and then again. As each
    pattern spends a length, the patterns are as many as the lengths and, in this order, triangular.
    """
    left = np.zeros(size + 1)
    for n, k in need.items():
        left[n] = k
    patterns, shares, spent = [], [], set()
    while left.any():
        n = int(np.flatnonzero(left)[-1])
        taken, room = {n: 1}, size - n
        while room > 0:
            free = left - np.array([taken.get(k, 0) for k in range(size + 1)]) > 0
            half = np.minimum(left[1:room] * free[1:room], (left[1:room] * free[1:room])[::-1])
            if room % 2 == 0 and len(half):
                half[room // 2 - 1] /= 2
            one, two = left[room] * free[room], half.max(initial=0)
            if one > 0 and one >= min(two, left[n]):
                parts = [room]
            elif two > 0:
                k = int(half.argmax()) + 1
                parts = [k, room - k]
            elif padded(size - room, size) == size - room or not free[1 : room + 1].any():
                break
            else:
                parts = [int(np.flatnonzero(free[1 : room + 1])[-1]) + 1]
            for k in parts:
                taken[k] = taken.get(k, 0) + 1
                room -= k
        share = min(left[k] / c for k, c in taken.items())
        first = next(k for k, c in taken.items() if left[k] / c == share)
        for k, c in taken.items():
            left[k] = 0 if k == first or left[k] - share * c < 1e-9 else left[k] - share * c
        patterns.append(taken)
        shares.append(share)
        spent.add(first)
        for k in taken:
            if left[k] == 0 and k not in spent:  # two lengths spent at once
                patterns.append({k: size // k})
                shares.append(0.0)
                spent.add(k)
    return patterns, shares


@dataclass(frozen=True)
class Plan:
    """Patterns, and how many columns the knapsack priced in."""

    patterns: list[Pattern]
    rounds: int


def solve(demand: dict[int, int], size: int, gap: float = 1e-6, window: int = 100) -> Plan:
    """Patterns without padding that together need no more pieces of any length than `demand` has.

    The linear program by column generation: the revised simplex starts from `_start` as its first basis; each round the knapsack prices
    one column in and the ratio test one out. It ends when no column pays (the dual bound), when the padding left is under `gap` of all ids, which is the
    bound that no solution passes, or when `window` rounds removed less than a tenth of the padding left. The
    solution is rounded down, patterns that would be padded are left out, and the pieces that this leaves are filled into further whole patterns by
    `_fills`. All of it works on the histogram, at most `size` - 1 numbers, so its time does not grow with the documents.
    """
    lengths = np.array(sorted(n for n in demand if demand[n] > 0), dtype=np.int64)
    if not len(lengths):
        return Plan([], 0)
    at = {int(n): k for k, n in enumerate(lengths)}
    need = np.array([demand[int(n)] for n in lengths], dtype=float)
    patterns, shares = _start({int(n): demand[int(n)] for n in lengths}, size)
    columns = np.zeros((len(lengths), len(lengths)))
    for k, taken in enumerate(patterns):
        for n, c in taken.items():
            columns[at[n], k] = c
    x = np.array(shares)
    cost = np.array([padded(int(c @ lengths), size) for c in columns.T], dtype=float)
    least = float(need @ lengths)
    inverse = np.linalg.inv(columns)
    good = columns.copy(), x.copy()
    rounds, checked = 0, cost @ x - least
    while cost @ x > least * (1 + gap):
        gain, column = _price(cost @ inverse, lengths, size)
        step = inverse @ column
        if gain <= 1e-7 or not (step > 1e-7).any():
            break
        ratio = np.full(len(x), np.inf)
        np.divide(x, step, out=ratio, where=step > 1e-7)
        out = int(ratio.argmin())
        columns[:, out], cost[out] = column, padded(int(column @ lengths), size)
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        rounds += 1
        if rounds % window == 0:  # anew, against rounding errors
            try:
                inverse = np.linalg.inv(columns)
            except np.linalg.LinAlgError:
                columns, x = good
                break
            x = np.maximum(inverse @ need, 0)
            good = columns.copy(), x.copy()
            now = cost @ x - least
            if now > 0.9 * checked:
                break
            checked = now
    left = need.astype(np.int64)
    found = []
    for column, share in zip(columns.T.astype(np.int64), x, strict=True):
        used, total = column > 0, int(column @ lengths)
        copies = min(int(share + 1e-9), int((left[used] // column[used]).min()))
        if copies > 0 and padded(total, size) == total:
            left -= copies * column
            found.append(Pattern(tuple(lengths[used].tolist()), tuple(column[used].tolist()), copies))
    return Plan(found + _fills({int(n): int(k) for n, k in zip(lengths, left, strict=True) if k}, size), rounds)


def _fills(left: dict[int, int], size: int) -> list[Pattern]:
    """Whole patterns of the pieces left, one at a time: the longest piece and those that fill its sequence exactly, found by a bounded knapsack over
    sums (bit s of `sums[k]`: the first k pieces on offer can make s). A piece that no others complete is passed over."""
    left, found, whole = dict(left), [], (1 << (size + 1)) - 1
    for n in sorted(left, reverse=True):
        while left.get(n):
            left[n] -= 1
            room, offer, sums = size - n, [], [1]
            for m in sorted((m for m, k in left.items() if k and m <= size - n), reverse=True):
                for _ in range(min(left[m], room // m)):
                    offer.append(m)
                    sums.append((sums[-1] | sums[-1] << m) & whole)
                    if sums[-1] >> room & 1:
                        break
                if sums[-1] >> room & 1:
                    break
            if not sums[-1] >> room & 1:
                left[n] = 0
                continue
            taken = {n: 1}
            for k in range(len(offer) - 1, -1, -1):
                if not sums[k] >> room & 1:
                    room -= offer[k]
                    taken[offer[k]] = taken.get(offer[k], 0) + 1
                    left[offer[k]] -= 1
            found.append(Pattern(tuple(taken), tuple(taken.values()), 1))
    return found


def cut(docs: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, start, length, ids, doc_tokens)`: the ids of every text and `end_id`, cut into pieces of `size` and a shorter rest."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T.StructType.fromDDL("start long, length long, ids binary, doc_tokens long").fields])
    tail = int(end_id).to_bytes(ID_BYTES, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = encoder(tokenizer).encode
        for batch in batches:
            rows, starts, parts, totals = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                raw = encode_text(text.as_buffer().to_pybytes() if text.is_valid else None) + tail
                for begin in range(0, len(raw), size * ID_BYTES):
                    rows.append(row)
                    starts.append(begin // ID_BYTES)
                    parts.append(raw[begin : begin + size * ID_BYTES])
                    totals.append(len(raw) // ID_BYTES)
            lengths = [len(p) // ID_BYTES for p in parts]
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(parts, pa.binary()), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(encode, schema)


def _slots(patterns: list[Pattern]) -> tuple[list[tuple], dict[int, int], int]:
    """For each pattern and length: the ranks that it takes, `per` of them in each copy, its first sequence, and where they
    stand; then how many ranks of each length are taken, and how many sequences there are."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for p in patterns:
        at = 0
        for n, k in zip(p.lengths, p.counts, strict=True):
            first = taken.get(n, 0)
            out.append((n, first, first + k * p.copies, k, sequence, at))
            taken[n] = first + k * p.copies
            at += k * n
        sequence += p.copies
    return out, taken, sequence


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", rows_per_rank_bucket: int = 5_000) -> DataFrame:
    """Every id of every document in exactly one piece of one sequence of at most `size` ids.

    `(doc_id, start, length, ids, doc_tokens, sequence_id, offset)`, `ids` as little-endian unsigned 32-bit. A document's
    full pieces are sequences of their own. The rests are packed by `solve` from their length histogram: the k-th rest of
    a length takes the k-th slot of that length. Rests without a slot (what no pattern without padding takes) stand one after another and are cut where a sequence is full, so only the last sequence is padded.

    Only rests are ranked and moved. Ranks are counted in hash buckets whose number follows the number of pieces, so that a length which a third of
    all documents share is many small groups. Only the histogram (under `size` rows) reaches the driver and only the slot
    table (rows for each length and pattern) goes back. Texts do not move: tokens are made in the scan. A null or empty
    text is the single `end_id`; repeated rows are packed as often as they occur; an empty table gives no row.
    """
    spark = docs.sparkSession
    pieces = cut_lineage(cut(docs, tokenizer, end_id, size, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()))
    rests = pieces.where(F.col("length") < size)
    histogram = {r["length"]: r["n"] for r in rests.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, taken, sequences = _slots(solve(histogram, size).patterns)
    stream, streams = sequences * size, []
    for n in sorted(histogram):
        streams.append((n, taken.get(n, 0), stream))
        stream += n * (histogram[n] - taken.get(n, 0))
    sequences = -(-stream // size)
    buckets = max(1, -(-sum(histogram.values()) // rows_per_rank_bucket))
    keyed = rests.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    counted = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("uid")
    ranked = keyed.withColumn("n", F.row_number().over(within)).join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("n") - 1)
    table = spark.createDataFrame(slots, "length long, low long, high long, per long, first_sequence long, at long")
    runs = table.groupBy("length").agg(F.collect_list(F.struct("low", "high", "per", "first_sequence", "at")).alias("runs"))
    ends = spark.createDataFrame(streams, "length long, taken long, stream long")
    placed = ranked.join(F.broadcast(runs), "length", "left").join(F.broadcast(ends), "length", "left")
    placed = placed.withColumn("slot", F.get(F.expr("filter(runs, r -> r.low <= rank AND rank < r.high)"), F.lit(0)))
    k = F.col("rank") - F.col("slot.low")
    first = F.when(F.col("slot").isNull(), F.col("stream") + (F.col("rank") - F.col("taken")) * F.col("length")).otherwise(
        (F.col("slot.first_sequence") + F.floor(k / F.col("slot.per"))) * size + F.col("slot.at") + F.pmod(k, F.col("slot.per")) * F.col("length")
    )
    placed = placed.select("doc_id", "start", "length", "ids", "doc_tokens", first.alias("place"))
    room = F.lit(size) - F.pmod("place", F.lit(size))
    halves = F.when(F.col("length") <= room, F.array(F.struct(F.lit(0).cast("long").alias("skip"), F.col("length").alias("take")))).otherwise(
        F.array(F.struct(F.lit(0).cast("long").alias("skip"), room.alias("take")), F.struct(room.alias("skip"), (F.col("length") - room).alias("take")))
    )
    full = pieces.where(F.col("length") == size).select(
        "doc_id", "start", "length", "ids", "doc_tokens", (F.col("uid") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return full.unionByName(placed.withColumn("half", F.explode(halves)).select(
        "doc_id",
        (F.col("start") + F.col("half.skip")).alias("start"),
        F.col("half.take").alias("length"),
        F.substring("ids", (F.col("half.skip") * ID_BYTES + 1).cast("int"), (F.col("half.take") * ID_BYTES).cast("int")).alias("ids"),
        "doc_tokens",
        F.floor((F.col("place") + F.col("half.skip")) / size).alias("sequence_id"),
        F.pmod(F.col("place") + F.col("half.skip"), F.lit(size)).alias("offset"),
    ))
