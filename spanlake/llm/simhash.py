"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.components import components
from spanlake.session import cut_lineage

BYTES = 8
SLICE = 1 << 20  # bytes of a text that are split into words at a time
WHITE = b" \t\n\x0b\x0c\r"


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a slice of it at a time, each slice ending between words."""
    start = 0
    while start < len(text):
        end = min(start + SLICE, len(text))
        while end < len(text) and text[end] not in WHITE:
            end += 1
        yield text[start:end].split()
        start = end


def _hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every shingle of `width` words, in runs; a shorter text is one shingle, an empty one none."""
    digest = xxhash.xxh64_intdigest
    carry: list[bytes] = []
    found = False
    for words in _words(text.lower()):
        words = carry + words
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
            starts = np.concatenate(([0], ends[:-1]))
            last = len(words) - width + 1
            spans = zip(starts[:last].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)
            yield np.fromiter((digest(joined[a:b], 42) for a, b in spans), dtype=np.uint64, count=last)
            found = True
            carry = words[last:]
        else:
            carry = words
    if not found and carry:
        yield np.array([digest(b" ".join(carry), 42)], dtype=np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit, from bit 0. Eight one-byte counters are added at a time, 255 rows at most."""
    lanes = np.uint64(0x0101010101010101)
    cuts = np.arange(0, len(hashes), 255)
    counts = np.empty((8, 8), dtype=np.int64)
    for bit in range(8):
        part = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, cuts)
        counts[:, bit] = part.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts.reshape(64)


def fingerprint(text: bytes | None, width: int) -> int:
    """The 64-bit SimHash as a signed integer: a bit is set if over half the shingle hashes set it; no word gives 0."""
    counts, total = np.zeros(64, dtype=np.int64), 0
    for hashes in _hashes(text or b"", width):
        counts += _bit_counts(hashes)
        total += len(hashes)
    bits = np.packbits((2 * counts > total).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """`(id, fp)` of every row: one Arrow pass over the scan, no shuffle; only the two columns are read."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, width) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def linked_fingerprints(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs `(a, b)`, a < b, of distinct fingerprints at `max_bits` or fewer differing bits.

    Two fingerprints at d differing bits share at least 8 - d of their 8 positional bytes. A posting of the index is
    therefore keyed by that guaranteed number of positional bytes at once (which positions, and their bytes): a pair
    meets in a posting exactly when its tally of shared positional bytes reaches the minimum, and pairs below it are
    never formed. The bits of those that meet are then counted. A posting holds at most 256^d fingerprints, whatever
    the input, so no group grows with the data.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("a posting is bounded only for 0, 1 or 2 differing bits")
    masks = []
    for free in combinations(range(BYTES), max_bits):
        mask = (1 << 64) - 1
        for position in free:
            mask &= ~(0xFF << (8 * position))
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("positions"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared")) for i, m in enumerate(masks)])
    postings = (
        distinct.select("fp", F.explode(keys).alias("key"))
        .groupBy("key")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
    )
    return (
        postings.select("fps", F.explode("fps").alias("a"))
        .select("a", F.explode(F.expr(f"filter(fps, x -> x > a AND bit_count(x ^ a) <= {max_bits})")).alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """`(id, fp, component_id)` per row; component_id is the smallest id reachable over links of near fingerprints.

    Equal fingerprints are one node, so thousands of copies cost one row. A null or empty text has fingerprint 0 and
    links like any other; repeated rows each keep a row; a row with a null id joins its component but never names it
    (a component of such rows only has a null component_id). Other columns are not read. An empty table gives no row.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, width))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("first_id"))
    roots = components(linked_fingerprints(nodes.select("fp"), max_bits))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = named.join(least, "root").select("fp", "component_id")
    return prints.join(members, "fp").select("id", "fp", "component_id")
