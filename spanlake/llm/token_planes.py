"""Token files: ids in fixed-size blocks, each transposed to byte or bit planes that are compressed one by one."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.token_ids import encoder

BLOCK = 1 << 16  # ids of a block
ID_BYTES = 4

#: `kind=block`: `n` ids from `first` of the shard, their planes, the pieces of documents in them (`seqs`, the place of
#: each in its document, and its length). `kind=doc`: document `seq` of the shard, its `n` ids from `first`.
BLOCK_FIELDS = "planes array<binary>, raw_crc32 long, seqs array<long>, begins array<long>, lengths array<int>"


def part_schema(id_type: str) -> str:
    return f"shard int, seq long, first long, n long, {BLOCK_FIELDS}, doc_id {id_type}, kind string"


def to_planes(ids: np.ndarray, bits: bool, level: int = 3) -> list[bytes]:
    """The planes of a block, lowest first: plane k holds byte (or bit) k of every id. All-zero planes shrink to a few bytes."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, ID_BYTES)
    planes = raw.T
    if bits:
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    pack = zstandard.ZstdCompressor(level=level).compress
    return [pack(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block; the number of planes tells byte planes from bit planes."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = np.stack([np.frombuffer(unpack(p), dtype=np.uint8) for p in planes])
    if len(planes) != ID_BYTES:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little"), axis=0, bitorder="little")
    return np.ascontiguousarray(rows.T).reshape(-1).view("<u4")


class _Shard:
    """The open block of one task and the documents that ended in it."""

    def __init__(self, schema: T.StructType, bits: bool):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema, self.bits = to_arrow_schema(schema), bits
        self.shard, self.seq, self.done, self.blocks = None, 0, 0, 0
        self._open()

    def _open(self) -> None:
        self.held, self.pieces, self.ended, self.filled = [], [], [], 0

    def add(self, shard: int, doc, raw: bytes) -> Iterator[pa.RecordBatch]:
        self.shard = shard
        view, begin, n = memoryview(raw), 0, len(raw) // ID_BYTES
        first = self.done + self.filled
        while begin < n:
            take = min(BLOCK - self.filled, n - begin)
            self.held.append(view[begin * ID_BYTES : (begin + take) * ID_BYTES])
            self.pieces.append((self.seq, begin, take))
            begin, self.filled = begin + take, self.filled + take
            if self.filled == BLOCK:
                yield self.flush()
        self.ended.append({"kind": "doc", "shard": shard, "seq": self.seq, "first": first, "n": n, "doc_id": doc})
        self.seq += 1

    def flush(self) -> pa.RecordBatch:
        rows = self.ended
        if self.filled:
            raw = b"".join(self.held)
            seqs, begins, lengths = zip(*self.pieces, strict=True)
            rows.append(
                {
                    "kind": "block", "shard": self.shard, "seq": self.blocks, "first": self.done, "n": self.filled,
                    "planes": to_planes(np.frombuffer(raw, "<u4"), self.bits), "raw_crc32": zlib.crc32(raw),
                    "seqs": seqs, "begins": begins, "lengths": lengths,
                }
            )
            self.blocks += 1
        self.done += self.filled
        self._open()
        return pa.RecordBatch.from_pylist(rows, schema=self.schema)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", bits: bool = False, shards: int | None = None) -> None:
    """Encode every text and write the ids under `path`, documents in ascending id order (null ids first).

    The file format is a folder that Spark's committer writes, so a lost task leaves no torn file and any store that
    Spark reaches will do. `parts/kind=block` has a row for each block of 65,536 ids, `parts/kind=doc` a row for each
    document, and `index` is the chunk index over both: how many ids, blocks and documents each shard holds. Shards
    follow each other in id order; a document may span blocks but not shards. A null text has no ids of its own but still gets
    `end_id`; repeated rows are written as often as they occur, equal ids in the order of a text hash. Other columns
    are not read. A task holds one Arrow batch of texts and one open block, never a shard.
    """
    spark = docs.sparkSession
    count = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(count, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text", F.spark_partition_id().alias("shard"))
    tail = b"" if end_id is None else int(end_id).to_bytes(ID_BYTES, "little")
    out = T.StructType.fromDDL(part_schema(docs.schema[id_col].dataType.simpleString()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, shard = encoder(tokenizer).encode, _Shard(out, bits)
        for batch in batches:
            for doc, text, where in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                yield from shard.add(where, doc, encode_text(text.as_buffer().to_pybytes() if text.is_valid else None) + tail)
        yield shard.flush()

    ordered.mapInArrow(encode, out).write.partitionBy("kind").option("compression", "none").parquet(f"{path}/parts")
    parts = spark.read.schema(out).parquet(f"{path}/parts")
    is_block = F.col("kind") == "block"
    index = parts.groupBy("shard").agg(F.coalesce(F.sum(F.when(is_block, F.col("n"))), F.lit(0)).alias("n_ids"), F.count(F.when(is_block, 1)).alias("blocks"), F.count(F.when(~is_block, 1)).alias("docs"))
    index.coalesce(1).write.parquet(f"{path}/index")


def open_files(spark: SparkSession, path: str, id_type: str = "long") -> tuple[DataFrame, DataFrame, DataFrame]:
    """`(blocks, docs, index)` of files that `write` made; `index` also has the id at which each shard starts."""
    index = spark.read.schema("shard int, n_ids long, blocks long, docs long").parquet(f"{path}/index")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    index = index.withColumn("shard_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))  # one row a shard
    parts = spark.read.schema(part_schema(id_type)).parquet(f"{path}/parts")
    blocks = parts.where("kind = 'block'").select("shard", F.col("seq").alias("block"), "first", "n", *T.StructType.fromDDL(BLOCK_FIELDS).names)
    return blocks, parts.where("kind = 'doc'").select("shard", "seq", "first", "n", "doc_id"), index


def _times(matrix: list[int], vector: int) -> int:
    total = 0
    for column in matrix:
        if vector & 1:
            total ^= column
        vector >>= 1
    return total


@cache
def _shift(power: int) -> list[int]:
    """The matrix that takes a crc32 through 2^power zero bits: one zero bit by the reflected polynomial, then squared."""
    if power == 0:
        return [0xEDB88320, *(1 << k for k in range(31))]
    half = _shift(power - 1)
    return [_times(half, column) for column in half]


def crc32_joined(first: int, second: int, second_bytes: int) -> int:
    """The crc32 of two strings joined, from their own: `first` goes through as many zero bits as the second has."""
    bits, power = 8 * second_bytes, 0
    while bits:
        if bits & 1:
            first = _times(_shift(power), first)
        bits, power = bits >> 1, power + 1
    return first ^ second


def read_pieces(blocks: DataFrame) -> DataFrame:
    """`(shard, seq, begin, ids)`: each document's piece in each block, decoded block by block and held against the stored crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, n, planes, crc, seqs, begins, lengths in zip(*batch.columns, strict=True):
                raw = from_planes(planes.as_py(), n.as_py()).tobytes()
                if zlib.crc32(raw) != crc.as_py():
                    raise ValueError(f"block {block} of shard {shard} is damaged")
                # The pieces lie end to end: the block's bytes and their ends are the column as it is.
                ends = np.concatenate(([0], np.cumsum(lengths.values.to_numpy()))).astype(np.int32) * ID_BYTES
                ids = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(raw)])
                columns = [pa.array(np.full(len(lengths), shard.as_py(), dtype=np.int32)), seqs.values, begins.values, ids]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "seq", "begin", "ids"])

    wanted = blocks.select("shard", "block", "n", "planes", "raw_crc32", "seqs", "begins", "lengths")
    return wanted.mapInArrow(decode, "shard int, seq long, begin long, ids binary")


def read_documents(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """`(doc_id, start, n_tokens, parts)` per document: `start` counts the ids of all documents before it; `parts` are its
    pieces in order, each with its ids."""
    blocks, docs, index = open_files(spark, path, id_type)
    parts = read_pieces(blocks).groupBy("shard", "seq").agg(F.array_sort(F.collect_list(F.struct("begin", "ids"))).alias("parts"))
    return _placed(docs, index, parts, "parts")


def _placed(docs: DataFrame, index: DataFrame, per_doc: DataFrame, *columns: str) -> DataFrame:
    starts = index.select("shard", "shard_start")
    return (
        docs.join(per_doc, ["shard", "seq"], "left")
        .join(starts, "shard")
        .select("doc_id", (F.col("first") + F.col("shard_start")).alias("start"), F.col("n").alias("n_tokens"), *columns)
    )


def digests(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """`(doc_id, start, n_tokens, ids_crc32)` per document, read back from the files.

    A piece is digested where it is decoded and a document of several pieces joins their crc32s, so no row holds more
    than a block, and a document of any length is a short list of numbers.
    """
    blocks, docs, index = open_files(spark, path, id_type)

    @F.udf("long")
    def joined(parts):
        crc = 0
        for part in sorted(parts, key=lambda p: p["begin"]):
            crc = crc32_joined(crc, part["crc"], part["size"])
        return crc

    pieces = read_pieces(blocks).select("shard", "seq", F.struct("begin", F.crc32("ids").alias("crc"), F.length("ids").alias("size")).alias("part"))
    parts = pieces.groupBy("shard", "seq").agg(F.collect_list("part").alias("parts"))
    single = parts.where(F.size("parts") == 1).select("shard", "seq", F.col("parts")[0]["crc"].alias("ids_crc32"))
    several = parts.where(F.size("parts") > 1).select("shard", "seq", joined("parts").alias("ids_crc32"))
    return _placed(docs, index, single.unionByName(several), F.coalesce("ids_crc32", F.lit(0)).alias("ids_crc32"))
