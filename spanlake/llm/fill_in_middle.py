"""Fill-in-the-middle transformation: a Fenwick tree over a text's blocks finds the cuts between its units."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = "<[PSM]>"

BLOCK = 512  # bytes
SLICE = 1 << 20  # bytes that are counted at a time, whole blocks
ROWS = 1024  # texts of a result batch

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


class Fenwick:
    """Prefix sums of one count over blocks: `tree[i]` sums the block i and those before it down to `i - lowbit(i)`."""

    def __init__(self, counts: np.ndarray):
        upto = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        i = np.arange(len(upto))
        self.tree = (upto - upto[i & (i - 1)]).tolist()
        self.total = int(upto[-1])

    def before(self, block: int) -> int:
        """The sum over the blocks before `block`."""
        out = 0
        while block > 0:
            out += self.tree[block]
            block &= block - 1
        return out

    def find(self, k: int) -> tuple[int, int]:
        """The block that holds the k-th counted thing (from 1), and which one of the block it is."""
        block, step = 0, 1 << (len(self.tree) - 1).bit_length()
        while step:
            if block + step < len(self.tree) and self.tree[block + step] < k:
                block += step
                k -= self.tree[block]
            step >>= 1
        return block, k


class Units:
    """The units of a UTF-8 text: each word with the white space before it, and white space at the end."""

    def __init__(self, text: bytes):
        self.data = np.frombuffer(text, dtype=np.uint8)
        ends, points = [], []
        for start in range(0, len(text), SLICE):
            part = self.data[start : start + SLICE]
            at = np.arange(0, len(part), BLOCK)
            ends.append(np.add.reduceat(self._ends(start, start + len(part)), at, dtype=np.int64))
            points.append(np.add.reduceat((part & 0xC0) != 0x80, at, dtype=np.int64))
        self.words = Fenwick(np.concatenate(ends) if ends else np.zeros(0))
        self.points = Fenwick(np.concatenate(points) if points else np.zeros(0))
        self.n = self.words.total + bool(len(text) and _WHITE[self.data[-1]])

    def _ends(self, start: int, stop: int) -> np.ndarray:
        """Which bytes are the last of a word."""
        white = np.ones(stop - start + 1, dtype=bool)
        part = _WHITE[self.data[start : stop + 1]]
        white[: len(part)] = part
        return ~white[:-1] & white[1:]

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first k units."""
        if k <= 0:
            return 0, 0
        if k > self.words.total:
            return len(self.data), self.points.total
        block, rest = self.words.find(k)
        start = block * BLOCK
        at = start + int(np.flatnonzero(self._ends(start, min(start + BLOCK, len(self.data))))[rest - 1]) + 1
        return at, self.points.before(block) + int(((self.data[start:at] & 0xC0) != 0x80).sum())


def draws(seed: int, doc_id: object) -> list[int]:
    """Four numbers that the seed and the document's id fix, each of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, n, form, prefix_chars, middle_chars, output)` per row: the text's n units, cut at two drawn places and put in another order.

    A draw decides whether a text is cut (`percent`), and whether its form is `spm` (suffix, prefix, middle; `spm_percent`) or `psm`. Other texts, empty
    ones and those that hold a mark are `plain`: the text itself, with null lengths. The draws depend on the seed and the id only, so
    rows that share an id are drawn alike and a rerun cuts alike; a null id draws like an empty one. A null text is empty; repeated rows each
    keep a row; other columns are not read; an empty table gives no row. Texts of any length are cut whole: the tree has one entry for each block
    of 512 bytes, and only the two blocks that hold a cut are read again. One Arrow pass over the scan, no shuffle.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string").fields])

    def one(doc_id: object, text: bytes) -> tuple:
        units = Units(text)
        h = draws(seed, doc_id)
        if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= percent:
            return units.n, "plain", None, None, text
        first, last = sorted(x % (units.n + 1) for x in h[:2])
        (a, a_points), (b, b_points) = units.cut(first), units.cut(last)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        spm = h[3] % 100 < spm_percent
        parts = (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if spm else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
        return units.n, "spm" if spm else "psm", a_points, b_points - a_points, b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                rows = [one(i.as_py(), t.as_buffer().to_pybytes() if t.is_valid else b"") for i, t in zip(part.column(0), part.column(1), strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that `transform` made `output` and `form` of. No part holds a mark, and none can arise where parts meet."""
    parts = F.split(output, MARKS, -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
