"""Secret scan: fixed patterns, and strings in sensitive context that a primed compressor cannot shorten."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.session import cut_lineage

KINDS = ("assign", "access", "hex")
NOVEL = "novel"

#: The patterns of the three kinds, the least lengths of what they find, and the words that make a context sensitive.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
SENSITIVE = re.compile(rb"passw|passphrase|pwd|secret|token|key|auth|bearer|credential|private|signature|session|salt", re.IGNORECASE)

#: A run of what secrets are written in. All matches of `access` and `hex` that are long enough lie inside one.
RUN = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
CLASSES = (re.compile(rb"[0-9]"), re.compile(rb"[a-z]"), re.compile(rb"[A-Z]"))

NEAR = 80  # bytes before a string, on its line, in which a sensitive word must stand
AROUND = 512  # bytes on each side of a string that the compressor has read before it
LEVEL = 3
_CONTINUED = bytes(range(0x80, 0xC0))


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """`(start, end, kind)` in bytes of the fixed patterns' matches, leftmost and without overlap for each kind; short ones are dropped."""
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    for run in RUN.finditer(text):
        found += [(*m.span(), "access") for m in ACCESS.finditer(text, *run.span()) if m.end() - m.start() >= ACCESS_LEAST]
        found += [(*m.span(), "hex") for m in HEX.finditer(text, *run.span()) if m.end() - m.start() >= HEX_LEAST]
    return found


def candidates(text: bytes, known: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs outside all known spans that mix two of digits, small and capital letters and stand behind a sensitive word on their line."""
    spans, k, out = sorted(x[:2] for x in known), 0, []
    upto = 0  # the furthest end of the spans that start before the run's end
    for run in RUN.finditer(text):
        a, b = run.span()
        while k < len(spans) and spans[k][0] < b:
            upto, k = max(upto, spans[k][1]), k + 1
        if upto > a or sum(bool(c.search(text, a, b)) for c in CLASSES) < 2:
            continue
        line = max(text.rfind(b"\n", max(a - NEAR, 0), a) + 1, a - NEAR, 0)
        if SENSITIVE.search(text, line, a):
            out.append((a, b))
    return out


class Novelty:
    """How many bytes a string adds to its surroundings under a compressor that knows frequent identifiers."""

    def __init__(self, identifiers: bytes):
        known = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(identifiers) >= 8 else None
        if known:
            known.precompute_compress(level=LEVEL)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False).compress

    def of(self, text: bytes, start: int, end: int) -> float:
        """Added bytes for each byte of `text[start:end]`: near 1 for what is like nothing before it, near 0 for what repeats."""
        around = text[end : end + AROUND] + b"\n" + text[max(start - AROUND, 0) : start]
        return (len(self.pack(around + text[start:end])) - len(self.pack(around))) / (end - start)


def identifiers(docs: DataFrame, most: int = 4096, text_col: str = "text") -> bytes:
    """The `most` most frequent identifiers (4 to 32 letters and underscores, seen twice or more) of all texts, ties by name, the most frequent last.

    Counted over every text, added up in each task before the shuffle. A histogram of the counts (a sixteenth of an octave each, at most a thousand
    rows) tells which of them can be among the first, and only those are ordered, so what reaches the driver does not grow with the tasks. A run with a digit or with one of `+/=-` is no identifier and none of its parts is, so a key that thousands of copies share is not learned.
    """
    runs = docs.select(F.explode(F.split(F.col(text_col).cast("string"), "[^A-Za-z0-9_+/=-]+")).alias("name"))
    names = runs.where(F.length("name").between(4, 32) & F.col("name").rlike("^[A-Za-z_]+$"))
    counted = cut_lineage(names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").withColumn("level", F.floor(F.log2("n") * 16)))
    least, found = 0, 0
    for row in sorted(counted.groupBy("level").agg(F.count("*").alias("names")).collect(), reverse=True):
        least, found = row["level"], found + row["names"]
        if found >= most:
            break
    top = counted.where(F.col("level") >= least).orderBy(F.desc("n"), "name").limit(most).collect()
    return b"\n".join(r["name"].encode() for r in reversed(top))


def _in_points(text: bytes, spans: list[tuple]) -> list[dict]:
    """The spans, by start and kind, with their places in code points."""
    order = {kind: k for k, kind in enumerate((*KINDS, NOVEL))}
    places, at, points = {}, 0, 0
    for place in sorted({p for x in spans for p in x[:2]}):
        points += len(text[at:place].translate(None, _CONTINUED))
        places[place], at = points, place
    return [{"kind": kind, "start": places[a], "end": places[b], "novelty": novelty} for a, b, kind, novelty in sorted(spans, key=lambda x: (x[0], order[x[2]], x[1]))]


def scan(docs: DataFrame, known: bytes | None = None, least_novelty: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, spans)` per row; a span is `(kind, start, end, novelty)`, in code points, the end exclusive, by start and then kind.

    Base kinds are `assign`, `access` and `hex` (null novelty). `novel` spans are other runs of 16 and more characters in sensitive
    context whose marginal compressed size is `least_novelty` of their length or more. The compressor is primed with `known` (default: `identifiers` of
    these documents) and with the text on both sides of the run, so words, identifiers and what the text itself repeats come cheap.

    A null or empty text has no span; repeated rows each keep a row; null ids stay; other columns are not read; an empty table gives no row.
    Texts of any length are scanned whole, in one Arrow pass without a shuffle; what is broadcast is the dictionary.
    """
    held = docs.sparkSession.sparkContext.broadcast(identifiers(docs, text_col=text_col) if known is None else known)
    spans = T.ArrayType(T.StructType.fromDDL("kind string, start long, end long, novelty double"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("spans", spans)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(held.value)

        def one(text: bytes) -> list[dict]:
            base = base_spans(text)
            new = [(a, b, novelty.of(text, a, b)) for a, b in candidates(text, base)]
            return _in_points(text, [(*x, None) for x in base] + [(a, b, NOVEL, x) for a, b, x in new if x >= least_novelty])

        for batch in batches:
            found = [one(x.as_buffer().to_pybytes()) if x.is_valid else [] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
