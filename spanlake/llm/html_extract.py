"""Main text of web pages: markup tells articles from furniture, and nearest-URL page differencing deletes lines that a site repeats."""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.ranks import ranked
from spanlake.llm.url_filter import host_of, path_of
from spanlake.session import cut_lineage, shared_folder

#: Elements whose content is never text, those that are furniture, those that hold the main text, and
#: those that start a new block.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas")
FURNITURE = ("nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "head")
MAIN = ("article", "main")
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul"
).split()
#: Words of class and id attributes that name furniture.
NAMED = (
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies disclaimer footer header menu nav navbar "
    "navigation newsletter notice notices popup promo related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget"
).split()

KEEP, LOOSE, AROUND = 1, 0, -1  # a line of marked main text; one outside it that no markup calls furniture; furniture
DOUBT = 2  # a line of marked main text whose own paragraph, list item or cell is named like furniture

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>|</?[a-zA-Z][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_BLOCKS, _FURNITURE, _MAIN, _NAMED = frozenset(BLOCKS), frozenset(FURNITURE), frozenset(MAIN), frozenset(NAMED)
_COMMENTS = frozenset(["comment", "comments"])
_NEST = _BLOCKS | _FURNITURE | _MAIN | {"span", "section"}
_ALONE = frozenset(["hr", "p", "li", "dt", "dd", "tr", "td", "th", "option"])  # may stay open; nothing is inferred from their ends


def _is_furniture(name: str, attrs: str) -> bool:
    if name in _FURNITURE:
        return True
    if "=" not in attrs or name in ("html", "body"):
        return False
    known = _COMMENTS if name in _MAIN else _NAMED
    return any(not known.isdisjoint(re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower())) for m in _NAMES.finditer(attrs))


def page_lines(page: str) -> list[tuple[str, int]]:
    """The page's lines of visible text, one for each block, as (text, KEEP, DOUBT, LOOSE or AROUND)."""
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, furniture, main: of what is open, with what is around it
    named = False  # the line's own start tag is named like furniture

    def end_block() -> None:
        nonlocal named
        if parts:
            furniture, main = stack[-1][1:] if stack else (False, False)
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                lines.append((text, AROUND if furniture else LOOSE if not main else DOUBT if named else KEEP))
            parts.clear()
        named = False

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            parts.append(page[at : token.start()])
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
        if name not in _NEST:
            continue
        if name != "span":
            end_block()
        if name in _ALONE:
            named = not token["end"] and _is_furniture(name, token["attrs"])
            continue
        if token["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif not token["attrs"].endswith("/"):
            around = stack[-1] if stack else ("", False, False)
            furniture = around[1] or _is_furniture(name, token["attrs"])
            if name == "span" and not furniture:
                stack.append((name, False, around[2]))
                continue
            if name == "span" and not around[1]:
                end_block()
            stack.append((name, furniture, around[2] or name in _MAIN))
    parts.append(page[at:])
    end_block()
    return lines


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of `a` stand in a longest common subsequence of `a` and `b`; time is their product, memory their sum."""
    shared = np.zeros(len(a), dtype=bool)
    _align(a, b, shared)
    return shared


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        hit = row.copy()
        hit[1:] = np.maximum(hit[1:], row[:-1] + (b == x))
        row = np.maximum.accumulate(hit)
    return row


def _align(a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> None:
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, left, right = todo.pop()
        while lo < hi and left < right and a[lo] == b[left]:
            shared[lo] = True
            lo, left = lo + 1, left + 1
        while lo < hi and left < right and a[hi - 1] == b[right - 1]:
            shared[hi - 1] = True
            hi, right = hi - 1, right - 1
        if lo == hi or left == right:
            continue
        if hi - lo == 1:
            shared[lo] = bool((b[left:right] == a[lo]).any())
            continue
        mid = (lo + hi) // 2
        ahead = _row(a[lo:mid], b[left:right])
        behind = _row(a[mid:hi][::-1], b[left:right][::-1])[::-1]
        cut = left + int((ahead + behind).argmax())
        todo += [(lo, mid, left, cut), (mid, hi, cut, right)]


def same_start(a: Column, b: Column) -> Column:
    """How many leading segments two paths share."""
    one, two = F.split(a, "/"), F.split(b, "/")
    pairs = F.arrays_zip(one.alias("x"), two.alias("y"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("same")), lambda s, p: F.struct((s["n"] + F.when(s["same"] & (p["x"] == p["y"]), 1).otherwise(0)).alias("n"), (s["same"] & F.coalesce(p["x"] == p["y"], F.lit(False))).alias("same")), lambda s: s["n"])


def nearest_pages(pages: DataFrame) -> DataFrame:
    """`pages(key, host, path)` -> `(key, mate)`: of a page's two neighbours in its host's path order the one that shares more
    leading path segments, ties to the one before; null for a host's only page.

    Neighbours are found by position in one global order, so a host with a third of all pages is cut like any other
    rows, and a page is the mate of two pages at most.
    """
    placed = ranked(pages.select("key", "host", "path"), "host", "path", "key")
    here = cut_lineage(placed)
    other = here.select((F.col("rank") - 1).alias("rank"), F.col("key").alias("next"), F.col("host").alias("next_host"), F.col("path").alias("next_path"))
    pairs = here.join(other, "rank").where("host = next_host").withColumn("near", same_start(F.col("path"), F.col("next_path")))
    both = pairs.select("key", F.struct(F.col("near"), F.lit(0).alias("before"), F.col("next").alias("mate")).alias("m")).union(
        pairs.select(F.col("next").alias("key"), F.struct(F.col("near"), F.lit(1).alias("before"), F.col("key").alias("mate")).alias("m"))
    )
    best = both.groupBy("key").agg(F.max("m")["mate"].alias("mate"))
    return here.select("key").join(best, "key", "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`(page_id, url, text)` per row; `text` is the page's main text, blocks joined by an empty line.

    Scripts and styles are no text. Every page is differenced: within its host it is paired with the page of the nearest URL path, and the lines of
    both, by their hashes, are aligned by longest common subsequence. Shared lines are the site's and go, unless markup says otherwise: lines in
    an element that its name, class or id calls menu, header, footer, sidebar, form, notice, advert or comments go in any case, and where a page marks its article,
    lines inside the mark stay although two addresses of one article share them all, and lines outside it go although no other page has them. Of the
    lines in the mark whose own paragraph, list item or cell is named like furniture, and of all others on pages without a mark, the shared ones are deleted.

    A null html, or a page without such lines, has an empty text. Pages without a host (null URL, or no `://`) are one site
    of their own. Pages of one host with the same lines (repeated rows, one page at several addresses) are one page, at the smallest of
    their paths: they share the nearest page whose lines differ, keep all lines if their host has none, and each keep a row. Nothing is capped: html of any length is read
    whole. What is ordered, paired and aligned are URLs and line hashes; texts only meet the places of lines to delete.
    """
    spark = pages.sparkSession
    head = [T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", T.StringType())]
    lined_schema = T.StructType([*head, *T.StructType.fromDDL("texts array<string>, open array<int>, hashes array<long>, digest binary").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column(2):
                lines = page_lines(page.as_py() or "")
                marked = any(kind > LOOSE for _, kind in lines)
                mine = (KEEP, DOUBT) if marked else (LOOSE,)
                told = DOUBT if marked else LOOSE
                texts, places = [], []
                for x, kind in lines:
                    places.append(len(texts) if kind == told else -1)  # where the line stands in `texts`, if differencing decides on it
                    if kind in mine:
                        texts.append(x)
                hashed = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x, _ in lines], dtype=np.uint64).view(np.int64)
                rows.append((texts, places, hashed, xxhash.xxh128_digest(hashed.tobytes())))
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            kinds = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], lined_schema.names)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    lined = rows.mapInArrow(read, lined_schema).withColumn("key", F.monotonically_increasing_id())
    lined.write.option("compression", "zstd").parquet(path)
    lined = spark.read.schema(lined.schema).parquet(path)
    placed = lined.select("key", "digest", F.size("hashes").alias("n"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    distinct = cut_lineage(placed.where("n > 0").groupBy("host", "digest").agg(F.min(F.struct("path", "key")).alias("first")))
    mates = nearest_pages(distinct.select("first.key", "host", "first.path"))
    theirs = lined.select(F.col("key").alias("mate"), F.col("hashes").alias("mate_hashes"))
    mated = distinct.select("host", "digest", "first.key").join(mates.join(theirs, "mate"), "key").select("host", "digest", "mate_hashes")
    paired = placed.select("key", "host", "digest").join(lined.select("key", "hashes", "open"), "key").join(mated, ["host", "digest"])

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, gone = [], []
            for key, own, places, other in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                shared = common_lines(np.array(own, dtype=np.int64), np.array(other, dtype=np.int64))
                told = np.array(places, dtype=np.int64)[shared]
                if (told >= 0).any():
                    keys.append(key)
                    gone.append(told[told >= 0].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])

    deleted = cut_lineage(paired.select("key", "hashes", "open", "mate_hashes").mapInArrow(difference, "key long, gone array<int>"))
    left = F.when(F.col("gone").isNull(), F.col("texts")).otherwise(F.filter("texts", lambda x, i: ~F.array_contains("gone", i)))
    return lined.join(deleted, "key", "left").select("page_id", "url", F.array_join(left, "\n\n").alias("text"))
