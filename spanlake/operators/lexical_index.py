"""A stored inverted index: postings in blocks of passages with each block's largest gain, and top-k search that skips blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from spanlake.functions.text import index_tokens, query_tokens
from spanlake.operators.search import B, K1, SCORE_DIGITS, idf, top_k
from spanlake.session import cut_lineage, shared_folder

FORMAT = 4  # of the stored tables
BLOCK_BITS = 7  # passages of a block: 128
SHARD_BITS = 6  # blocks of a shard: 64
GROUP_BITS = 3  # blocks of a group in a scoped search: 8
FIRST_BLOCKS = 8  # blocks of a query that are read before its threshold is known
SLACK = 1e-9  # of a bound, and as much again: more than rounding takes from a score, so a bound never falls below one


@dataclass(frozen=True)
class LexicalIndex:
    """Tables of one folder. `postings(term, block, top, posts)`: a block's passages that hold the term, and the largest gain among them;
    `terms(term, df)`; `scopes(scope, block)`: where a scope's passages lie; `corpus(n, avgdl)`, written last."""

    spark: SparkSession
    path: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def postings(self) -> DataFrame:
        return self._table("postings")

    @property
    def terms(self) -> DataFrame:
        return self._table("terms")

    @property
    def scopes(self) -> DataFrame:
        return self._table("scopes")

    @property
    def corpus(self) -> DataFrame:
        return self._table("corpus")


def _stemmed(rows: DataFrame, stem: DataFrame | None) -> DataFrame:
    return rows if stem is None else rows.join(stem, "term", "left").withColumn("term", F.coalesce("stem", "term")).drop("stem")


def _restemmed(rows: DataFrame, stem: DataFrame | None) -> DataFrame:
    """`rows(passage_id, scope, tokens, dl)` with each token replaced by its stem."""
    if stem is None:
        return rows
    kept = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    stems = _stemmed(kept.select("row", F.explode("tokens").alias("term")), stem).groupBy("row").agg(F.collect_list("term").alias("stems"))
    return kept.join(stems, "row", "left").select("passage_id", "scope", "dl", F.coalesce("stems", F.array().cast("array<string>")).alias("tokens"))


def _changes(column: pa.Array) -> np.ndarray:
    """Where a column differs from the row before; nulls are equal."""
    before, after = column[:-1], column[1:]
    differ = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], differ | (before.is_null().to_numpy(zero_copy_only=False) != after.is_null().to_numpy(zero_copy_only=False))])


def _block_postings(rows: pa.Table, avgdl: float, schema: pa.Schema) -> pa.RecordBatch:
    """The postings of whole blocks; `rows(passage_id, scope, dl, tokens, block)` are sorted so that repeated passages of a block are neighbours."""
    column = {c: rows.column(c).combine_chunks() for c in rows.column_names}
    blocks = column["block"].to_numpy()
    passage = np.cumsum(_changes(column["passage_id"]) | _changes(column["scope"]) | _changes(column["dl"]) | _changes(column["block"])) - 1
    first = np.flatnonzero(np.diff(passage, prepend=-1))
    tokens = pc.split_pattern(column["tokens"], "\n")
    words = tokens.flatten().dictionary_encode()
    of = np.repeat(passage, pc.list_value_length(tokens).to_numpy())
    known, local = np.unique(blocks, return_inverse=True)
    held = (local[first][of] * len(words.dictionary) + words.indices.to_numpy()) * len(first) + of
    held, tf = np.unique(held, return_counts=True)
    list_of, at = np.divmod(held, len(first))
    starts = np.flatnonzero(np.diff(list_of, prepend=-1))
    at = first[at]
    dl = column["dl"].to_numpy()[at]
    gain = (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))
    block, term = np.divmod(list_of[starts], max(len(words.dictionary), 1))
    place = pa.array(at)
    posts = pa.StructArray.from_arrays([column["passage_id"].take(place), column["scope"].take(place), pa.array(tf, pa.int64()), pa.array(dl, pa.int64())], fields=list(schema.field("posts").type.value_type))
    listed = pa.ListArray.from_arrays(pa.array(np.append(starts, len(held)), pa.int32()), posts, type=schema.field("posts").type)
    tops = np.maximum.reduceat(gain, starts) if len(starts) else gain
    return pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(term)), pa.array(known[block]), pa.array(tops), listed], schema=schema)


def build_index(passages: DataFrame, path: str | None = None, scope: str | None = None, body: str = "body", stem: DataFrame | None = None) -> LexicalIndex:
    """Index `passages(passage_id, scope, body)` into a folder (by default a new one in the shared folder).

    Texts are tokenised once, in passage order; a block is 128 passages that follow each other in one sorted partition, so a document's passages share few
    blocks; repeated passages are one, as in `postings`. A block lies in one task, which makes its postings there: only the tokens are shuffled, once, and no row for each word of a passage is. A term
    that every passage holds is many rows of at most 128 passages, never one list.
    """
    spark = passages.sparkSession
    path = path or f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scoped = F.col(scope) if scope else F.lit(None).cast("long")
    tokens = passages.select("passage_id", scoped.alias("scope"), index_tokens(F.col(body)).alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))
    tokenised = cut_lineage(_restemmed(tokens, stem).withColumn("tokens", F.array_join("tokens", "\n")))  # one string takes a third of a list's bytes
    sizes = cut_lineage(tokenised.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))
    order = ("passage_id", "scope", "dl")
    ordered = tokenised.repartitionByRange(parts, "passage_id").sortWithinPartitions(*order).where("dl > 0")
    placed = ordered.select(*order, "tokens", F.monotonically_increasing_id().alias("block"))
    bits = BLOCK_BITS
    avgdl = sizes.first()["avgdl"]
    post = T.StructType([T.StructField("passage_id", placed.schema["passage_id"].dataType), T.StructField("scope", placed.schema["scope"].dataType), *T.StructType.fromDDL("tf long, dl long").fields])
    schema = T.StructType([*T.StructType.fromDDL("term string, block long, top double").fields, T.StructField("posts", T.ArrayType(post))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        last, place = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _changes(batch.column(0)) | _changes(batch.column(1)) | _changes(batch.column(2))
            if last is None:
                place = batch.column(4)[0].as_py() - 1  # places of two tasks never meet
            else:
                new[0] = [c[0].as_py() for c in batch.columns[:3]] != last
            places = place + np.cumsum(new)
            last, place, blocks = [c[-1].as_py() for c in batch.columns[:3]], places[-1], places >> bits
            batch = batch.set_column(4, "block", pa.array(blocks))
            cut = int(np.searchsorted(blocks, blocks[-1]))  # a batch's last block may go on in the next
            if waiting and (cut or waiting[-1].column(4)[-1].as_py() != blocks[0]):
                yield _block_postings(pa.Table.from_batches([*waiting, batch.slice(0, cut)]), avgdl, arrow)
                waiting = []
            elif cut:
                yield _block_postings(pa.Table.from_batches([batch.slice(0, cut)]), avgdl, arrow)
            waiting.append(batch.slice(cut))
        if waiting:
            yield _block_postings(pa.Table.from_batches(waiting), avgdl, arrow)

    placed.mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{path}/postings")
    index = LexicalIndex(spark, path)
    index.postings.groupBy("term").agg(F.sum(F.size("posts")).alias("df")).write.parquet(f"{path}/terms")
    index.postings.select(F.explode(F.array_distinct("posts.scope")).alias("scope"), "block").distinct().write.parquet(f"{path}/scopes")
    sizes.write.parquet(f"{path}/corpus")
    return index


def stored_index(passages: DataFrame, source: DataFrame, name: str, **how) -> LexicalIndex:
    """The index of `passages`, built only if no index of the same name and source files (path, size, time of change) is stored.

    The name's entry, one row with the index's folder, is written after all tables, so a half-built index is never found.
    """
    spark = passages.sparkSession
    seen = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = seen.agg(F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "file_path", "file_size", F.unix_micros("file_modification_time")))), "\n"))).first()[0]
    pointer = f"{shared_folder(spark)}/lexical-{name}-{FORMAT}-{BLOCK_BITS}-{state}"
    try:
        index = LexicalIndex(spark, spark.read.parquet(pointer).first()["path"])
        index.corpus.schema  # noqa: B018
        return index
    except AnalysisException:  # none is stored, or it was cleaned away
        index = build_index(passages, **how)
        spark.createDataFrame([(index.path,)], "path string").write.mode("overwrite").parquet(pointer)
        return index


def _asked(index: LexicalIndex, queries: DataFrame, keep: list[str], query_text: str, stem: DataFrame | None) -> DataFrame:
    terms = _stemmed(queries.select("query_id", *keep, F.explode(query_tokens(F.col(query_text))).alias("term")), stem).distinct()
    n = index.corpus.select("n").scalar()
    return cut_lineage(terms.join(index.terms, "term").select("query_id", *keep, "term", idf(n, F.col("df")).alias("idf")))


def _listed(index: LexicalIndex, queries: DataFrame, scope: str, query_text: str, stem: DataFrame | None) -> DataFrame:
    """`(query_id, asked_scope, words)`: every query's terms that the index holds, each once, with their idf, as one list."""
    words = _stemmed(queries.select("query_id", F.col(scope).alias("asked_scope"), F.explode(query_tokens(F.col(query_text))).alias("term")), stem)
    n = index.corpus.select("n").scalar()
    known = cut_lineage(words.select("term").distinct().join(index.terms, "term").select("term", idf(n, F.col("df")).alias("idf")))
    return words.join(known, "term").groupBy("query_id", "asked_scope").agg(F.collect_set(F.struct("term", "idf")).alias("words"))


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value of a column, null too, and the values."""
    found = column.dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def _packed(index: LexicalIndex, blocks: DataFrame) -> DataFrame:
    """The postings of the given blocks, a row for each run of a block's terms as they are stored: its passages once, and of each posting the place of its
    passage there and the count."""
    held = index.postings.join(blocks, "block", "left_semi").select("term", "block", "posts")
    post = held.schema["posts"].dataType.elementType
    lists = [T.StructField(name, T.ArrayType(post[c].dataType)) for name, c in (("ids", "passage_id"), ("scopes", "scope"), ("dls", "dl"))]
    schema = T.StructType([*T.StructType.fromDDL("group long, terms array<string>, sizes array<int>, places binary, tfs binary").fields, *lists])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block, posts = batch.column(1).to_numpy(), batch.column(2)
            sizes, values = pc.list_value_length(posts).to_numpy().astype(np.int32), posts.flatten()
            first = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
            cuts = np.append(first, len(block))
            own = np.repeat(np.cumsum(np.isin(np.arange(len(block)), first)) - 1, sizes)
            ends = np.concatenate([[0], np.cumsum(sizes)])[cuts]
            passage = own
            for c in ("passage_id", "scope", "dl"):  # step by step, so that numbers stay small
                code, known = _codes(values.field(c))
                _, at, passage = np.unique(passage * len(known) + code, return_index=True, return_inverse=True)
            starts = np.searchsorted(own[at], np.arange(len(first) + 1))
            places = (passage - starts[own]).astype(np.uint16)
            tf = values.field("tf").to_numpy().astype(np.uint32)
            parts = list(zip(ends[:-1], ends[1:], strict=True))
            listed = lambda offsets, x: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x)
            columns = [
                pa.array(block[first] >> GROUP_BITS), listed(cuts, batch.column(0)), listed(cuts, pa.array(sizes)),
                pa.array([places[x:y].tobytes() for x, y in parts], pa.binary()), pa.array([tf[x:y].tobytes() for x, y in parts], pa.binary()),
                *(listed(starts, values.field(c).take(pa.array(at))) for c in ("passage_id", "scope", "dl")),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return held.mapInArrow(run, schema)


class _Group:
    """The postings of a group of blocks by term and scope, and what queries score there."""

    def __init__(self, rows: pa.Table, avgdl: float):
        flat = lambda name: rows.column(name).combine_chunks().flatten()
        passages = pc.list_value_length(rows.column("ids")).to_numpy()
        offset = np.concatenate([[0], np.cumsum(passages)])[:-1]
        places = [np.frombuffer(x, np.uint16) for x in rows.column("places").to_pylist()]
        at = np.concatenate([x.astype(np.int64) + o for x, o in zip(places, offset, strict=True)])
        tf = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("tfs").to_pylist()]).astype(float)
        self.place, self.ids = _codes(flat("ids"))
        scope, self.scopes = _codes(flat("scopes"))
        term, self.terms = _codes(flat("terms"))
        dl = flat("dls").to_numpy()[at]
        key = np.repeat(term, flat("sizes").to_numpy()) * len(self.scopes) + scope[at]
        order = np.argsort(key, kind="stable")
        self.key, self.place = key[order], self.place[at][order]
        self.gain = ((tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl)))[order]
        ends = pc.min_max(self.ids)
        self.edge = pc.fill_null(pc.is_in(self.ids, pa.array([ends["min"].as_py(), ends["max"].as_py()], self.ids.type)), True).to_numpy(zero_copy_only=False)

    def best(self, queries: pa.RecordBatch, k: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Of every query the k best passages of its scope, ties too, and those with the group's first and last id, which may go on in the next group."""
        words = queries.column("words")
        scope = pc.fill_null(pc.index_in(queries.column("asked_scope"), value_set=self.scopes, skip_nulls=True), -1).to_numpy()
        term = pc.fill_null(pc.index_in(words.flatten().field("term"), value_set=self.terms), -1).to_numpy().astype(np.int64)
        weight = words.flatten().field("idf").to_numpy()
        query = np.repeat(np.arange(queries.num_rows), pc.list_value_length(words).to_numpy())
        known = (term >= 0) & (scope[query] >= 0)
        term, weight, query = term[known], weight[known], query[known]
        asked = term * len(self.scopes) + scope[query]
        low, high = np.searchsorted(self.key, asked, "left"), np.searchsorted(self.key, asked, "right")
        many = high - low
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        cell, inverse = np.unique(np.repeat(query, many) * len(self.ids) + self.place[at], return_inverse=True)
        score = np.bincount(inverse, np.repeat(weight, many) * self.gain[at], len(cell))
        query, place = np.divmod(cell, len(self.ids))
        ranked = np.round(score, SCORE_DIGITS)
        order = np.lexsort((-ranked, query))
        query, place, score, ranked = query[order], place[order], score[order], ranked[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        least = np.full(queries.num_rows, -np.inf)
        least[query[rank == k - 1]] = ranked[rank == k - 1]
        kept = (ranked >= least[query]) | self.edge[place]
        return queries.column("query_id").take(pa.array(query[kept])), self.ids.take(pa.array(place[kept])), score[kept]


def _scoped_best(index: LexicalIndex, asked: DataFrame, k: int) -> DataFrame:
    """`(query_id, passage_id, score)`: the best passages of every query of `_listed` inside its scope, k or a few more from each group of blocks.

    A group is 8 blocks that follow each other. Its postings are packed where they are read and come first in their task, the queries of its scopes after
    them, a batch at a time; so a term's row is never sent alone, a query is one row for each group that its scope lies in, and a scope that many ask takes no memory.
    """
    asked = cut_lineage(asked)
    group = F.shiftright("block", GROUP_BITS).alias("group")
    places = index.scopes.join(asked.select(F.col("asked_scope").alias("scope")).distinct(), "scope")
    blocks = cut_lineage(places.select("block").distinct())
    sent = asked.join(index.scopes.select(F.col("scope").alias("asked_scope"), group).distinct(), "asked_scope")
    rows = _packed(index, blocks).withColumn("kind", F.lit(0)).unionByName(sent.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    avgdl = index.corpus.first()["avgdl"]
    ids = index.postings.schema["posts"].dataType.elementType["passage_id"].dataType
    schema = T.StructType([asked.schema["query_id"], T.StructField("passage_id", ids), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting, held = None, [], None
        for batch in batches:
            number, kind = batch.column("group").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.diff(number, prepend=number[:1] - 1) | np.diff(kind, prepend=kind[:1] - 1))
            for start, end in zip(cuts, [*cuts[1:], len(number)], strict=True):
                if number[start] != last:
                    last, waiting, held = number[start], [], None
                part = batch.slice(start, end - start)
                if kind[start] == 0:
                    waiting.append(part)
                    continue
                if waiting:
                    held, waiting = _Group(pa.Table.from_batches(waiting), avgdl), []
                if held is not None:
                    query, passage, score = held.best(part, k)
                    yield pa.RecordBatch.from_arrays([query, passage.cast(arrow.field(1).type), pa.array(score)], schema=arrow)

    found = rows.repartition("group").sortWithinPartitions("group", "kind").mapInArrow(visit, schema)
    return found.groupBy("query_id", "passage_id").agg(F.round(F.sum("score"), SCORE_DIGITS).alias("score"))


def _best_of_blocks(index: LexicalIndex, pairs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best passages of each shard for `pairs(query_id, block)`: `(query_id, passage_id, score)`.

    A shard is 64 blocks that follow each other, at most 8,192 passages. A query visits the shards in which it has a block with its list of blocks, and
    the sums are made there, so what leaves a task is k rows a query, not a row for every passage that holds a word of it. Blocks that no query visits
    are not sent.
    """
    shard = F.shiftright("block", SHARD_BITS).alias("shard")
    terms = asked.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("idf").alias("idfs"))
    wanted = pairs.groupBy("query_id", shard).agg(F.collect_list("block").alias("blocks")).join(terms, "query_id")
    read = cut_lineage(pairs.select("block").distinct())
    held = index.postings.join(read, "block", "left_semi").join(asked.select("term").distinct(), "term", "left_semi").select(shard, "term", "block", F.col("posts.passage_id").alias("ids"), F.col("posts.tf").alias("tf"), F.col("posts.dl").alias("dl"))
    avgdl = index.corpus.first()["avgdl"]

    def visit(posts: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy()
        ids, tf, dl = flat(posts, "ids"), flat(posts, "tf").astype(float), flat(posts, "dl")
        gains = (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))
        sizes = np.array([len(x) for x in posts.column("ids")], dtype=np.int64)
        passages, at = np.unique(ids, return_inverse=True)
        block_of = np.empty(len(passages), dtype=np.int64)
        block_of[at] = np.repeat(posts.column("block").to_numpy(), sizes)
        ends = np.cumsum(sizes)
        lists: dict[str, list] = {}
        for term, start, end in zip(posts.column("term").to_pylist(), ends - sizes, ends, strict=True):
            lists.setdefault(term, []).append((at[start:end], gains[start:end]))
        lists = {t: (np.concatenate([x for x, _ in v]), np.concatenate([x for _, x in v])) for t, v in lists.items()}
        for row in queries.to_pylist():
            sums = np.zeros(len(passages))
            for term, weight in zip(row["terms"], row["idfs"], strict=True):
                if term in lists:
                    places, gain = lists[term]
                    sums[places] += weight * gain
            some = np.flatnonzero((sums > 0) & np.isin(block_of, row["blocks"]))
            scores = np.round(sums[some], SCORE_DIGITS)
            if len(some) > k:
                least = np.partition(scores, len(some) - k)[len(some) - k]
                some, scores = some[scores >= least], scores[scores >= least]
            for x in np.lexsort((passages[some], -scores))[:k]:
                out.append((row["query_id"], int(passages[some[x]]), float(scores[x])))
        query, passage, score = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(query, query_type), pa.array(passage, pa.int64()), pa.array(score, pa.float64())], ["query_id", "passage_id", "score"])

    query_type = to_arrow_type(asked.schema["query_id"].dataType)
    schema = T.StructType([asked.schema["query_id"], T.StructField("passage_id", T.LongType()), T.StructField("score", T.DoubleType())])
    return held.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(visit, schema)


@dataclass(frozen=True)
class Passes:
    """The blocks of each query: all that hold a term of it with their bounds, those read first with their best passages, and those read after."""

    bounds: DataFrame
    first: DataFrame
    scored: DataFrame
    second: DataFrame


def passes(index: LexicalIndex, asked: DataFrame, k: int) -> Passes:
    """Block-max search. A block's bound is the sum of its terms' largest gains. The few blocks of largest bound are scored, their k-th score is the
    query's threshold, and of the other blocks only those whose bound reaches it are read. Both choices are rows, nothing is gathered."""
    tops = index.postings.select("term", "block", "top")
    bounds = cut_lineage(asked.join(tops, "term").groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("top")).alias("bound")))
    first = cut_lineage(top_k(bounds, ["query_id"], max(FIRST_BLOCKS, k >> 3), [F.desc("bound"), F.asc("block")]).select("query_id", "block"))
    scored = cut_lineage(_best_of_blocks(index, first, asked, k))
    kth = top_k(scored, ["query_id"], k).where(F.col("rank") == k).select("query_id", F.col("score").alias("threshold"))
    rest = bounds.join(first, ["query_id", "block"], "left_anti").join(kth, "query_id", "left")
    reaches = F.col("threshold").isNull() | (F.col("bound") * (1 + SLACK) + SLACK >= F.col("threshold"))
    return Passes(bounds, first, scored, cut_lineage(rest.where(reaches).select("query_id", "block")))


def search_index(index: LexicalIndex, queries: DataFrame, k: int = 10, scope: str | None = None, query_text: str = "text", stem: DataFrame | None = None) -> DataFrame:
    """`(query_id, rank, passage_id, score)`: the k best passages of every query, any query token matching.

    With `scope`, a query reads only the blocks where passages of its own scope lie; the statistics stay those of the whole corpus.
    """
    if scope:
        found = _scoped_best(index, _listed(index, queries, scope, query_text, stem), k)
        return top_k(found, ["query_id"], k).select("query_id", "rank", "passage_id", "score")
    asked = _asked(index, queries, [], query_text, stem)
    p = passes(index, asked, k)
    return top_k(p.scored.unionByName(_best_of_blocks(index, p.second, asked, k)), ["query_id"], k).select("query_id", "rank", "passage_id", "score")


def bm25(queries: DataFrame, passages: DataFrame, k: int = 10, scope: str | None = None, query_text: str = "text", body: str = "body", stem: DataFrame | None = None) -> DataFrame:
    """The k best passages for every (query_id, text) over an index made for this call."""
    return search_index(build_index(passages, scope=scope, body=body, stem=stem), queries, k, scope, query_text, stem)
