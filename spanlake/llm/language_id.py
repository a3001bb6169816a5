"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
ORDERS = (1, 2, 3)
MULTIPLIERS = (2654435761, 2246822519, 3266489917)  # odd 32-bit constants, one per n-gram order
BACK = max(ORDERS) - 1


@dataclass(frozen=True)
class Model:
    """`weights[bucket, language]` are log probabilities; the last row, for positions that are no n-gram, is zero."""

    languages: list[str]
    priors: np.ndarray
    weights: np.ndarray
    bits: int


def letters_only(text: Column) -> Column:
    """Lower-cased letters and marks, every run of anything else one space; null for a text without a letter."""
    whole = F.lower(text.cast("string"))
    return F.when(whole.rlike(r"\p{L}"), F.regexp_replace(whole, r"[^\p{L}\p{M}]+", " "))


def _pieces(texts: list[str], most: int) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (row, piece) with about `most` characters each; a piece starts with the characters before it that its n-grams need."""
    rows, parts, held = [], [], 0
    for row, text in enumerate(texts):
        text = " " * BACK + text + " "
        for start in range(BACK, len(text), most):
            part = text[start - BACK : start + most]
            rows.append(row)
            parts.append(part)
            held += len(part)
            if held >= most:
                yield rows, parts
                rows, parts, held = [], [], 0
    if parts:
        yield rows, parts


def _buckets(parts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each order, the bucket of the n-gram that ends at each character; and where each part starts."""
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
    dead = (starts[:, None] + np.arange(BACK)).ravel()
    out = np.empty((len(ORDERS), len(codes)), dtype=np.int64)
    gram = np.zeros(len(codes), dtype=np.uint32)
    for k, order in enumerate(ORDERS):
        earlier = np.zeros(len(codes), dtype=np.uint32)
        earlier[order - 1 :] = codes[: len(codes) - order + 1]
        gram = gram * np.uint32(0x01000193) + earlier * np.uint32(2 * order + 1)
        mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(MULTIPLIERS[k])
        out[k] = mixed >> np.uint32(32 - bits)
    out[:, dead] = 1 << bits
    return out, starts


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = 16, rows_per_language: int = 20_000, id_col: str = "doc_id") -> Model:
    """Learn from the rows given. Counts come from at most about `rows_per_language` rows of each language.

    The bound is kept without sorting: a language with more rows keeps those whose hash of id and text falls below
    rows_per_language / rows, so null and repeated ids are sampled by their texts (equal rows together). Each task adds up a (language, bucket) table, Spark adds the tables, and what reaches the
    driver is one row of that table per language and used bucket: bits and the number of languages bound it, not
    the corpus. Rows with a null language or without a letter teach nothing. Equal rows count as often as they occur.
    """
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(0), np.zeros(((1 << bits) + 1, 0)), bits)
    over = {lang: rows_per_language / n for lang, n in sizes.items() if n > rows_per_language}
    if over:
        share = F.create_map(*[F.lit(x) for pair in sorted(over.items()) for x in pair])
        unit = F.shiftrightunsigned(F.xxhash64("id", "text"), 33).cast("double") / F.lit(float(1 << 31))
        labelled = labelled.where(unit < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(1.0)))
    size = (1 << bits) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in langs:
                seen[lang] = seen.get(lang, 0) + 1
                totals.setdefault(lang, np.zeros(size, dtype=np.int64))
            for rows, parts in _pieces(texts, 1 << 20):
                found, starts = _buckets(parts, bits)
                ends = np.append(starts[1:], found.shape[1])
                for row, a, b in zip(rows, starts, ends, strict=True):
                    if b - a > 4096:
                        totals[langs[row]] += np.bincount(found[:, a:b].ravel(), minlength=size)
                    else:
                        np.add.at(totals[langs[row]], found[:, a:b].ravel(), 1)
        for lang, counts in totals.items():
            used = np.flatnonzero(counts[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used) + [lang]), pa.array(np.append(used, -1)), pa.array(np.append(counts[used], seen[lang]))], ["lang", "bucket", "n"])

    taught = labelled.select("lang", letters_only(F.col("text")).alias("text")).where("text IS NOT NULL")
    rows = taught.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    at = {lang: k for k, lang in enumerate(languages)}
    counts, prior = np.zeros((size, len(languages))), np.zeros(len(languages))
    which = np.array([at[x] for x in rows.column("lang").to_pylist()], dtype=np.int64)
    bucket, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    head = bucket < 0
    prior[which[head]] = n[head]
    counts[bucket[~head], which[~head]] = n[~head]
    weights = np.log(counts + 0.5) - np.log(counts[:-1].sum(axis=0) + 0.5 * (size - 1))
    weights[-1] = 0
    return Model(languages, np.log(prior / prior.sum()) if len(prior) else prior, weights, bits)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(id, lang_pred, score)` per row: the most probable language of the whole text and its posterior probability.

    A text that is null or has no letter, and any text under a model that learned nothing, is `und` with score 0; equal
    posteriors go to the smaller language by code point. Texts of any length are scored in slices of bounded size.
    The model is one broadcast of languages x buckets.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        most = max(1 << 14, (1 << 21) // max(len(m.languages), 1))
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            sums = np.tile(m.priors, (len(texts), 1))
            if m.languages:
                for rows, parts in _pieces(texts, most):
                    found, starts = _buckets(parts, m.bits)
                    per_place = m.weights[found[0]]
                    for k in range(1, len(ORDERS)):
                        per_place += m.weights[found[k]]
                    np.add.at(sums, rows, np.add.reduceat(per_place, starts, axis=0))
                best = sums.argmax(axis=1)
                top = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            known = np.array([bool(x) for x in texts], dtype=bool) & bool(m.languages)
            langs = [m.languages[best[i]] if known[i] else UNKNOWN for i in range(len(texts))]
            scores = [float(top[i]) if known[i] else 0.0 for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), letters_only(F.col(text_col)).alias("text")).mapInArrow(score, schema)
