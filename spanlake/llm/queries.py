"""The registered queries that SQL cannot express: tests hold them against brute force, round trips and held-out rows."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm import embedding_dedup, hash_forest, html_extract, language_id, packing, secret_scan, simhash, token_planes
from spanlake.llm.registry import register
from spanlake.session import shared_folder


@register("op1_language_id", "documents")
def op1(documents: DataFrame) -> DataFrame:
    """Language of every document, learned from two of three parts of the labelled ones."""
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 3 == 1, F.lit(False))
    found = language_id.predict(documents, language_id.fit(documents.where(~held("doc_id"))))
    return found.select(F.col("id").alias("doc_id"), held("id").alias("held_out"), "lang_pred", "score")


@register("op8_simhash", "documents")
def op8(documents: DataFrame) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(documents, width=3, max_bits=2)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register("op5_token_planes", "documents")
def op5(documents: DataFrame) -> DataFrame:
    """Ids of every document, written as byte planes and digested from the files."""
    spark = documents.sparkSession
    path = f"{shared_folder(spark)}/token-planes-{uuid.uuid4().hex}"
    token_planes.write(documents, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_planes.digests(spark, path)


@register("op7_packing", "documents")
def op7(documents: DataFrame) -> DataFrame:
    """Every document's ids in sequences of 1,024."""
    packed = packing.pack(documents, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=1024)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register("op9_html_extract", "pages")
def op9(pages: DataFrame) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


@register("op3_embedding_dedup", "embeddings")
def op3(embeddings: DataFrame) -> DataFrame:
    """Near-duplicate vectors of one label."""
    found = embedding_dedup.near_duplicates(embeddings, least=0.98)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component_id").cast("long").alias("component_id"), F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


@register("op2_hash_forest", "embeddings")
def op2(embeddings: DataFrame) -> DataFrame:
    """The 20 nearest vectors of every twentieth one, among all others."""
    return hash_forest.search(embeddings, embeddings.where("vec_id % 20 = 0"), k=20)


@register("op13_secret_scan", "documents")
def op13(documents: DataFrame) -> DataFrame:
    """Secrets of every document: how many of each base kind, and where all of them stand."""
    written = F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    base = F.filter(written, lambda x: ~x.startswith(f"{secret_scan.NOVEL}:"))
    counts = [F.expr(f"CAST(size(filter(spans, x -> x.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}") for kind in secret_scan.KINDS]
    return secret_scan.scan(documents).select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(written, ",").alias("spans"))
