"""What a reader or a model sees for each hit: definitions, amending text, links, and the rendered prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_K = 5


def hit_context(hits: DataFrame, passages: DataFrame, defs: DataFrame, amended: DataFrame, k: int = CONTEXT_K) -> DataFrame:
    """The first k hits of every query with ordered parts: passage, definitions by rank, amendments by date.

    `defs`: passage_id, rank, def_text; `amended`: passage_id, amendment_id, amendment_no, file_date, amend_text.
    Texts are joined for the shown hits only.
    """
    shown = hits.where(F.col("rank") <= k).select("query_id", "rank", "passage_id")
    ids = shown.select("passage_id").distinct()
    d = defs.join(ids, "passage_id", "left_semi").groupBy("passage_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "def_text"))).alias("defs")
    )
    a = amended.join(ids, "passage_id", "left_semi").groupBy("passage_id").agg(
        F.sort_array(F.collect_list(F.struct("file_date", "amendment_id", "amendment_no", "amend_text"))).alias("amendments")
    )
    body = passages.join(ids, "passage_id", "left_semi").select("passage_id", "body")
    out = shown.join(body, "passage_id").join(d, "passage_id", "left").join(a, "passage_id", "left")

    def part(kind: str, text: Column, no: Column = F.lit(None), filed: Column = F.lit(None)) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), text.alias("text"), no.cast("long").alias("amendment_no"),
            filed.cast("string").alias("file_date"),
        )

    body_part = F.array(part("passage", F.col("body")))
    def_parts = F.transform("defs", lambda x: part("definition", x["def_text"]))
    amend_parts = F.transform(
        "amendments", lambda x: part("amendment", x["amend_text"], x["amendment_no"], x["file_date"])
    )
    with_defs = F.when(F.col("defs").isNull(), body_part).otherwise(F.concat(body_part, def_parts))
    parts = F.when(F.col("amendments").isNull(), with_defs).otherwise(F.concat(with_defs, amend_parts))
    return out.select("query_id", "rank", "passage_id", parts.alias("parts"))


def shown_text(parts: Column) -> Column:
    """The context as one text: parts separated by blank lines, amendments under their heading."""
    return F.array_join(
        F.transform(
            parts,
            lambda p: F.when(
                p["kind"] == "amendment",
                F.concat(
                    F.lit("[Amended by Amendment No. "), p["amendment_no"].cast("string"), F.lit(", filed "),
                    p["file_date"], F.lit("]\n"), p["text"],
                ),
            ).otherwise(p["text"]),
        ),
        "\n\n",
    )


def touched_amendments(hits: DataFrame, amended: DataFrame, k: int = CONTEXT_K) -> DataFrame:
    """Amendments the first k hits touch, in the order first seen: (query_id, amendment_id, position)."""
    seen = hits.where(F.col("rank") <= k).join(amended, "passage_id")
    first = seen.groupBy("query_id", "amendment_id").agg(
        F.min(F.struct("rank", "file_date")).alias("_at")
    )
    listed = first.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_at", "amendment_id"))).alias("_l"))
    return listed.select("query_id", F.posexplode(F.col("_l.amendment_id")).alias("position", "amendment_id"))


def search_listing(hits: DataFrame, passages: DataFrame, defs: DataFrame, deals: DataFrame) -> DataFrame:
    """Hits with their deal, path, text, definition names, link and per-leg ranks.

    `deals`: contract_id, target, link; `passages`: passage_id, contract_id, section_path, body.
    """
    ids = hits.select("passage_id").distinct()
    terms = defs.join(ids, "passage_id", "left_semi").groupBy("passage_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("_t")
    )
    p = passages.join(ids, "passage_id", "left_semi").select("passage_id", "contract_id", "section_path", "body")
    return (
        hits.join(p, "passage_id")
        .join(terms, "passage_id", "left")
        .join(deals, "contract_id", "left")
        .withColumn("definitions", F.array_join(F.coalesce(F.col("_t.term"), F.array().cast("array<string>")), ", "))
        .drop("_t")
    )


def block_text(ref: Column, path: Column, parts: Column) -> Column:
    """One numbered block of a prompt: label and path, passage, definitions, amendments."""
    defs = F.filter(parts, lambda p: p["kind"] == "definition")
    amends = F.filter(parts, lambda p: p["kind"] == "amendment")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), ref, F.lit("] "), path),
        F.get(parts, F.lit(0))["text"],
        F.when(F.size(defs) > 0, F.lit("Definitions used:")),
        F.transform(defs, lambda p: p["text"]),
        F.transform(
            amends,
            lambda p: F.concat(
                F.lit("[Amended by Amendment No. "), p["amendment_no"].cast("string"), F.lit("]\n"), p["text"]
            ),
        ),
    )


def render_prompts(questions: DataFrame, blocks: DataFrame, template: str, choices_template: str) -> DataFrame:
    """The prompt of every question and its short hash.

    `questions`: query_id, question, choices (array, may be empty); `blocks`: query_id, rank, section_path, parts.
    The templates hold `{question}`, `{passages}`, `{choices}` and `{options}`.
    """
    b = blocks.select(
        "query_id",
        "rank",
        block_text(F.concat(F.lit("P"), F.col("rank").cast("string")), F.col("section_path"), F.col("parts")).alias("_b"),
    )
    listed = b.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "_b"))).alias("_l"))
    options = F.array_join(F.transform("choices", lambda c: F.concat(F.lit("- "), c)), "\n")
    opts = F.when(F.size("choices") > 0, F.replace(F.lit(choices_template), F.lit("{options}"), options)).otherwise("")
    head, rest = template.split("{question}")
    middle, rest = rest.split("{passages}")
    link, tail = rest.split("{choices}")
    prompt = F.concat(
        F.lit(head), F.trim("question"), F.lit(middle), F.array_join(F.col("_l._b"), "\n\n"), F.lit(link), opts, F.lit(tail)
    )
    out = questions.join(listed, "query_id").withColumn("prompt", prompt)
    return out.select("query_id", "prompt", F.substring(F.sha1("prompt"), 1, 12).alias("prompt_sha"))
