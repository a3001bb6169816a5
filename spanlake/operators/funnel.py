"""The corpus funnel: conditional counts and shares over filings and deals, and the gate they must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.sources.hits import is_agreement_exhibit

# What the corpus must reach.
GATE_AGREEMENTS = 100
GATE_FAMILY_SHARE = 0.5


def rate(a, b):
    return F.round(F.try_divide(a, F.nullif(b, F.lit(0))), 4)


def filing_funnel(filings: DataFrame) -> DataFrame:
    """One row of counts. `filings`: file_type, missing, amendment, company, key_ok, not_merger."""
    return filings.agg(
        F.count(F.lit(1)).alias("search_docs"),
        F.count_if(is_agreement_exhibit(F.col("file_type"))).alias("ex21_docs"),
        F.count_if(F.upper(F.trim("file_type")) == "EX-2").alias("ex2_bare_docs"),
        F.count_if("missing").alias("missing"),
        F.count_if(~F.col("missing")).alias("fetched"),
        F.count_if(~F.col("missing") & F.col("not_merger")).alias("not_merger"),
        F.count_if(~F.col("missing") & F.col("key_ok")).alias("keyed"),
        F.count_if(~F.col("missing") & F.col("company").isNotNull()).alias("company_parsed"),
        F.count_if(~F.col("missing") & F.col("amendment")).alias("amendment_docs"),
        rate(F.count_if(~F.col("missing") & F.col("company").isNotNull()), F.count_if(~F.col("missing"))).alias(
            "company_parsed_rate"
        ),
    )


def deal_funnel(deals: DataFrame, start: str) -> DataFrame:
    """One row of counts and rates over deals, as `group_deals` returns them."""
    gate = F.col("tech") & (F.col("signed") >= start)
    return deals.agg(
        F.count(F.lit(1)).alias("deals"),
        F.count_if("orphan_restated").alias("orphan_restated"),
        F.count("target_cik").alias("deals_resolved"),
        F.count_if(gate).alias("tech_deals"),
        F.count_distinct(F.when(gate, F.col("target_cik"))).alias("tech_targets"),
        F.count_if(gate & (F.col("copies") > 1)).alias("tech_multi_copy"),
        F.count_if(gate & (F.col("amendments") > 0)).alias("tech_amended"),
        rate(F.count("target_cik"), F.count(F.lit(1))).alias("target_resolved_rate"),
        rate(F.count_if(gate & (F.col("copies") > 1)), F.count_if(gate)).alias("duplicate_rate"),
        rate(F.count_if(gate & (F.col("amendments") > 0)), F.count_if(gate)).alias("amendment_rate"),
    )


def family_shares(sample: DataFrame) -> DataFrame:
    """(family, present, n, share) over sampled rows of (family, present)."""
    return sample.groupBy("family").agg(
        F.count_if("present").alias("present"), F.count(F.lit(1)).alias("n"),
        rate(F.count_if("present"), F.count(F.lit(1))).alias("share"),
    )


def gate_verdict(shares: DataFrame, deals: DataFrame) -> DataFrame:
    """Whether there are enough deals and every family is common enough. `deals` is a deal funnel row."""
    tech = deals.select("tech_deals").scalar()
    return shares.agg(
        (F.max(tech) >= GATE_AGREEMENTS).alias("count_ok"),
        F.coalesce(F.every(F.col("present") / F.col("n") >= GATE_FAMILY_SHARE), F.lit(False)).alias("families_ok"),
    ).withColumn("gate_pass", F.col("count_ok") & F.col("families_ok"))
