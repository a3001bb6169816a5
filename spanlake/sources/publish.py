"""Publishing serving tables: referential checks, skip when unchanged, links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_references(checks: list[tuple[str, DataFrame, DataFrame, str]]) -> DataFrame:
    """For each (name, referencing, referenced, key): distinct keys with no referenced row. All must be zero."""
    parts = []
    for name, referencing, referenced, key in checks:
        gone = referencing.select(key).distinct().join(referenced.select(key), key, "left_anti")
        parts.append(gone.agg(F.count(F.lit(1)).alias("missing")).select(F.lit(name).alias("check_name"), "missing"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def currency(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Which tables' fingerprints equal the manifest's. A table the manifest lacks is not current."""
    old = manifest.select("table_name", F.col("fingerprint").alias("_old"))
    return current.join(old, "table_name", "left").select(
        "table_name", "n_rows", F.coalesce(F.col("fingerprint") == F.col("_old"), F.lit(False)).alias("is_current")
    )


def publish(tables: dict[str, DataFrame], checks: DataFrame, current: DataFrame, manifest: DataFrame, root: str) -> bool:
    """Write the serving tables unless the manifest already matches; refuse when a reference is missing.

    The manifest is written last, so a job lost half way is rebuilt by the next run.
    """
    stale = currency(current, manifest).where(~F.col("is_current")).limit(1).count()
    if not stale:
        return False
    broken = checks.where("missing > 0").limit(1).collect()
    if broken:
        raise ValueError(f"{broken[0]['missing']} rows of {broken[0]['check_name']} have no referenced row")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    current.write.mode("overwrite").parquet(f"{root}/manifest")
    return True


def agreement_links(deals: DataFrame, amendments: DataFrame, mirror: str) -> DataFrame:
    """The filing link and the numbered amendment links of each agreement, listed by case-folded target name.

    `deals`: contract_id, source, target, url; `amendments`: contract_id, amendment_no, url. Links are first
    reduced per agreement, so the join brings one row per agreement.
    """
    filing = F.when(F.col("source") == "edgar", F.col("url")).otherwise(
        F.concat(F.lit(mirror + "/contracts/"), F.col("contract_id").cast("string"), F.lit(".txt"))
    )
    per_deal = amendments.where(F.col("url").isNotNull()).groupBy("contract_id").agg(
        F.sort_array(F.collect_list(F.struct("amendment_no", "url"))).alias("amendments")
    )
    listed = deals.select("contract_id", "target", filing.alias("filing")).join(per_deal, "contract_id", "left")
    return listed.select(
        "contract_id",
        "filing",
        F.map_from_entries("amendments").alias("amendments"),
        F.lower(F.coalesce("target", F.col("contract_id").cast("string"))).alias("sort_name"),
    ).orderBy("sort_name", "contract_id")
