"""Append-only ledgers: latest record per key, pending work, shared calls, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A failure that starts with the first marker is retried unless it starts with one of the others.
TRANSIENT = "runner:"
PERMANENT = ("runner: truncated", "runner: refusal")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; a torn line is dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parse_jsonl(lines: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """As `read_jsonl`, over a column of lines; other columns are kept."""
    parsed = lines.withColumn("_rec", F.try_parse_json(line))
    good = parsed.where(F.col("_rec").isNotNull())
    keep = [c for c in lines.columns if c != line]
    return good.select(*keep, F.from_json(line, schema).alias("rec")).select(*keep, "rec.*")


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def latest_per_key(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The record written last for each key. `max_by` combines map-side, so a hot key costs one row per task."""
    values = [c for c in records.columns if c not in keys]
    picked = records.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    )
    return picked.select(*keys, "_last.*").select(*records.columns)


def is_done(error: Column) -> Column:
    """A finished record: no transient failure."""
    err = F.coalesce(error, F.lit(""))
    permanent = F.lit(False)
    for p in PERMANENT:
        permanent = permanent | err.startswith(p)
    return ~err.startswith(TRANSIENT) | permanent


def pending(items: DataFrame, records: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """Items with no finished record under the same key."""
    done = records.where(is_done(F.col(error))).select(*keys).distinct()
    return items.join(done, keys, "left_anti")


def shared_calls(jobs: DataFrame, call_key: str, result_key: str) -> DataFrame:
    """One call per distinct call key, with how many results share it."""
    return jobs.groupBy(call_key).agg(
        F.count(F.lit(1)).alias("n_results"), F.min(result_key).alias("first_result")
    )


def row_digest(key: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", key.cast("string"), F.sha2(text, 256)), 256)


def table_fingerprint(rows: DataFrame, key: str, text: str, name: str, rows_per_digest: int = 4096) -> DataFrame:
    """A digest of a keyed table that does not depend on row order.

    Row digests are folded in a tree: first per prefix, as long as it takes for one to hold about `rows_per_digest`
    rows (four hex digits at least, two more for every 256 times the rows), then per prefix of two digits less, so no task
    holds more than one prefix's digests whatever the size of the table.
    """
    width, n = 4, rows.count()
    while n > rows_per_digest * 16**width:
        width += 2
    level = rows.select(row_digest(F.col(key), F.col(text)).alias("d"), F.lit(1).cast("long").alias("n"))
    level = level.withColumn("p", F.substring("d", 1, width))
    for digits in range(width - 2, -1, -2):
        folded = level.groupBy("p").agg(
            F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("d"), F.sum("n").alias("n")
        )
        level = folded.withColumn("p", F.substring("p", 1, digits))
    return level.groupBy("p").agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("fingerprint"),
        F.sum("n").alias("n_rows"),
    ).select(F.lit(name).alias("table_name"), "fingerprint", "n_rows")
