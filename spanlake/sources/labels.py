"""Label CSV scan, its cleaning rule and its census."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The pseudo contract of rare answers and the row kind that carries labels.
PSEUDO_CONTRACT = "<RARE_ANSWERS>"
MAIN_TYPE = "main"

LABEL_FIELDS = ("text", "question", "subquestion", "answer", "text_type", "category")

CSV_SCHEMA = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "data_type", "contract_name", "text", "answer", "label", "question", "subquestion", "text_type", "id",
            "category",
        )
    ]
)


def read_labels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every row of the label files, all columns as strings (an empty field is an empty string), quoted line breaks kept."""
    return (
        spark.read.schema(CSV_SCHEMA)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(paths)
        .na.fill("")
    )


def clean_labels(rows: DataFrame) -> DataFrame:
    """Main rows of real contracts, one per distinct content."""
    kept = rows.where((F.col("data_type") == MAIN_TYPE) & (F.col("contract_name") != PSEUDO_CONTRACT))
    return kept.select(F.col("contract_name").alias("contract_id"), *LABEL_FIELDS).distinct()


def label_census(rows: DataFrame) -> DataFrame:
    real = F.when(F.col("contract_name") != PSEUDO_CONTRACT, F.col("contract_name"))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(real).alias("contracts"),
        F.count_distinct("question").alias("questions"),
    )


def contract_names(rows: DataFrame) -> DataFrame:
    return (
        rows.where(F.col("contract_name") != PSEUDO_CONTRACT).select("contract_name").distinct().orderBy("contract_name")
    )
