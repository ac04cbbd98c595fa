"""Rule files in JSON: a list of rules, or an object that holds one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from certmill.operators.rules import UNNAMED
from certmill.schemas import RULE_FILE


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """``pos``, ``name`` and ``filter`` by file name and place in the file; filters are Spark SQL text."""
    raw = spark.read.schema(RULE_FILE).option("multiLine", True).json(path)
    tagged = raw.withColumn("_file", F.col("_metadata.file_path")).withColumn("_id", F.monotonically_increasing_id())
    one = tagged.where(F.col("rules").isNull()).select(
        "_file", "_id", F.lit(0).alias("_i"), "name", "filter"
    )
    many = tagged.select("_file", "_id", F.posexplode("rules").alias("_i", "r")).select(
        "_file", "_id", "_i", "r.name", "r.filter"
    )
    return one.unionByName(many).select(
        F.struct("_file", "_id", "_i").alias("pos"),
        F.coalesce("name", F.lit(UNNAMED)).alias("name"),
        F.coalesce("filter", F.lit("true")).alias("filter"),
    )
