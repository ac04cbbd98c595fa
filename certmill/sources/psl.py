"""Public Suffix List text to a rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from certmill.schemas import UNKNOWN

# The markers that open the two sections of the list.
ICANN_MARKER = "===BEGIN ICANN DOMAINS==="
PRIVATE_MARKER = "===BEGIN PRIVATE DOMAINS==="


def parse_psl(files: DataFrame) -> DataFrame:
    """``rule``, ``section`` and ``kind`` from rows of (``path``, ``value``), one row per list file.

    The section of a line is that of the last marker above it. Lists are read
    in path order; of equal rules the last one counts. ``kind`` is ``plain``,
    ``wildcard`` or ``exception``; the rule text of an exception has no ``!``.
    """
    lines = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    marker = F.when(F.contains(F.col("line"), F.lit(ICANN_MARKER)), F.lit("icann")).when(
        F.contains(F.col("line"), F.lit(PRIVATE_MARKER)), F.lit("private")
    )
    # A list is one file, so one window group is one file.
    above = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    text = F.trim("line")
    token = F.lower(F.regexp_replace(F.regexp_extract(text, "^(\\S+)", 1), "^\\.+", ""))
    marked = (
        lines.withColumn("_m", marker)
        .withColumn("section", F.coalesce(F.last("_m", ignorenulls=True).over(above), F.lit(UNKNOWN)))
        .where((text != "") & F.col("_m").isNull() & ~F.startswith(text, F.lit("//")))
        .withColumn("_token", token)
    )
    kinds = (
        F.when(F.startswith(F.col("_token"), F.lit("!")), F.lit("exception"))
        .when(F.startswith(F.col("_token"), F.lit("*.")), F.lit("wildcard"))
        .otherwise(F.lit("plain"))
    )
    rules = marked.withColumn("kind", kinds).withColumn(
        "rule", F.regexp_replace("_token", "^!", "")
    )
    return (
        rules.where(F.col("rule") != "")
        .groupBy("rule")
        .agg(F.max_by(F.struct("section", "kind"), F.struct("path", "pos")).alias("_r"))
        .select("rule", "_r.section", "_r.kind")
    )


def read_psl_rules(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), "value"
    )
    return parse_psl(files)
