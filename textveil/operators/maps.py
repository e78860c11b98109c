"""Pseudonym maps: one row for each original of a run."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.config import Config
from textveil.functions.text import pseudonym


def pseudonym_map(found: DataFrame, config: Config | None = None, *keys: str, keep_empty: bool = False) -> DataFrame:
    """``(*keys, original, pseudonym)`` of the distinct values of ``found(*keys, value)``.

    Null values have no row, empty ones only with ``keep_empty``. Pseudonyms follow from the value, so
    which of equal values came first doesn't matter.
    """
    config = config or Config()
    kept = found.where(F.col("value").isNotNull() if keep_empty else F.col("value") != "")
    return kept.select(*keys, F.col("value").alias("original")).distinct().withColumn("pseudonym", pseudonym(F.col("original"), config))


def own_values(found: Column) -> Column:
    """The distinct non-empty values of a row's detections: its map's originals."""
    return F.array_distinct(F.filter(F.transform(found, lambda d: d["value"]), lambda v: v != ""))


def own_reversed(originals: Column, pseudonyms: Column) -> Column:
    """The map from pseudonyms to originals of one row; of originals that share a pseudonym the last one stays."""
    n, backward = F.size(pseudonyms), F.reverse(pseudonyms)
    entries = F.transform(originals, lambda o, i: F.struct(F.get(pseudonyms, i).alias("key"), o.alias("value"), i.alias("i")))
    last = F.filter(entries, lambda e: F.array_position(backward, e["key"]) == n - e["i"])
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def pseudonymize_values(values: DataFrame, column: str, config: Config | None = None) -> DataFrame:
    """``(original, pseudonym)`` of a column's distinct values, without null and empty ones."""
    return pseudonym_map(values.select(F.col(column).alias("value")), config)


def save_map(rows: DataFrame, path: str) -> None:
    """Maps hold originals in clear: keep ``path`` apart from reports, and protected."""
    rows.write.mode("overwrite").partitionBy("run_id").option("partitionOverwriteMode", "dynamic").parquet(path)


def load_map(spark, path: str, run_id: str) -> DataFrame:
    """A run's rows, read from its partition alone; none for a run without a map, nor where no map was ever stored."""
    schema = "original string, pseudonym string, run_id string"
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    return rows.where(F.col("run_id") == run_id).select("run_id", "original", "pseudonym")
