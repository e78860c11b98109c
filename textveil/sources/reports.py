"""The store of reports: one Parquet table, partitioned by run; texts and JSON are columns of it."""

from __future__ import annotations

import json
import logging
import os

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textveil.sources.files import binary_files


def get_logger(name: str, log_file: str | None = None) -> logging.Logger:
    """A logger of the driver to the console and, if one is named, to a file; each of them once, however often it is asked for. Never log values."""
    logger = logging.getLogger(name)
    form = logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s")
    files = {h.baseFilename for h in logger.handlers if isinstance(h, logging.FileHandler)}
    more = [logging.StreamHandler()] if not logger.handlers else []
    if log_file and os.path.abspath(log_file) not in files:
        os.makedirs(os.path.dirname(os.path.abspath(log_file)), exist_ok=True)
        more.append(logging.FileHandler(log_file, encoding="utf-8"))
    for handler in more:
        handler.setFormatter(form)
        logger.addHandler(handler)
    logger.setLevel(logging.INFO)
    logger.propagate = False
    return logger


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(path, document)`` of JSON files below a path, as text; null for a file that is no JSON, and no rows for a path that isn't there."""
    try:
        files = binary_files(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, document string")
    return files.select("path", valid_json(F.col("content")).alias("document"))


@F.pandas_udf(StringType())
def valid_json(content: pd.Series) -> pd.Series:
    def checked(c) -> str | None:
        try:
            text = bytes(c).decode("utf-8")
            json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return None
        return text

    return content.map(checked)


def save_reports(reports: DataFrame, path: str) -> None:
    """Runs that failed at the model are not stored."""
    reports.where("ok").write.mode("overwrite").partitionBy("run_id").option("partitionOverwriteMode", "dynamic").parquet(path)


def load_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def as_json(reports: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, report)``: each report as a JSON document that spells out nulls."""
    return reports.select(*keys, F.to_json(F.struct(*reports.columns), {"ignoreNullFields": "false"}).alias("report"))


def listing(reports: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, status, pii_found)`` of stored reports, in order; a report without validation is UNKNOWN.

    Dealt out before it is sorted: sorting reads its input twice, and reports may be costly to make.
    """
    keys = keys or ("run_id",)
    status = F.coalesce("validation.overall_status", F.lit("UNKNOWN"))
    return reports.where("ok").select(*keys, status.alias("status"), F.greatest(F.size("detections"), F.lit(0)).cast("long").alias("pii_found")).repartition(*keys).orderBy(*keys)


def status_summary(reports: DataFrame) -> DataFrame:
    """``(passed, runs, pii_found)``: how a history of reports is coloured and counted."""
    return listing(reports).groupBy(F.contains("status", F.lit("PASS")).alias("passed")).agg(F.count("*").alias("runs"), F.sum("pii_found").alias("pii_found"))
