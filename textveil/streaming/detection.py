"""Detection and anonymization of a stream of texts.

Both are expressions over one row, so they need no state and no watermark: a streaming DataFrame takes
the same columns as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.config import Config
from textveil.operators.anonymize import anonymized
from textveil.operators.detect import with_detections


def anonymized_stream(texts: DataFrame, policy: str = "mask", config: Config | None = None, text_col: str = "text") -> DataFrame:
    """A stream with its text replaced, and the number of detections."""
    found = with_detections(texts, text_col)
    hidden = found.withColumn(text_col, anonymized(F.coalesce(F.col(text_col), F.lit("")), F.col("detections"), policy, config))
    return hidden.withColumn("pii_found", F.size("detections").cast("long")).drop("detections")
