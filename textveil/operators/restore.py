"""Restoring originals in replies.

A reply is split into words and what stands between them once; words that are pseudonyms are looked
up in the map, by a join. Nothing is substituted twice, and longer pseudonyms need no precedence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.operators.detect import each
from textveil.operators.maps import load_map

#: Maximal runs of word characters: a pseudonym counts where it is a whole run.
_WORD = r"(?U)\w+"


def reversed_map(rows: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, pseudonym, original)``: of originals that share a pseudonym the greatest position stays, if there is one, else the greatest."""
    last = F.struct(F.col("position"), F.col("original")) if "position" in rows.columns else F.struct(F.col("original").alias("position"), F.col("original"))
    kept = rows.where("pseudonym <> '' and original <> ''")
    return kept.groupBy(*keys, "pseudonym").agg(F.max(last).alias("last")).select(*keys, "pseudonym", F.col("last.original").alias("original"))


def pseudonyms_in(text: Column, prefix: str = "PSEUDO") -> Column:
    """Whole words of a text that begin like a pseudonym."""
    words = F.regexp_extract_all(text, F.lit(rf"(?U)(?<!\w)\Q{prefix}_\E\w*"), F.lit(0))
    return F.when(F.contains(text, F.lit(f"{prefix}_")), words).otherwise(F.array().cast("array<string>"))


def substituted(text: Column, originals: Column) -> Column:
    """The text with each whole word that ``originals`` (a map) has as a key replaced by its value."""
    words, gaps = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.split(text, _WORD, -1)
    # There is a gap more than words: the last one stands alone.
    return F.array_join(F.zip_with(gaps, words, lambda g, w: F.concat(g, F.coalesce(F.try_element_at(originals, w), w, F.lit("")))), "")


def restored(replies: DataFrame, rows: DataFrame, text_col: str = "text", out_col: str = "restored", keys: tuple[str, ...] = ("run_id",), prefix: str = "PSEUDO") -> DataFrame:
    """``replies`` with pseudonyms of the same key in ``rows(*keys, original, pseudonym)`` restored in ``out_col``.

    Only the pseudonyms that a reply holds are joined, by key and pseudonym; a key without a map leaves
    its reply unchanged, and null is empty. ``replies`` has one row for each of ``keys``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = each(replies, F.array_distinct(pseudonyms_in(text, prefix)), "pseudonym", *keys)
    met = held.join(reversed_map(rows, *keys), [*keys, "pseudonym"])
    found = met.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pseudonym", "original"))).alias("_originals"))
    joined = replies.join(found, list(keys), "left")
    return joined.withColumn(out_col, F.when(F.col("_originals").isNull(), text).otherwise(substituted(text, F.col("_originals")))).drop("_originals")


def residuals(replies: DataFrame, rows: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("run_id",), prefix: str = "PSEUDO") -> DataFrame:
    """``(*keys, pseudonym, n)``: how often each pseudonym of the key's map stands in the reply as a whole word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = each(replies, pseudonyms_in(text, prefix), "pseudonym", *keys).groupBy(*keys, "pseudonym").agg(F.count("*").alias("n"))
    return held.join(rows.where("pseudonym <> ''").select(*keys, "pseudonym").distinct(), [*keys, "pseudonym"])


def unrestorable(text: Column) -> Column:
    """Pseudonyms that touch a word character, so that neither restoring nor the residual check sees them."""
    loose = F.regexp_count(text, F.lit(r"PSEUDO_[0-9a-fA-F]{12}"))
    return loose - F.regexp_count(text, F.lit(r"(?U)(?<!\w)PSEUDO_[0-9a-fA-F]{12}(?!\w)"))


def restored_by_run(replies: DataFrame, maps_path: str, run_id: str, text_col: str = "text", out_col: str = "restored") -> DataFrame:
    """``replies`` of one run restored by its stored map; without a map they stay as they are, and an empty run id is an error."""
    if not run_id:
        raise ValueError("run_id is empty")
    last = reversed_map(load_map(replies.sparkSession, maps_path, run_id), "run_id").select("pseudonym", "original")
    # One run's map is as large as its texts' detections are many: it is joined, not collected. Replies meet
    # their originals again by the digest of their text, which is the same however often they are read.
    text, key = F.coalesce(F.col(text_col), F.lit("")), "_digest"
    keyed = replies.withColumn(key, F.when(F.contains(text, F.lit("PSEUDO_")), F.sha2(text.cast("binary"), 256)))
    held = each(keyed.where(F.col(key).isNotNull()), F.array_distinct(pseudonyms_in(text)), "pseudonym", key).distinct()
    found = held.join(last, "pseudonym").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pseudonym", "original"))).alias("_originals"))
    joined = keyed.join(found, key, "left")
    return joined.withColumn(out_col, F.when(F.col("_originals").isNull(), text).otherwise(substituted(text, F.col("_originals")))).drop("_originals", key)
