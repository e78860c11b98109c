"""Analysis of texts from detection to report, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.config import Config
from textveil.functions.text import pseudonym, stripped
from textveil.operators.anonymize import anonymized
from textveil.operators.detect import each, with_detections
from textveil.operators.maps import own_reversed, own_values
from textveil.operators.restore import substituted
from textveil.operators.validate import row_validation
from textveil.plans.completion import Live, completed

# The message of a report without detections, and the error of an empty text.
NOTHING = "No PII found in input text."
EMPTY = "Empty text input"


def split_rejects(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stripped texts, and the rows whose text is empty, with the error they get."""
    text = stripped(F.coalesce(F.col(text_col), F.lit("")))
    good = docs.withColumn(text_col, text).where(F.col(text_col) != "")
    return good, docs.where(text == "").withColumn("error", F.lit(EMPTY))


def pseudonymized(docs: DataFrame, config: Config | None = None) -> DataFrame:
    """``docs`` with ``detections``, its own map as ``originals`` and ``pseudonyms``, and ``anonymized``; each is made once for a row."""
    config = config or Config()
    found = with_detections(docs).withColumn("originals", own_values(F.col("detections")))
    found = found.withColumn("pseudonyms", F.transform("originals", lambda v: pseudonym(v, config)))
    return found.withColumn("anonymized", anonymized(F.coalesce(F.col("text"), F.lit("")), F.col("detections"), "pseudonymize", config))


def restored_by_own(reply: Column, config: Config | None = None) -> Column:
    """A reply with the pseudonyms of its row's own map (``originals``, ``pseudonyms``) restored."""
    prefix = F.lit(f"{(config or Config()).prefix}_")
    return F.when(F.contains(reply, prefix), substituted(reply, own_reversed(F.col("originals"), F.col("pseudonyms")))).otherwise(reply)


def analyze(docs: DataFrame, config: Config | None = None, live: Live | None = None, keys: tuple[str, ...] = ("run_id",), text_col: str = "text") -> DataFrame:
    """A report for each row of ``docs(*keys, text)``: one pass over the rows, without a shuffle, as each row's map is its own.

    ``ok, *keys, message, error, detections, anonymized_text, llm_text, llm_denormalized, validation``.
    Texts are stripped; an empty one is an error. A text without detections is not sent anywhere and has
    no validation; a failed reply is an error without texts. ``maps_of`` gives the maps to store.
    """
    config = config or Config()
    text = stripped(F.coalesce(F.col(text_col), F.lit("")))
    hidden = pseudonymized(docs.select(*keys, text.alias("text")), config)
    prompt = F.when(F.size("detections") > 0, F.concat(F.lit(config.prompt), F.col("anonymized")))
    replied = completed(hidden, prompt, config, live).withColumn("reply", F.when(F.col("completion.ok"), F.col("completion.text")))
    checked = row_validation(replied.withColumn("restored", restored_by_own(F.col("reply"), config)), "anonymized", "restored", "pseudonyms")
    # The mock never fails: then a filter on ``ok`` asks for the text alone, not for its detections.
    blank = F.col("text") == ""
    failed = blank | F.coalesce(~F.col("completion.ok"), F.lit(False)) if live is not None else blank
    return checked.select(
        (~failed).alias("ok"), *keys, F.when(~blank & F.col("completion").isNull(), F.lit(NOTHING)).alias("message"),
        F.when(blank, F.lit(EMPTY)).when(failed, F.col("completion.text")).alias("error"),
        F.when(~failed, F.col("detections")).alias("detections"), F.when(~failed, F.col("anonymized")).alias("anonymized_text"),
        F.col("reply").alias("llm_text"), F.col("restored").alias("llm_denormalized"), F.when(F.col("reply").isNotNull(), F.col("validation")).alias("validation"),
    )


def maps_of(docs: DataFrame, config: Config | None = None, keys: tuple[str, ...] = ("run_id",), text_col: str = "text") -> DataFrame:
    """``(*keys, original, pseudonym)`` of texts as ``analyze`` has them, to be stored apart from reports."""
    found = with_detections(docs.select(*keys, stripped(F.coalesce(F.col(text_col), F.lit(""))).alias("text")))
    rows = each(found, own_values(F.col("detections")), "original", *keys)
    return rows.withColumn("pseudonym", pseudonym(F.col("original"), config or Config()))
