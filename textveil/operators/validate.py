"""Validation of both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.operators.detect import with_detections
from textveil.operators.restore import pseudonyms_in, residuals

# Statuses and messages of reports.
PASS, FAIL = "PASS ✅", "FAIL ❌"
CLEAN, LEFT = "No PII detected ✅", " PII instances still present ❌"
RESTORED, RESIDUAL = "No pseudonyms remaining ✅", "Residual pseudonyms found: "
MAP_RIGHT, MAP_WRONG = "Mapping integrity OK ✅", "Mapping contains invalid or duplicate entries ❌"


# The three checks of a report, each from what it is told by, wherever that comes from.


def anonymized_check(found: Column) -> Column:
    """From the detections that anonymized text still has."""
    n = F.size(found)
    message = F.when(n == 0, F.lit(CLEAN)).otherwise(F.concat(n.cast("string"), F.lit(LEFT)))
    return F.struct((n == 0).alias("passed"), n.cast("long").alias("pii_detected"), found.alias("detections"), message.alias("message"))


def denormalized_check(left: Column) -> Column:
    """From the map's pseudonyms that restored text still has, with their counts, in order: ``array<struct<pseudonym,n>>``."""
    names = F.array_join(F.transform(left, lambda x: F.concat(F.lit("'"), x["pseudonym"], F.lit("'"))), ", ")
    message = F.when(F.size(left) == 0, F.lit(RESTORED)).otherwise(F.concat(F.lit(RESIDUAL + "["), names, F.lit("]")))
    return F.struct((F.size(left) == 0).alias("passed"), F.map_from_entries(left).alias("remaining_pseudos"), message.alias("message"))


def map_check(invalid: Column, duplicates: Column) -> Column:
    """From a map's originals of invalid entries, and its pseudonyms of several originals."""
    passed = (F.size(invalid) == 0) & (F.size(duplicates) == 0)
    return F.struct(passed.alias("passed"), invalid.alias("invalid_entries"), duplicates.alias("duplicate_pseudonyms"), F.when(passed, F.lit(MAP_RIGHT)).otherwise(F.lit(MAP_WRONG)).alias("message"))


def overall(*checks: Column) -> Column:
    passed = F.lit(True)
    for check in checks:
        passed = passed & check["passed"]
    return F.when(passed, F.lit(PASS)).otherwise(F.lit(FAIL))


def validate_anonymized(docs: DataFrame, text_col: str = "anonymized", keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """``(*keys, passed, pii_detected, message, detections)``: detection run again on the anonymized text."""
    found = with_detections(docs.select(*keys, F.col(text_col).alias("_text")), "_text")
    return found.select(*keys, anonymized_check(F.col("detections")).alias("c")).select(*keys, "c.passed", "c.pii_detected", "c.message", "c.detections")


def validate_denormalized(docs: DataFrame, rows: DataFrame, text_col: str = "restored", keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """``(*keys, passed, remaining, message, remaining_pseudos)``: pseudonyms of the map that are left in restored texts."""
    left = residuals(docs, rows, text_col, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pseudonym", "n"))).alias("_left"))
    joined = docs.select(*keys).join(left, list(keys), "left").withColumn("_left", F.coalesce("_left", F.array().cast("array<struct<pseudonym:string,n:bigint>>")))
    return joined.select(*keys, "_left", denormalized_check(F.col("_left")).alias("c")).select(*keys, "c.passed", F.size("_left").cast("long").alias("remaining"), "c.message", "c.remaining_pseudos")


def validate_map(rows: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """``(*keys, passed, invalid_entries, duplicate_pseudonyms, message)``: null or empty entries, and pseudonyms of several originals."""
    bad = (F.coalesce("original", F.lit("")) == "") | (F.coalesce("pseudonym", F.lit("")) == "")
    each = rows.groupBy(*keys, "pseudonym").agg(F.count("*").alias("n"), F.collect_list(F.when(bad, F.coalesce("original", F.lit("")))).alias("bad"))
    invalid = F.array_sort(F.flatten(F.collect_list("bad")))
    duplicates = F.array_sort(F.collect_list(F.when((F.col("n") > 1) & F.col("pseudonym").isNotNull(), F.col("pseudonym"))))
    whole = each.groupBy(*keys).agg(invalid.alias("invalid"), duplicates.alias("duplicates"))
    return whole.select(*keys, map_check(F.col("invalid"), F.col("duplicates")).alias("c")).select(*keys, "c.passed", "c.invalid_entries", "c.duplicate_pseudonyms", "c.message")


def validation_report(docs: DataFrame, rows: DataFrame, anonymized_col: str = "anonymized", restored_col: str = "restored", keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """``(*keys, anonymized_validation, denormalized_validation, pseudomap_validation, overall_status)``; a key without a map has an empty one."""
    first = validate_anonymized(docs, anonymized_col, keys).select(*keys, F.struct("passed", "pii_detected", "detections", "message").alias("anonymized_validation"))
    second = validate_denormalized(docs, rows, restored_col, keys).select(*keys, F.struct("passed", "remaining_pseudos", "message").alias("denormalized_validation"))
    third = validate_map(rows, keys).select(*keys, F.struct("passed", "invalid_entries", "duplicate_pseudonyms", "message").alias("pseudomap_validation"))
    none = F.array().cast("array<string>")
    joined = first.join(second, list(keys)).join(third, list(keys), "left").withColumn("pseudomap_validation", F.coalesce("pseudomap_validation", map_check(none, none)))
    return joined.withColumn("overall_status", overall(F.col("anonymized_validation"), F.col("denormalized_validation"), F.col("pseudomap_validation")))


def row_validation(found: DataFrame, anonymized_col: str, restored_col: str, pseudonyms_col: str) -> DataFrame:
    """``found`` with the column ``validation`` for texts whose map is their own row's, so that nothing is joined.

    ``pseudonyms_col`` holds the pseudonyms of the row's map, one for each original.
    """
    checked = with_detections(found, anonymized_col, "_again")
    own = F.col(pseudonyms_col)
    checked = checked.withColumn("_words", F.filter(pseudonyms_in(F.col(restored_col)), lambda w: F.array_contains(own, w)))
    counts = F.transform(F.array_sort(F.array_distinct("_words")), lambda x: F.struct(x.alias("pseudonym"), F.size(F.filter("_words", lambda w: w == x)).cast("long").alias("n")))
    doubled = F.array_distinct(F.filter(own, lambda p: F.size(F.filter(own, lambda q: q == p)) > 1))
    checked = checked.withColumn("_left", counts).withColumn("_doubled", doubled)
    parts = anonymized_check(F.col("_again")), denormalized_check(F.col("_left")), map_check(F.array().cast("array<string>"), F.col("_doubled"))
    for name, part in zip(("_first", "_second", "_third"), parts, strict=True):
        checked = checked.withColumn(name, part)
    names = "anonymized_validation", "denormalized_validation", "pseudomap_validation"
    columns = F.col("_first"), F.col("_second"), F.col("_third")
    whole = F.struct(*(c.alias(n) for c, n in zip(columns, names, strict=True)), overall(*columns).alias("overall_status"))
    return checked.withColumn("validation", whole).drop("_again", "_words", "_left", "_doubled", "_first", "_second", "_third")
