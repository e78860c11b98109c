"""Detection of personal data: candidates, overlap resolution, and the removal of pseudonyms.

All of it is Column expressions over one text, so a scan needs no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.functions.patterns import DETECTORS, PSEUDONYM, Detector
from textveil.functions.text import card_score
from textveil.schema import DETECTION


def spans(text: Column, pattern: str) -> Column:
    """All matches as ``array<struct<value,start,end>>``, half-open from 0 in code points.

    The matches and the gaps between them alternate, so positions are running sums of lengths.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<value:string,start:int,end:int>>").alias("out"))
    # Zipped, as a lambda that named the gaps would split the text for each match; the last gap has no match.
    pairs = F.filter(F.zip_with(found, gaps, lambda v, g: F.struct(v.alias("v"), F.length(g).alias("gap"))), lambda p: p["v"].isNotNull())

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        end = begin + F.length(pair["v"])
        return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(pair["v"].alias("value"), begin.alias("start"), end.alias("end"))).alias("out"))

    return F.aggregate(pairs, start, step, lambda s: s["out"])


def confidence(detector: Detector, value: Column) -> Column:
    if detector.type == "CREDIT_CARD":
        return F.greatest(F.lit(detector.base), card_score(value))
    return F.lit(0.88 if detector.type == "PHONE" else detector.base)


def matches(text: Column, detector: Detector) -> Column:
    """A detector's candidates as ``array<DETECTION>``. A telephone number has seven digits at least."""
    found = spans(text, detector.pattern)
    if detector.type == "PHONE":
        found = F.filter(found, lambda m: F.length(F.regexp_replace(m["value"], r"(?U)\D", "")) >= 7)
    rows = F.transform(
        found,
        lambda m: F.struct(
            F.lit(detector.type).alias("type"), m["value"].alias("value"), m["start"].alias("start"), m["end"].alias("end"),
            confidence(detector, m["value"]).cast("double").alias("confidence"), F.lit(detector.rule).alias("rule"),
        ),
    )
    return F.when(F.regexp_like(text, F.lit(detector.needs)), rows).otherwise(F.array().cast(f"array<{DETECTION}>"))


def candidates(text: Column) -> Column:
    return F.concat(*(matches(text, d) for d in DETECTORS))


def resolve(found: Column) -> Column:
    """Disjoint detections: in order of start, the more confident, then the longer of two that overlap stays.

    Of those kept so far only the last can overlap the next, so one element of state is enough. A
    detection that gave way does not come back, even if its rival gives way later.
    """
    place = F.map_from_arrays(F.array(*(F.lit(d.type) for d in DETECTORS)), F.array(*(F.lit(i) for i in range(len(DETECTORS)))))
    keyed = F.transform(found, lambda d: F.struct(d["start"].alias("k1"), (-d["confidence"]).alias("k2"), (d["start"] - d["end"]).alias("k3"), place[d["type"]].alias("k4"), d.alias("d")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["d"])
    none = F.array().cast(f"array<{DETECTION}>")

    def step(kept: Column, d: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        apart = last.isNull() | (d["start"] >= last["end"])
        longer = (d["end"] - d["start"]) > (last["end"] - last["start"])
        wins = (d["confidence"] > last["confidence"]) | ((d["confidence"] == last["confidence"]) & longer)
        return F.when(apart, F.array_append(kept, d)).when(wins, F.array_append(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), d)).otherwise(kept)

    return F.aggregate(ordered, none, step)


def without_pseudonyms(text: Column, found: Column) -> Column:
    """Detections that neither lie in a pseudonym nor hold one. It comes after ``resolve``."""
    inside = F.when(F.contains(text, F.lit("PSEUDO_")), spans(text, PSEUDONYM)).otherwise(F.array().cast("array<struct<value:string,start:int,end:int>>"))
    return F.filter(found, lambda d: ~F.contains(d["value"], F.lit("PSEUDO_")) & ~F.exists(inside, lambda p: (d["start"] >= p["start"]) & (d["end"] <= p["end"])))


def detect(text: Column) -> Column:
    """The detections of a text as ``array<DETECTION>``; none for null or empty."""
    whole = F.coalesce(text, F.lit(""))
    return without_pseudonyms(whole, resolve(candidates(whole)))


def with_detections(docs: DataFrame, text_col: str = "text", out_col: str = "detections") -> DataFrame:
    """``docs`` with the column of detections, each stage evaluated once for a row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    staged = docs.withColumn("_candidates", candidates(text)).withColumn("_resolved", F.when(F.size("_candidates") > 0, resolve(F.col("_candidates"))).otherwise(F.col("_candidates")))
    return staged.withColumn(out_col, F.when(F.size("_resolved") > 0, without_pseudonyms(text, F.col("_resolved"))).otherwise(F.col("_resolved"))).drop("_candidates", "_resolved")


def exploded(docs: DataFrame, found: str = "detections", *keys: str) -> DataFrame:
    """A row for each detection: keys, and the detection's fields."""
    return each(docs, F.col(found), "d", *keys).select(*keys, "d.*")


def each(rows: DataFrame, items: Column, name: str, *keys: str) -> DataFrame:
    """``(*keys, name)``, a row for each item of an array that isn't null.

    A plain ``explode`` has Spark infer a filter on the array's size and push it below, which evaluates a
    costly array once more for every place that names it; the outer form keeps to one evaluation.
    """
    return rows.select(*keys, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())
