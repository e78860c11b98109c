"""Anonymization of detected spans by a policy."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.config import Config
from textveil.functions.text import mask, pseudonym

POLICIES = ("mask", "replace", "pseudonymize")


def replacement(detection: Column, policy: str, config: Config) -> Column:
    if policy == "mask":
        return mask(detection["value"], config)
    if policy == "replace":
        return F.concat(F.lit("<"), detection["type"], F.lit(">"))
    return pseudonym(detection["value"], config, "PSEUDO")


def checked(policy: str | None) -> str:
    """The policy in lower case; no policy is ``mask``. An unknown one fails when the plan is made, never by passing texts through."""
    name = (policy or "mask").lower()
    if name not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    return name


def anonymized(text: Column, found: Column, policy: str | None = "mask", config: Config | None = None) -> Column:
    """The text with the engine's own detections (disjoint, in order) replaced."""
    config, policy = config or Config(), checked(policy)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, d: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, d["start"] - state["at"])
        return F.struct(d["end"].alias("at"), F.concat(state["out"], F.array(gap, replacement(d, policy, config))).alias("out"))

    whole = F.aggregate(found, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def replace_given_spans(docs: DataFrame, policy: str | None = "mask", config: Config | None = None) -> DataFrame:
    """Anonymize spans that the caller brings, in an Arrow UDF: ``docs(key, text, detections)`` to ``(key, text)``.

    Spans are trusted as they are; one that lies outside the text or is empty goes to the first place of
    its value, or nowhere. Spans that overlap are all hidden, each by its own replacement. A null text is null.
    """
    config, policy = config or Config(), checked(policy)
    import hashlib

    def written(d: dict) -> str:
        value = d["value"] or ""
        if policy == "replace":
            return f"<{d['type']}>"
        if policy == "pseudonymize":
            return "PSEUDO_" + hashlib.sha256((value + config.salt).encode()).hexdigest()[:12]
        keep = 0 if "@" in value or len(value) <= config.preserve_last else config.preserve_last
        return config.mask_char * (len(value) - keep) + (value[-keep:] if keep else "")

    def places(text: str, found) -> list[tuple[int, int, dict]]:
        """Where each detection stands, in order."""
        out = []
        for d in found if found is not None else ():
            value, inside = d["value"] or "", range(len(text) + 1)
            start, end = int(d["start"] or 0), int(d["end"] or 0)
            if not (start in inside and end in inside and start < end):
                start = text.find(value) if value else -1
                end = start + len(value)
            if start >= 0:
                out.append((start, end, d))
        return sorted(out, key=lambda x: x[:2])

    def one(text: str | None, found) -> str | None:
        if text is None:
            return None
        pieces, at = [], 0
        for start, end, d in places(text, found):
            pieces += [text[at:start], written(d)]
            at = max(at, end)
        return "".join([*pieces, text[at:]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "text": [one(t, f) for t, f in zip(frame["text"], frame["detections"], strict=True)]})

    source = docs.select("key", "text", "detections")
    return source.mapInPandas(run, f"key {source.schema['key'].dataType.simpleString()}, text string")


def anonymize_batch(names: DataFrame, texts: DataFrame, policy: str | None = "mask", config: Config | None = None) -> DataFrame:
    """``(name, anonymized, report)`` of named entries: ``names(name, detections)``, ``texts(name, text)``.

    A missing text is empty; an entry without a list of detections is left out.
    """
    config, policy = config or Config(), checked(policy)
    joined = names.where(F.col("detections").isNotNull()).join(texts.select("name", "text"), "name", "left")
    shown = F.transform("detections", lambda d: F.struct(*(d[c].alias(c) for c in ("type", "value", "start", "end", "confidence", "rule"))))
    report = F.to_json(F.struct(shown.alias("detections"), F.lit(policy).alias("policy")), {"ignoreNullFields": "false"})
    hidden = F.when(F.col("text").isNull(), F.lit("")).otherwise(anonymized(F.col("text"), F.col("detections"), policy, config))
    return joined.select("name", hidden.alias("anonymized"), report.alias("report"))


def batch_files(batch: DataFrame) -> DataFrame:
    """``(file, content)`` of a batch: ``<name>.anonymized.txt`` and ``<name>.report.json`` of each entry."""
    files = F.array(F.struct(F.concat("name", F.lit(".anonymized.txt")).alias("file"), F.col("anonymized").alias("content")), F.struct(F.concat("name", F.lit(".report.json")).alias("file"), F.col("report").alias("content")))
    return batch.select(F.explode(files).alias("f")).select("f.file", "f.content")


def save_batch(batch: DataFrame, path: str) -> None:
    """A batch's files as a table of ``(file, content)``: one object for each entry would swamp the store."""
    batch_files(batch).write.mode("overwrite").parquet(path)
