"""The registered queries of the privacy engine over the driver's tables."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.config import Config
from textveil.functions.patterns import DETECTORS, PSEUDONYM
from textveil.functions.text import card_score, mask, normalize, pseudonym, redact_for_log, run_id
from textveil.operators.anonymize import anonymize_batch, anonymized
from textveil.operators.detect import candidates, detect, each, exploded, matches, resolve, spans, with_detections
from textveil.operators.maps import pseudonym_map, pseudonymize_values
from textveil.operators.restore import residuals, restored, unrestorable
from textveil.operators.validate import row_validation, validate_anonymized, validate_denormalized, validate_map
from textveil.plans.completion import mocked
from textveil.plans.pipeline import analyze, maps_of, pseudonymized, restored_by_own
from textveil.sources.files import extracted, flatten_json, packet_rows
from textveil.sources.reports import listing, status_summary

CONFIG = Config()
#: Texts that the tables don't hold: each kind of detection, pseudonyms, overlaps and unguarded matches.
SAMPLES = {
    -1: "Contact John Doe (john.doe@example.com) or +1-555-987-6543. Customer SSN is 123-45-6789. Tester IP 192.168.1.100. Card: 4111 1111 1111 1111. PSEUDO_fa11579224fb should NOT be detected.",
    -2: "Card 4111111111111112 and 1234 5678 9012 3456, call 9876543210 or 1.2.3.999; SSN 123456789.",
    -3: "Anna Maria Lopez Garcia Ruiz met PSEUDO_12345678abcd at ann@b.co twice, ann@b.co said PSEUDO_00.",
    -4: "",
    -5: "Mañana Élan Zoë Kay Bee $1 \\2 été John Smith a1234567b",
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)``: the table and the samples. A row group is one task's work, so a table of fewer tasks than cores is dealt out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores, "doc_id")
    return docs.union(spark.createDataFrame(list(SAMPLES.items()), "doc_id long, text string"))


def _rows(found: DataFrame) -> DataFrame:
    """Detections as rows, with lengths and places as the driver's SQL has them."""
    return found.select("doc_id", "type", "value", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "confidence", "rule")


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_detections(documents(spark, sf_dir))


def hidden(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    return detected(spark, sf_dir).withColumn("anonymized", anonymized(F.col("text"), F.col("detections"), policy, CONFIG))


def normalize_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", normalize(F.col("text")).alias("text"))


def json_flatten_events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", normalize(flatten_json(F.col("props"))).alias("text"))


def detect_one(name: str) -> Callable[[SparkSession, str], DataFrame]:
    detector = next(d for d in DETECTORS if d.type == name)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(exploded(documents(spark, sf_dir).select("doc_id", matches(F.col("text"), detector).alias("detections")), "detections", "doc_id"))

    return query


def pseudonym_spans(spark, sf_dir):
    found = each(documents(spark, sf_dir).where(F.contains("text", F.lit("PSEUDO_"))), spans(F.col("text"), PSEUDONYM), "m", "doc_id")
    return found.select("doc_id", "m.value", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"))


def luhn_scores(spark, sf_dir):
    return detect_one("CREDIT_CARD")(spark, sf_dir).select("doc_id", "value", "start", card_score(F.col("value")).alias("score"))


def detect_candidates(spark, sf_dir):
    return _rows(exploded(documents(spark, sf_dir).select("doc_id", candidates(F.col("text")).alias("detections")), "detections", "doc_id"))


def confidence_by_type(spark, sf_dir):
    return detect_candidates(spark, sf_dir).groupBy("type", "confidence", "rule").agg(F.count("*").alias("n"))


def detect_resolved(spark, sf_dir):
    return _rows(exploded(documents(spark, sf_dir).select("doc_id", resolve(candidates(F.col("text"))).alias("detections")), "detections", "doc_id"))


def pii_detections(spark, sf_dir):
    return _rows(exploded(detected(spark, sf_dir), "detections", "doc_id"))


def detect_clean(spark, sf_dir):
    """The whole of detection as one expression of the text."""
    return _rows(exploded(documents(spark, sf_dir).select("doc_id", detect(F.col("text")).alias("detections")), "detections", "doc_id"))


def pii_type_counts(spark, sf_dir):
    return exploded(detected(spark, sf_dir), "detections", "doc_id").groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def anonymize_with(policy: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: hidden(spark, sf_dir, policy).select("doc_id", "anonymized")


def masked_values(spark, sf_dir):
    return pii_detections(spark, sf_dir).select("value").distinct().select("value", mask(F.col("value"), CONFIG).alias("masked"))


def pseudonymize_names(spark, sf_dir):
    return pii_detections(spark, sf_dir).select("doc_id", "start", "value", pseudonym(F.col("value"), CONFIG).alias("pseudonym"))


def pseudonymize_customers(spark, sf_dir):
    return pseudonymize_values(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_name", CONFIG)


def anonymize_batch_names(spark, sf_dir):
    """Detections by document name, and those of a name without a text."""
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    found = detected(spark, sf_dir).withColumn("name", name)
    more = with_detections(spark.createDataFrame([("absent.txt", SAMPLES[-1])], "name string, text string"))
    names = found.select("name", "detections").union(more.select("name", "detections"))
    return anonymize_batch(names, documents(spark, sf_dir).select(name.alias("name"), "text"), "replace", CONFIG)


def doc_maps(spark, sf_dir):
    return maps_of(documents(spark, sf_dir), CONFIG, ("doc_id",))


def map_of_run(spark, sf_dir):
    return pseudonym_map(exploded(detected(spark, sf_dir), "detections", "doc_id"), CONFIG)


def map_with_empty(spark, sf_dir):
    found = detect_candidates(spark, sf_dir).select("value")
    return pseudonym_map(found.union(spark.createDataFrame([("",), (None,)], "value string")), CONFIG, keep_empty=True)


def replies(spark, sf_dir) -> DataFrame:
    """Simulated replies: the pseudonymized texts."""
    return hidden(spark, sf_dir, "pseudonymize").select("doc_id", F.col("anonymized").alias("reply"), "anonymized")


def round_trip(spark, sf_dir) -> DataFrame:
    """Replies restored by the maps of their own rows, in one pass."""
    return pseudonymized(documents(spark, sf_dir), CONFIG).withColumn("restored", restored_by_own(F.col("anonymized"), CONFIG))


def denormalize_roundtrip(spark, sf_dir):
    return round_trip(spark, sf_dir).select("doc_id", "restored", unrestorable(F.col("anonymized")).cast("long").alias("unrestorable"))


def _by_run(df: DataFrame) -> DataFrame:
    """Documents as runs."""
    return df.withColumn("run_id", F.concat(F.lit("run_"), F.col("doc_id").cast("string"))).drop("doc_id")


def denormalize_by_run(spark, sf_dir):
    """Replies of runs restored by stored maps, and one of a run without a map."""
    lost = spark.createDataFrame([("to PSEUDO_fa11579224fb", "run_lost")], "reply string, run_id string")
    runs = _by_run(replies(spark, sf_dir).select("doc_id", "reply")).select("reply", "run_id").union(lost)
    return restored(runs, _by_run(doc_maps(spark, sf_dir)), "reply", "restored").select("run_id", "restored")


def residual_pseudonyms(spark, sf_dir):
    return residuals(replies(spark, sf_dir), doc_maps(spark, sf_dir), "reply", ("doc_id",))


def anonymized_checks(spark, sf_dir):
    return validate_anonymized(hidden(spark, sf_dir, "mask").select("doc_id", "anonymized"), "anonymized", ("doc_id",)).drop("detections")


def denormalized_checks(spark, sf_dir):
    """Replies of which every second was not restored."""
    back = round_trip(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("anonymized")).otherwise(F.col("restored")).alias("restored"))
    return validate_denormalized(back, doc_maps(spark, sf_dir), "restored", ("doc_id",)).select("doc_id", "passed", "remaining", "message")


def validate_maps(spark, sf_dir):
    """Maps of documents, and one with an empty original and one that repeats a pseudonym."""
    more = spark.createDataFrame([(-100, "", "PSEUDO_000000000001"), (-100, "a", "PSEUDO_000000000002"), (-101, "b", "PSEUDO_000000000003"), (-101, "c", "PSEUDO_000000000003")], "doc_id long, original string, pseudonym string")
    found = validate_map(doc_maps(spark, sf_dir).union(more), ("doc_id",))
    return found.select("doc_id", "passed", F.size("invalid_entries").cast("long").alias("invalid"), F.array_join("duplicate_pseudonyms", ",").alias("duplicates"), "message")


def validation_reports(spark, sf_dir):
    v = F.col("validation")
    report = row_validation(round_trip(spark, sf_dir), "anonymized", "restored", "pseudonyms")
    return report.select("doc_id", v["anonymized_validation"]["passed"].alias("clean"), v["denormalized_validation"]["passed"].alias("restored"), v["pseudomap_validation"]["passed"].alias("map"), v["overall_status"].alias("overall_status"))


def mock_completion(spark, sf_dir):
    text = hidden(spark, sf_dir, "pseudonymize")
    sent = F.when(F.size("detections") > 0, F.array(mocked(F.concat(F.lit(CONFIG.prompt), F.col("anonymized")), CONFIG)))
    return each(text, sent, "c", "doc_id").select("doc_id", "c.ok", "c.text", "c.model")


def reports(spark, sf_dir) -> DataFrame:
    return analyze(documents(spark, sf_dir), CONFIG, keys=("doc_id",))


def analyze_batch(spark, sf_dir):
    found = reports(spark, sf_dir)
    return found.select("ok", "doc_id", "message", F.greatest(F.size("detections"), F.lit(0)).cast("long").alias("pii_found"), "anonymized_text", "llm_text", "llm_denormalized", F.col("validation.overall_status").alias("status"))


def report_listing(spark, sf_dir):
    return listing(reports(spark, sf_dir), "doc_id")


def status_counts(spark, sf_dir):
    return status_summary(reports(spark, sf_dir).withColumn("run_id", F.col("doc_id").cast("string")))


def log_redaction(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", redact_for_log(F.col("text")).alias("line"))


def run_ids_from_events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", run_id(F.col("ts"), "run").alias("run_id"), run_id(F.col("ts")).alias("stamp"))


def _capture(text: str) -> bytes:
    """A capture of one UDP packet that holds a text."""
    payload = text.encode()[:60000]
    udp = struct.pack("!HHHH", 4000, 4001, 8 + len(payload), 0) + payload
    ip = struct.pack("!BBHHHBBH4B4B", 0x45, 0, 20 + len(udp), 1, 0, 64, 17, 0, 10, 0, 0, 1, 10, 0, 0, 2) + udp
    frame = b"\x02" * 12 + b"\x08\x00" + ip
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + struct.pack("<IIII", 0, 0, len(frame), len(frame)) + frame


def _files(spark: SparkSession) -> DataFrame:
    rows = [(f"/in/{-i}.pcap", bytearray(_capture(t))) for i, t in SAMPLES.items()]
    rows += [(f"/in/{-i}.TXT", bytearray(t.encode() + b"\n\xff")) for i, t in SAMPLES.items()]
    rows += [("/in/a.json", bytearray(b'{"a": {"b": [1, true, null]}, "c": {}, "d": "x"}')), ("/in/b.json", bytearray(b"{")), ("/in/c.bin", bytearray(b"x"))]
    return spark.createDataFrame(rows, "path string, content binary")


def pcap_payloads(spark, sf_dir):
    return packet_rows(_files(spark).where("path like '%.pcap'"))


def extract_dispatch(spark, sf_dir):
    return extracted(_files(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "normalize_documents": normalize_documents,
    "json_flatten_events": json_flatten_events,
    **{f"detect_{short}": detect_one(name) for short, name in (("email", "EMAIL"), ("phone", "PHONE"), ("credit_card", "CREDIT_CARD"), ("ip", "IP_ADDRESS"), ("ssn", "SSN"), ("name", "NAME"))},
    "pseudonym_spans": pseudonym_spans,
    "luhn_scores": luhn_scores,
    "confidence_by_type": confidence_by_type,
    "detect_candidates": detect_candidates,
    "detect_resolved": detect_resolved,
    "detect_clean": detect_clean,
    "pii_detections": pii_detections,
    "pii_type_counts": pii_type_counts,
    "mask_values": masked_values,
    "anonymize_mask": anonymize_with("mask"),
    "anonymize_replace": anonymize_with("replace"),
    "anonymize_pseudonymize": anonymize_with("pseudonymize"),
    "anonymize_batch": anonymize_batch_names,
    "pseudonymize_values": pseudonymize_names,
    "pseudonymize_customers": pseudonymize_customers,
    "pseudonym_map": map_of_run,
    "pseudonym_map_nullable": map_with_empty,
    "denormalize_roundtrip": denormalize_roundtrip,
    "denormalize_by_run": denormalize_by_run,
    "residual_pseudonyms": residual_pseudonyms,
    "validate_anonymized": anonymized_checks,
    "validate_denormalized": denormalized_checks,
    "validate_map": validate_maps,
    "validation_report": validation_reports,
    "mock_completion": mock_completion,
    "analyze_batch": analyze_batch,
    "report_listing": report_listing,
    "status_summary": status_counts,
    "log_redaction": log_redaction,
    "run_ids_from_events": run_ids_from_events,
    "pcap_payloads": pcap_payloads,
    "extract_dispatch": extract_dispatch,
}
