import pytest
from pyspark.sql import functions as F

from textveil.config import Config
from textveil.operators.maps import load_map, pseudonym_map, save_map
from textveil.operators.restore import residuals, restored, restored_by_run, unrestorable
from textveil.operators.validate import validate_denormalized, validate_map, validation_report
from textveil.plans.completion import Live
from textveil.plans.pipeline import analyze, maps_of, split_rejects
from textveil.sources.reports import as_json, listing, load_reports, save_reports, status_summary

A, B = "PSEUDO_1c3d93470e0c", "PSEUDO_1ae594c64246"
MAP = "run_id string, original string, pseudonym string"


def rows(spark, *more):
    return spark.createDataFrame([("r1", "alice@example.com", A), ("r1", "+1-555-111-2222", B), *more], MAP)


def test_restores_whole_words(spark):
    replies = spark.createDataFrame([("r1", f"Contact {A} or {B}$. x{A} {A}y é{B}"), ("r2", f"{A}"), ("r3", None), ("r4", "")], "run_id string, text string")
    got = {r.run_id: r.restored for r in restored(replies, rows(spark)).collect()}
    assert got == {"r1": f"Contact alice@example.com or +1-555-111-2222$. x{A} {A}y é{B}", "r2": A, "r3": "", "r4": ""}


def test_last_original_of_a_pseudonym_stays(spark):
    frame = spark.createDataFrame([("r1", "a", A, 0), ("r1", "b", A, 1)], MAP + ", position int")
    assert restored(spark.createDataFrame([("r1", A)], "run_id string, text string"), frame).first().restored == "b"
    got = validate_map(frame.drop("position")).first()
    assert (got.passed, got.duplicate_pseudonyms) == (False, [A])


def test_residuals(spark):
    replies = spark.createDataFrame([("r1", f"{A} {A} {B}x PSEUDO_000000000000")], "run_id string, text string")
    assert [(r.pseudonym, r.n) for r in residuals(replies, rows(spark)).collect()] == [(A, 2)]
    got = validate_denormalized(replies, rows(spark), "text").first()
    assert not got.passed and got.remaining_pseudos == {A: 2} and A in got.message
    assert spark.range(1).select(unrestorable(F.lit(f"98{A} {B}"))).first()[0] == 1


def test_invalid_entries(spark):
    got = validate_map(rows(spark, ("r1", "", "PSEUDO_0"), ("r1", "x", None))).first()
    assert not got.passed and got.invalid_entries == ["", "x"] and not got.duplicate_pseudonyms


def test_maps_are_stored_by_run(spark, tmp_path):
    save_map(rows(spark, ("r2", "z", "PSEUDO_1")), str(tmp_path / "maps"))
    assert load_map(spark, str(tmp_path / "maps"), "r1").count() == 2
    assert load_map(spark, str(tmp_path / "maps"), "absent").count() == 0
    replies = spark.createDataFrame([(f"to {A}",), (f"{A}{B}",), (None,)], "text string")
    assert sorted(r.restored for r in restored_by_run(replies, str(tmp_path / "maps"), "r1").collect()) == ["", f"{A}{B}", "to alice@example.com"]
    assert sorted(r.restored for r in restored_by_run(replies, str(tmp_path / "maps"), "absent").collect()) == ["", f"{A}{B}", f"to {A}"]
    with pytest.raises(ValueError):
        restored_by_run(replies, str(tmp_path / "maps"), "")
    assert load_map(spark, str(tmp_path / "none yet"), "r1").count() == 0
    assert restored_by_run(replies, str(tmp_path / "none yet"), "r1").where(F.col("restored") == f"to {A}").count() == 1


def test_replies_keep_their_own_originals(spark, tmp_path):
    """However often and in whatever order the replies are read: their order of arrival is no key."""
    names = [(f"r{i % 3}", f"name {i}", f"PSEUDO_{i:012x}") for i in range(300)]
    save_map(spark.createDataFrame(names, MAP), str(tmp_path / "maps"))
    texts = [(f"{i}: PSEUDO_{i:012x}, PSEUDO_{(i * 7) % 300:012x}",) for i in range(300)]
    replies = spark.createDataFrame(texts, "text string").repartition(7).orderBy(F.rand())
    for r in restored_by_run(replies, str(tmp_path / "maps"), "r1").collect():
        i = int(r.text.split(":")[0])
        j = (i * 7) % 300
        assert r.restored == f"{i}: " + ", ".join(f"name {x}" if x % 3 == 1 else f"PSEUDO_{x:012x}" for x in (i, j))


def test_map_of_values(spark):
    values = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "value string")
    assert pseudonym_map(values).count() == 1
    assert pseudonym_map(values, keep_empty=True).count() == 2


TEXTS = [("r1", "Write to alice.j@example.com today."), ("r2", "nothing"), ("r3", "Call 9876543210 now")]


def test_analysis(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, "run_id string, text string")
    got = {r.run_id: r for r in analyze(docs).collect()}
    one = got["r1"]
    assert one.ok and one.validation.overall_status == "PASS ✅" and "PSEUDO_" in one.anonymized_text
    assert one.llm_text == f"[MOCK RESPONSE] Model gemini-1.5-flash received {89 + len(one.anonymized_text)} characters."
    assert got["r2"].message and got["r2"].validation is None and got["r2"].llm_text is None and got["r2"].detections == []
    save_reports(analyze(docs), str(tmp_path / "reports"))
    stored = load_reports(spark, str(tmp_path / "reports"))
    assert [(r.run_id, r.status, r.pii_found) for r in listing(stored).collect()] == [("r1", "PASS ✅", 1), ("r2", "UNKNOWN", 0), ("r3", "PASS ✅", 1)]
    assert {(r.passed, r.runs) for r in status_summary(stored).collect()} == {(True, 2), (False, 1)}
    assert '"error":null' in as_json(stored, "run_id").first().report


def test_texts_are_stripped_and_empty_ones_refused(spark, tmp_path):
    docs = spark.createDataFrame([("r1", "  mail a@b.co \n"), ("r2", " \t\x1c"), ("r3", None)], "run_id string, text string")
    got = {r.run_id: r for r in analyze(docs).collect()}
    assert got["r1"].ok and (got["r1"].detections[0].start, got["r1"].anonymized_text[:5], got["r1"].anonymized_text[-1]) == (5, "mail ", got["r1"].anonymized_text.strip()[-1])
    for r in (got["r2"], got["r3"]):
        assert (r.ok, r.error, r.message, r.detections, r.anonymized_text, r.llm_text, r.validation) == (False, "Empty text input", None, None, None, None, None)
    assert listing(analyze(docs)).count() == 1
    assert "regexp_extract_all" not in str(analyze(docs).where("ok").select("run_id")._jdf.queryExecution().optimizedPlan())


def test_row_and_join_validation_agree(spark):
    docs = spark.createDataFrame(TEXTS, "run_id string, text string")
    live = Live("https://example.org/v1", "k", send=lambda url, headers, payload, timeout: {"choices": [{"message": {"content": payload["messages"][1]["content"] + " "}}]})
    reports = analyze(docs, live=live).where("validation is not null")
    flat = reports.select("run_id", F.col("anonymized_text").alias("anonymized"), F.col("llm_denormalized").alias("restored"), "validation")
    joined = {r.run_id: r for r in validation_report(flat.select("run_id", "anonymized", "restored"), maps_of(docs)).collect()}
    for r in flat.collect():
        assert r.validation.overall_status == joined[r.run_id].overall_status
        assert r.validation.denormalized_validation.passed == joined[r.run_id].denormalized_validation.passed
    assert "alice.j@example.com" in {r.run_id: r.restored for r in flat.collect()}["r1"]


def test_live_replies():
    config = Config()
    chat = Live("https://example.org", "k", send=lambda u, h, p, t: {"choices": [{"text": " hi "}]}).ask("p", config)
    assert chat["ok"] and chat["text"] == "hi"
    google = Live("https://generativelanguage.googleapis.com/x", "k", send=lambda u, h, p, t: {"candidates": [{"content": {"parts": [{"text": "yo"}]}}]}).ask("p", config)
    assert google["text"] == "yo"

    def broken(*_):
        raise OSError("down")

    assert Live("https://example.org", "k", send=broken, at_once=2).ask("p", config) == {"ok": False, "text": "[ERROR] down", "model": config.model, "raw": "{}"}


def test_failed_replies_are_not_stored(spark, tmp_path):
    def broken(*_):
        raise OSError("down")

    got = analyze(spark.createDataFrame(TEXTS[:1], "run_id string, text string"), live=Live("https://example.org", "k", send=broken))
    row = got.first()
    assert not row.ok and row.error == "[ERROR] down" and row.anonymized_text is None and row.validation is None
    assert listing(got).count() == 0


def test_rejects(spark):
    good, bad = split_rejects(spark.createDataFrame([(" a ",), (" \n",), (None,)], "text string"))
    assert [r.text for r in good.collect()] == ["a"] and bad.count() == 2
