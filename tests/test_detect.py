import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textveil.config import Config
from textveil.functions.patterns import DETECTORS
from textveil.functions.text import card_score, mask, normalize, pseudonym, redact_for_log, run_id
from textveil.operators.anonymize import anonymized, replace_given_spans
from textveil.operators.detect import resolve, spans, with_detections
from textveil.schema import DETECTION

D1 = "Contact John Doe (john.doe@example.com) or +1-555-987-6543. Customer SSN is 123-45-6789. Tester IP 192.168.1.100. Card: 4111 1111 1111 1111. PSEUDO_fa11579224fb should NOT be detected."


def found(spark, text):
    rows = with_detections(spark.createDataFrame([(text,)], "text string")).first().detections
    return [(d.type, d.value, d.start, d.end, d.confidence) for d in rows]


def test_every_kind(spark):
    assert found(spark, D1) == [
        ("NAME", "Contact John Doe", 0, 16, 0.45),
        ("EMAIL", "john.doe@example.com", 18, 38, 0.98),
        ("PHONE", "+1-555-987-6543", 43, 58, 0.88),
        ("SSN", "123-45-6789", 76, 87, 0.9),
        ("IP_ADDRESS", "192.168.1.100", 99, 112, 0.95),
        ("CREDIT_CARD", "4111 1111 1111 1111", 120, 139, 0.95),
    ]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("4111111111111112", [("PHONE", "11111112")]),
        ("1234 5678 9012 3456", [("PHONE", "1234 5678 9012")]),
        ("9876543210", [("PHONE", "76543210")]),
        ("1.2.3.999", [("IP_ADDRESS", "1.2.3.99")]),
        ("Anna Bela Cora Dora Ella", [("NAME", "Anna Bela Cora"), ("NAME", "Dora Ella")]),
        ("", []),
        (None, []),
        ("nothing here", []),
    ],
)
def test_edges(spark, text, expected):
    assert [(t, v) for t, v, *_ in found(spark, text)] == expected


def test_places_count_code_points(spark):
    assert found(spark, "😀é $1 \\ a@b.co")[0][2:4] == (8, 14)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB1 23.-@+()é\n", max_size=40), min_size=1, max_size=20))
def test_places_equal_those_of_re(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "i long, text string")
    for d in DETECTORS:
        got = {r.i: [(m.value, m.start, m.end) for m in r.m] for r in frame.select("i", spans(F.col("text"), d.pattern).alias("m")).collect()}
        pattern = re.compile(d.pattern.replace("(?iU)", "(?i)").replace("(?U)", ""))
        assert got == {i: [(m[0], *m.span()) for m in pattern.finditer(t)] for i, t in rows}, d.type


def survivors(rest, last=None):
    """What stays of detections in order of start, told from the last one that has stayed so far: the stronger of two that overlap, the earlier of two as strong."""
    if not rest:
        return [last] if last else []
    if last is None or rest[0][1] >= last[2]:
        return ([last] if last else []) + survivors(rest[1:], rest[0])
    return survivors(rest[1:], max(last, rest[0], key=lambda d: (d[3], d[2] - d[1])))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 8), st.sampled_from([0.45, 0.9, 0.95])), max_size=8), min_size=1, max_size=15))
def test_overlaps(spark, lists):
    cases = [[("NAME", a, a + n, c) for a, n, c in sorted(set(x))] for x in lists]
    rows = [(i, [(t, "x", a, b, c, "r") for t, a, b, c in case]) for i, case in enumerate(cases)]
    got = spark.createDataFrame(rows, f"i long, d array<{DETECTION}>").select("i", resolve(F.col("d")).alias("d")).collect()
    for r in got:
        kept = [(d.start, d.end, d.confidence) for d in r.d]
        ordered = sorted(cases[r.i], key=lambda d: (d[1], -d[3], d[1] - d[2]))
        assert kept == [x[1:] for x in survivors(ordered)]
        assert all(a[1] <= b[0] for a, b in zip(kept[:-1], kept[1:], strict=True))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scalars(spark):
    assert value(spark, normalize(F.lit("Name: John Doe\nEmail: john@example.com\nPhone: 9876543210"))) == "Name: John Doe Email: john@example.com Phone: 9876543210"
    assert value(spark, normalize(F.lit(None).cast("string"))) == ""
    assert value(spark, normalize(F.lit("\x1c a \x1f\x85 b\u2028"))) == " ".join("\x1c a \x1f\x85 b\u2028".split())
    assert value(spark, redact_for_log(F.lit("Hello test@example.com and phone 9876543210"))) == "Hello [EMAIL_REDACTED] and phone [NUM_REDACTED]"
    assert value(spark, redact_for_log(F.lit("x" * 201))) == "x" * 200 + "...(truncated)"
    assert value(spark, mask(F.lit("+1-555-987-6543"), Config())) == "***********6543"
    assert value(spark, mask(F.lit("a@b.co"), Config())) == "******"
    assert value(spark, mask(F.lit("1234"), Config())) == "****"
    assert value(spark, card_score(F.lit("4111 1111 1111 1111"))) == 0.95
    assert value(spark, card_score(F.lit("4111 1111 1111 1112"))) == 0.78
    assert value(spark, card_score(F.lit("411"))) == 0
    assert value(spark, pseudonym(F.lit("alice@example.com"), Config(salt="demo_salt"))) == "PSEUDO_1c3d93470e0c"
    assert value(spark, pseudonym(F.lit("4111 1111 1111 1111"), Config())) == "PSEUDO_496f99274aa9"
    assert value(spark, run_id(F.lit("2024-01-02 03:04:05").cast("timestamp"), "run")) == "run_20240102_030405"
    with pytest.raises(ValueError):
        Config(preserve_last=0)
    assert Config(mask_char="", salt="").mask_char == "*"


def test_policies(spark):
    rows = with_detections(spark.createDataFrame([("Mail a@b.co $1 now",), ("none",), (None,)], "text string"))
    out = lambda p: [r[0] for r in rows.select(anonymized(F.col("text"), F.col("detections"), p)).collect()]
    assert out("mask") == ["Mail ****** $1 now", "none", None]
    assert out("REPLACE") == ["Mail <EMAIL> $1 now", "none", None]
    with pytest.raises(ValueError):
        out("shred")


def test_given_spans(spark):
    text = "Reach john.doe@example.com, 4111 1111 1111 1111"
    given_spans = [("EMAIL", "john.doe@example.com", 6, 26, 1.0, "r"), ("CREDIT_CARD", "4111 1111 1111 1111", 40, 99, 1.0, "r"), ("NAME", "absent", 90, 95, 1.0, "r")]
    crossing = [("NAME", "a b", 0, 3, 1.0, "r"), ("EMAIL", "b c", 2, 5, 1.0, "r")]
    frame = spark.createDataFrame([(1, text, given_spans), (2, text, None), (3, None, given_spans), (4, "a b c d", crossing)], f"key long, text string, detections array<{DETECTION}>")
    got = {r.key: r.text for r in replace_given_spans(frame, "replace").collect()}
    assert got == {1: "Reach <EMAIL>, <CREDIT_CARD>", 2: text, 3: None, 4: "<NAME><EMAIL> d"}
