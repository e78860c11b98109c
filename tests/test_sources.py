import gzip
import struct

from textveil.operators.anonymize import anonymize_batch, save_batch
from textveil.plans.queries import SAMPLES, _capture, anonymize_batch_names
from textveil.schema import DETECTION
from textveil.sources.files import flattened, packets, read_json, read_pcap, read_text
from textveil.sources.reports import get_logger, read_json_documents
from textveil.streaming.detection import anonymized_stream


def test_flattening():
    assert flattened('{"a": {"b": [1, true, null]}}') == "a.b.[0]: 1 | a.b.[1]: True | a.b.[2]: None"
    assert flattened('{"user": {"name": "Alice", "email": "alice@abc.com"}}') == "user.name: Alice | user.email: alice@abc.com"
    assert flattened("3") == ": 3" and flattened("{") == "" and flattened("[[], {}]") == "" and flattened(None) == ""


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_bytes(b"Name:\tJohn\r\n\r\nDoe  x\xff")
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"k": [1e5, "x"]}')
    (tmp_path / "j/b.json").write_bytes(b"\xff{}")
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.pcap").write_bytes(_capture(SAMPLES[-2]))
    assert read_text(spark, str(tmp_path / "t")).first().text == "Name: John Doe x�"
    assert sorted(r.text for r in read_json(spark, str(tmp_path / "j")).collect()) == ["", "k.[0]: 100000.0 | k.[1]: x"]
    row = read_pcap(spark, str(tmp_path / "p")).first()
    assert (row.packet_no, row.src, row.dst, row.text) == (1, "10.0.0.1", "10.0.0.2", SAMPLES[-2])


def test_captures_stop_and_tolerate():
    one = _capture("hello")
    many = one + one[24:] * 600
    assert len([*packets(many)]) == 500 and len([*packets(many, 3)]) == 3
    assert [*packets(b"")] == [] and [*packets(one[:30])] == []
    short = one[:24] + struct.pack("<IIII", 0, 0, 4, 4) + b"abcd"
    assert [*packets(short)] == []
    assert [p[0] for p in packets(short + one[24:])] == [2]


def test_captures_of_other_forms():
    one = _capture("hello")
    frame = one[40:]
    assert [*packets(gzip.compress(one))] == [*packets(one)] and [*packets(b"\x1f\x8bxx")] == []
    pad = b"\0" * (-len(frame) % 4)

    def block(kind, body):
        size = struct.pack("<I", len(body) + 12)
        return struct.pack("<I", kind) + size + body + size

    section = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    packet = block(6, struct.pack("<IIIII", 0, 0, 0, len(frame), len(frame)) + frame + pad)
    simple = block(3, struct.pack("<I", len(frame)) + frame + pad)
    assert [p[3] for p in packets(section + packet + block(5, b"") + simple)] == [b"hello"] * 2 and [*packets(section + packet[:-2])] == []
    raw = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 101) + struct.pack("<IIII", 0, 0, len(frame) - 14, len(frame) - 14) + frame[14:]
    assert [*packets(raw)] == [(1, "unknown", "unknown", b"hello")]
    names = frame[:34] + struct.pack("!HH", 4000, 53) + frame[38:]
    assert [*packets(one[:24] + struct.pack("<IIII", 0, 0, len(names), len(names)) + names)] == []


def test_deep_and_invalid_documents(spark, tmp_path):
    assert flattened("[" * 100_000 + "]" * 100_000) == ""
    for name, content in (("a.json", b'{"k": 1}'), ("b.json", b"{"), ("c.json", b"\xff{}")):
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r.document for r in read_json_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.json": '{"k": 1}', "b.json": None, "c.json": None}
    assert read_json_documents(spark, str(tmp_path / "none")).count() == 0


def test_logs_go_to_a_file_once(tmp_path):
    for _ in range(2):
        logger = get_logger("textveil.test", str(tmp_path / "logs/app.log"))
    logger.info("one line")
    assert len(logger.handlers) == 2 and (tmp_path / "logs/app.log").read_text().count("one line") == 1


def test_batches(spark, tmp_path):
    batch = anonymize_batch_names(spark, "/root/testdata/sf0.001")
    assert batch.count() == 206
    save_batch(batch, str(tmp_path / "batch"))
    stored = {r.file: r.content for r in spark.read.parquet(str(tmp_path / "batch")).collect()}
    assert len(stored) == 412 and stored["absent.txt.anonymized.txt"] == "" and '"policy":"replace"' in stored["absent.txt.report.json"]
    names = spark.createDataFrame([("a", None)], "name string, detections " + f"array<{DETECTION}>")
    assert anonymize_batch(names, spark.createDataFrame([("a", "x")], "name string, text string")).count() == 0


def test_a_stream_is_anonymized(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("mail a@b.co\nnothing\n")
    stream = anonymized_stream(spark.readStream.schema("text string").text(str(tmp_path / "in").replace("/a.txt", "")).withColumnRenamed("value", "text"))
    query = stream.writeStream.format("memory").queryName("hidden").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(60)
    assert sorted((r.text, r.pii_found) for r in spark.table("hidden").collect()) == [("mail ******", 1), ("nothing", 0)]
