"""Text from files: plain text, JSON and packet captures, one row for each file or packet."""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from textveil.functions.text import normalize
from textveil.schema import PACKET


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)``, a row for each file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def decoded(content: Column) -> Column:
    """UTF-8, with U+FFFD for malformed bytes."""
    return F.make_valid_utf8(content.cast("string"))


def flattened(text: str | None) -> str:
    """``path: value`` of every leaf of a JSON document, joined by `` | ``; empty if it can't be parsed or nests too deeply for that.

    Keys keep the document's order, values are spelt as Python does, and empty containers have no leaf.
    """
    try:
        document = json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return ""
    lines: list[str] = []
    stack = [("", document)]
    while stack:
        path, node = stack.pop()
        if isinstance(node, dict):
            stack += [(f"{path}{k}.", v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            stack += [(f"{path}[{i}].", v) for i, v in reversed([*enumerate(node)])]
        else:
            lines.append(f"{path.strip('.')}: {node}")
    return " | ".join(lines)


@F.pandas_udf(StringType())
def flatten_json(text: pd.Series) -> pd.Series:
    return text.map(flattened)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of plain text files, normalized."""
    return binary_files(spark, path).select("path", normalize(decoded(F.col("content"))).alias("text"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of JSON files, flattened and normalized; empty text for a file that is no JSON in UTF-8."""
    valid = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return binary_files(spark, path).select("path", normalize(flatten_json(valid)).alias("text"))


# Ports whose payload a dissector parses further, so that no raw text is left: DNS and its kin, BOOTP, NTP, SNMP.
_PARSED_PORTS = frozenset({53, 67, 68, 123, 161, 162, 5353, 5355})


def packets(content: bytes, most: int = 500) -> Iterator[tuple[int, str, str, bytes]]:
    """``(number, source, destination, payload)`` of a capture's packets with a payload; reading stops after ``most`` packets.

    Captures are classic or of the next generation, gzipped or not; links are Ethernet, Linux cooked and
    raw IP (whose ends are unknown, as its second layer has none); IPv4 and IPv6 with TCP or UDP. Other
    Ethernet frames' bytes are a payload of unknown ends, frames of other links have none. A truncated
    record ends the capture.
    """
    if content[:2] == b"\x1f\x8b":
        try:
            content = gzip.decompress(content)
        except (OSError, EOFError, ValueError):
            return
    for number, (link, frame) in enumerate(_frames(content), 1):
        if number > most:
            return
        try:
            source, target, payload = _dissected(frame, link)
        except (IndexError, struct.error):
            continue
        if payload:
            yield number, source, target, payload


def _frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """``(link, frame)`` of each record."""
    if content[:4] == b"\x0a\x0d\x0d\x0a":
        yield from _blocks(content)
        return
    order = {b"\xd4\xc3\xb2\xa1": "<", b"\x4d\x3c\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">", b"\xa1\xb2\x3c\x4d": ">"}.get(content[:4])
    if order is None or len(content) < 24:
        return
    link = struct.unpack(f"{order}I", content[20:24])[0] & 0xFFFF
    at = 24
    while at + 16 <= len(content):
        size = struct.unpack(f"{order}I", content[at + 8 : at + 12])[0]
        yield link, content[at + 16 : at + 16 + size]
        at += 16 + size


def _blocks(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Frames of a capture of blocks: section header, interfaces, enhanced and simple packets; others are skipped."""
    at, order, links = 0, "<", []
    while at + 12 <= len(content):
        kind = content[at : at + 4]
        if kind == b"\x0a\x0d\x0d\x0a":
            order, links = "<" if content[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">", []
        number, size = struct.unpack(f"{order}II", content[at : at + 8])
        body = content[at + 8 : at + size - 4]
        if size < 12 or at + size > len(content):
            return
        if number == 1 and len(body) >= 2:
            links.append(struct.unpack(f"{order}H", body[:2])[0])
        elif number == 6 and len(body) >= 20:
            interface, _, _, length = struct.unpack(f"{order}IIII", body[:16])
            yield (links[interface] if interface < len(links) else -1), body[20 : 20 + length]
        elif number == 3 and len(body) >= 4:
            yield (links[0] if links else -1), body[4 : 4 + struct.unpack(f"{order}I", body[:4])[0]]
        at += size


def _dissected(frame: bytes, link: int) -> tuple[str, str, bytes]:
    head = {1: 14, 113: 16, 101: 0, 228: 0, 229: 0}.get(link)
    if head is None:
        return "unknown", "unknown", b""
    kind = struct.unpack("!H", frame[head - 2 : head])[0] if head else {4: 0x0800, 6: 0x86DD}.get(frame[0] >> 4, 0)
    if link == 1 and kind == 0x8100:
        head, kind = head + 4, struct.unpack("!H", frame[16:18])[0]
    body = frame[head:]
    if kind == 0x0800:
        size, protocol, total = (body[0] & 15) * 4, body[9], struct.unpack("!H", body[2:4])[0]
        ends = [".".join(map(str, body[i : i + 4])) for i in (12, 16)]
        inner = body[size : total or None]
    elif kind == 0x86DD:
        import ipaddress

        protocol, ends = body[6], [str(ipaddress.IPv6Address(body[i : i + 16])) for i in (8, 24)]
        inner = body[40 : 40 + struct.unpack("!H", body[4:6])[0]]
    elif kind in (0x0806, 0):
        return "unknown", "unknown", b""
    else:
        return "unknown", "unknown", body
    if not head:
        ends = ["unknown", "unknown"]
    if protocol in (6, 17) and _PARSED_PORTS.intersection(struct.unpack("!HH", inner[:4])):
        return *ends, b""
    if protocol == 6:
        return *ends, inner[(inner[12] >> 4) * 4 :]
    if protocol == 17:
        return *ends, inner[8:]
    return *ends, b"" if protocol in (1, 58) else inner


def packet_rows(files: DataFrame, most: int = 500) -> DataFrame:
    """``(path, packet_no, src, dst, text)`` of captures ``files(path, content)``; packets without readable text have no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *p[:3], p[3].decode("utf-8", "ignore")) for path, content in zip(frame["path"], frame["content"], strict=True) for p in packets(bytes(content), most)]
            yield pd.DataFrame(rows, columns=["path", "packet_no", "src", "dst", "text"])

    found = files.select("path", "content").mapInPandas(run, f"path string, {PACKET}")
    return found.withColumn("text", normalize(F.col("text"))).where("text <> ''")


def read_pcap(spark: SparkSession, path: str, most: int = 500) -> DataFrame:
    return packet_rows(binary_files(spark, path), most)


def extracted(files: DataFrame, most: int = 500) -> DataFrame:
    """``(path, text)`` of files of mixed kinds, by their extension in any case; an unknown one gives an empty text. One pass over the files."""

    @F.pandas_udf(ArrayType(StringType()))
    def payloads(content: pd.Series) -> pd.Series:
        return content.map(lambda c: [p[3].decode("utf-8", "ignore") for p in packets(bytes(c), most)] if c is not None else [])

    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.select("path", "content", kind.alias("kind"))
    text = F.col("content").cast("string")
    document = F.when((F.col("kind") == "json") & F.is_valid_utf8(text), text)
    rows = rows.select("path", "kind", "content", flatten_json(document).alias("flat"), payloads(F.when(F.col("kind") == "pcap", F.col("content"))).alias("payloads"))
    captured = F.array_join(F.filter(F.transform("payloads", normalize), lambda t: t != ""), " ")
    by_kind = F.when(F.col("kind") == "txt", normalize(decoded(F.col("content")))).when(F.col("kind") == "json", normalize(F.col("flat"))).when(F.col("kind") == "pcap", captured)
    return rows.select("path", F.coalesce(by_kind, F.lit("")).alias("text"))
