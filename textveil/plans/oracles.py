"""DuckDB SQL for the queries, written on its own: marks in place of look-around, joins in place of folds.

RE2 has no look-around and its classes are ASCII. So before matching, runs of word characters are put
between U+0002, or U+0001 is set behind each run of digits; patterns say where a run must end, and
the marks are taken out of matches and gaps again.
"""

from __future__ import annotations

from textveil.config import Config
from textveil.plans.queries import SAMPLES

_CONFIG = Config()
_W, _D = "\x02", "\x01"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


DOCS = "SELECT doc_id, text FROM documents UNION ALL VALUES " + ", ".join(f"({i}, {_text(t)})" for i, t in SAMPLES.items())
_WORDS = f"regexp_replace(text, '([\\p{{L}}\\p{{N}}_]+)', '{_W}\\1{_W}', 'g')"
_DIGITS = f"regexp_replace(text, '(\\d+)', '\\1{_D}', 'g')"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d{1,2})"
_CASES = (
    ("EMAIL", 0, "text", r"(?i)[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", 0.98, "email_regex"),
    ("PHONE", 1, _DIGITS, rf"(?:\+?\d{{1,3}}{_D}[\s\-\.])?(?:\(?\d{{2,4}}{_D}\)?[\s\-\.])?\d{{3,4}}(?:{_D}[\s\-\.])?\d{{3,4}}{_D}", 0.88, "phone_regex"),
    ("CREDIT_CARD", 2, "text", r"(?:\d[ -]*?){13,19}", None, "creditcard_generic"),
    ("IP_ADDRESS", 3, _WORDS, rf"{_W}{_OCTET}(?:{_W}\.{_W}{_OCTET}){{3}}", 0.95, "ipv4_regex"),
    ("SSN", 4, _WORDS, rf"{_W}\d{{3}}(?:{_W}-{_W})?\d{{2}}(?:{_W}-{_W})?\d{{4}}{_W}", 0.9, "ssn_regex"),
    ("NAME", 5, _WORDS, rf"{_W}[A-Z][a-z]+{_W}\s+{_W}[A-Z][a-z]+{_W}(?:\s+{_W}[A-Z][a-z]+{_W})?", 0.45, "name_heuristic"),
)
_LUHN = (
    "list_sum(list_transform(range(len(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[len(d) - i] AS INTEGER) "
    "WHEN CAST(d[len(d) - i] AS INTEGER) > 4 THEN 2 * CAST(d[len(d) - i] AS INTEGER) - 9 ELSE 2 * CAST(d[len(d) - i] AS INTEGER) END)) % 10 = 0"
)


def _places(source: str, marked: str, pattern: str) -> str:
    """``(doc_id, value, start, end)`` of a pattern's matches in ``source(doc_id, text)``."""
    plain = lambda x: f"translate({x}, '{_D}{_W}', '')"
    return f"""(SELECT doc_id, v AS value, e - length(v) AS start, e AS "end" FROM (
      SELECT doc_id, v, CAST(sum(length(g) + length(v)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM (
        SELECT doc_id, {plain('unnest(ms)')} AS v, {plain('unnest(gs[1:len(ms)])')} AS g, generate_subscripts(ms, 1) AS i FROM (
          SELECT doc_id, regexp_extract_all({marked}, '{pattern}') AS ms, regexp_split_to_array({marked}, '{pattern}') AS gs FROM {source}))))"""


def _case(source: str, case: tuple) -> str:
    kind, order, marked, pattern, confidence, rule = case
    score = f"CAST({confidence} AS DOUBLE)"
    if confidence is None:
        score = f"(SELECT CASE WHEN {_LUHN} THEN CAST(0.95 AS DOUBLE) ELSE 0.78 END FROM (SELECT regexp_replace(value, '\\D', '', 'g') AS d))"
    some = "WHERE length(regexp_replace(value, '\\D', '', 'g')) >= 7" if kind == "PHONE" else ""
    return f"SELECT doc_id, '{kind}' AS type, value, start, \"end\", {score} AS confidence, '{rule}' AS rule, {order} AS k FROM {_places(source, marked, pattern)} {some}"


def detection(source: str, p: str = "") -> str:
    """Tables ``{p}cand``, ``{p}resolved`` and ``{p}clean`` of ``source``, as parts of a WITH RECURSIVE."""
    return f"""{p}cand AS ({' UNION ALL '.join(_case(source, c) for c in _CASES)}),
    {p}numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, confidence DESC, "end" DESC, k) AS i FROM {p}cand),
    {p}fold AS (
      SELECT doc_id, i, i AS last, "end" AS until, confidence AS c, "end" - start AS n, CAST(NULL AS BIGINT) AS gone FROM {p}numbered WHERE i = 1
      UNION ALL
      SELECT d.doc_id, d.i,
        CASE WHEN d.start >= f.until OR d.confidence > f.c OR (d.confidence = f.c AND d."end" - d.start > f.n) THEN d.i ELSE f.last END,
        CASE WHEN d.start >= f.until OR d.confidence > f.c OR (d.confidence = f.c AND d."end" - d.start > f.n) THEN d."end" ELSE f.until END,
        CASE WHEN d.start >= f.until OR d.confidence > f.c OR (d.confidence = f.c AND d."end" - d.start > f.n) THEN d.confidence ELSE f.c END,
        CASE WHEN d.start >= f.until OR d.confidence > f.c OR (d.confidence = f.c AND d."end" - d.start > f.n) THEN d."end" - d.start ELSE f.n END,
        CASE WHEN d.start < f.until AND (d.confidence > f.c OR (d.confidence = f.c AND d."end" - d.start > f.n)) THEN f.last END
      FROM {p}fold f JOIN {p}numbered d ON d.doc_id = f.doc_id AND d.i = f.i + 1),
    {p}resolved AS (
      SELECT n.* FROM {p}numbered n WHERE EXISTS (SELECT 1 FROM {p}fold f WHERE f.doc_id = n.doc_id AND f.last = n.i)
        AND NOT EXISTS (SELECT 1 FROM {p}fold f WHERE f.doc_id = n.doc_id AND f.gone = n.i)),
    {p}inside AS (SELECT * FROM {_places(source, 'text', 'PSEUDO_[0-9a-fA-F]+')}),
    {p}clean AS (
      SELECT r.* FROM {p}resolved r WHERE NOT contains(value, 'PSEUDO_')
        AND NOT EXISTS (SELECT 1 FROM {p}inside s WHERE s.doc_id = r.doc_id AND r.start >= s.start AND r."end" <= s."end"))"""


_PSEUDONYM = f"'PSEUDO_' || substr(sha256(value || '{_CONFIG.salt}'), 1, 12)"
_MASK = "CASE WHEN contains(value, '@') OR length(value) <= 4 THEN repeat('*', length(value)) ELSE repeat('*', length(value) - 4) || right(value, 4) END"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_SAMPLES = "SELECT * FROM (VALUES " + ", ".join(f"({-i}, {_text(t)})" for i, t in SAMPLES.items()) + ") AS s(i, text)"
_FLAT = "regexp_replace(regexp_replace(regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g'), '\\s{2,}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
_ROW = 'doc_id, type, value, start, "end", confidence, rule'
BASE = f"WITH RECURSIVE docs AS ({DOCS}), " + detection("docs")


def hidden(name: str, replacement: str) -> str:
    """A table ``name(doc_id, text)`` of texts with each clean detection replaced."""
    return f"""{name} AS (
      SELECT d.doc_id, coalesce(w.head || substr(d.text, w.until + 1), d.text) AS text FROM docs d LEFT JOIN (
        SELECT doc_id, string_agg(gap || r, '' ORDER BY start) AS head, max("end") AS until FROM (
          SELECT c.doc_id, start, "end", {replacement} AS r, substr(d.text, coalesce(lag("end") OVER (PARTITION BY c.doc_id ORDER BY start), 0) + 1, start - coalesce(lag("end") OVER (PARTITION BY c.doc_id ORDER BY start), 0)) AS gap
          FROM clean c JOIN docs d ON d.doc_id = c.doc_id) GROUP BY doc_id) w ON w.doc_id = d.doc_id)"""


_MAPS = f"maps AS (SELECT DISTINCT doc_id, value AS original, {_PSEUDONYM} AS pseudonym FROM clean)"


def restored(name: str, replies: str, maps: str) -> str:
    """A table ``name(doc_id, text)``: whole words of replies looked up in maps."""
    return f"""{name} AS (
      SELECT doc_id, coalesce(string_agg(coalesce(original, piece), '' ORDER BY i), '') AS text FROM (
        SELECT p.doc_id, p.i, p.piece, m.original FROM (
          SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM (SELECT doc_id, CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') END AS pieces FROM {replies})) p
        LEFT JOIN {maps} m ON m.doc_id = p.doc_id AND m.pseudonym = p.piece) GROUP BY doc_id)"""


def left(name: str, texts: str) -> str:
    """A table ``name(doc_id, pseudonym, n)``: pseudonyms of the maps that stand in texts."""
    return f"""{name} AS (
      SELECT w.doc_id, w.piece AS pseudonym, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS piece FROM {texts}) w
      JOIN (SELECT DISTINCT doc_id, pseudonym FROM maps) m ON m.doc_id = w.doc_id AND m.pseudonym = w.piece GROUP BY ALL)"""


_REPLIES = hidden("replies", _PSEUDONYM)
_ROUND = f"{BASE}, {_MAPS}, {_REPLIES}, {restored('back', 'replies', 'maps')}"
_PASSED = "PASS ✅"
_MOCK = f"'[MOCK RESPONSE] Model {_CONFIG.model} received ' || ({len(_CONFIG.prompt)} + length(r.text)) || ' characters.'"
_ANALYZED = f"""WITH RECURSIVE docs AS (SELECT doc_id, {_STRIP.format("coalesce(text, '')")} AS text FROM ({DOCS})), {detection("docs")}, {_REPLIES}, {_MAPS}, {detection('replies', 'again_')},
  counts AS (SELECT d.doc_id, count(c.doc_id) AS n FROM docs d LEFT JOIN clean c ON c.doc_id = d.doc_id GROUP BY ALL),
  twice AS (SELECT doc_id FROM maps GROUP BY doc_id, pseudonym HAVING count(*) > 1),
  reports AS (
    SELECT c.doc_id, c.n, r.text <> '' AS ok, r.text AS anonymized, CASE WHEN c.n > 0 THEN {_MOCK} END AS reply,
      CASE WHEN c.n > 0 THEN CASE WHEN c.doc_id NOT IN (SELECT doc_id FROM again_clean) AND c.doc_id NOT IN (SELECT doc_id FROM twice) THEN 'PASS ✅' ELSE 'FAIL ❌' END END AS status
    FROM counts c JOIN replies r ON r.doc_id = c.doc_id)"""

ORACLES: dict[str, str] = {
    "normalize_documents": f"SELECT doc_id, {_FLAT} AS text FROM ({DOCS})",
    "json_flatten_events": "SELECT event_id, coalesce((SELECT string_agg(k || ': ' || json_extract_string(props, '$.' || k), ' | ') FROM (SELECT unnest(json_keys(props)) AS k)), '') AS text FROM events",
    **{
        f"detect_{short}": f"SELECT {_ROW} FROM ({_case(f'({DOCS})', _CASES[i])})"
        for i, short in enumerate(("email", "phone", "credit_card", "ip", "ssn", "name"))
    },
    "pseudonym_spans": f"SELECT * FROM {_places(f'({DOCS})', 'text', 'PSEUDO_[0-9a-fA-F]+')}",
    "luhn_scores": f"SELECT doc_id, value, start, confidence AS score FROM ({_case(f'({DOCS})', _CASES[2])})",
    "confidence_by_type": f"{BASE} SELECT type, confidence, rule, count(*) AS n FROM cand GROUP BY ALL",
    "detect_candidates": f"{BASE} SELECT {_ROW} FROM cand",
    "detect_resolved": f"{BASE} SELECT {_ROW} FROM resolved",
    "detect_clean": f"{BASE} SELECT {_ROW} FROM clean",
    "pii_detections": f"{BASE} SELECT {_ROW} FROM clean",
    "pii_type_counts": f"{BASE} SELECT type, count(*) AS n, count(DISTINCT doc_id) AS documents FROM clean GROUP BY ALL",
    "mask_values": f"{BASE} SELECT DISTINCT value, {_MASK} AS masked FROM clean",
    "anonymize_mask": f"{BASE}, {hidden('out', _MASK)} SELECT doc_id, text AS anonymized FROM out",
    "anonymize_replace": f"{BASE}, {hidden('out', chr(39) + '<' + chr(39) + ' || type || ' + chr(39) + '>' + chr(39))} SELECT doc_id, text AS anonymized FROM out",
    "anonymize_pseudonymize": f"{BASE}, {_REPLIES} SELECT doc_id, text AS anonymized FROM replies",
    "anonymize_batch": f"""{BASE}, {hidden('out', chr(39) + '<' + chr(39) + ' || type || ' + chr(39) + '>' + chr(39))},
      listed AS (SELECT o.doc_id, to_json(coalesce(list({{'type': type, 'value': value, 'start': start, 'end': "end", 'confidence': confidence, 'rule': rule}} ORDER BY start) FILTER (WHERE type IS NOT NULL), [])) AS found FROM out o LEFT JOIN clean c ON c.doc_id = o.doc_id GROUP BY o.doc_id)
      SELECT 'doc' || o.doc_id || '.txt' AS name, text AS anonymized, '{{"detections":' || found || ',"policy":"replace"}}' AS report FROM out o JOIN listed l ON l.doc_id = o.doc_id
      UNION ALL SELECT 'absent.txt', '', '{{"detections":' || found || ',"policy":"replace"}}' FROM listed WHERE doc_id = -1""",
    "pseudonymize_values": f"{BASE} SELECT doc_id, start, value, {_PSEUDONYM} AS pseudonym FROM clean",
    "pseudonymize_customers": f"SELECT DISTINCT value AS original, {_PSEUDONYM} AS pseudonym FROM (SELECT c_name AS value FROM customer) WHERE value <> ''",
    "pseudonym_map": f"{BASE} SELECT DISTINCT value AS original, {_PSEUDONYM} AS pseudonym FROM clean",
    "pseudonym_map_nullable": f"{BASE} SELECT DISTINCT value AS original, {_PSEUDONYM} AS pseudonym FROM (SELECT value FROM cand UNION ALL SELECT '')",
    "denormalize_roundtrip": f"""{_ROUND} SELECT b.doc_id, b.text AS restored,
      CAST(len(regexp_extract_all(r.text, 'PSEUDO_[0-9a-fA-F]{{12}}')) - len(list_filter(regexp_extract_all(r.text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, 'PSEUDO_[0-9a-fA-F]{{12}}'))) AS BIGINT) AS unrestorable
      FROM back b JOIN replies r ON r.doc_id = b.doc_id""",
    "denormalize_by_run": f"{BASE}, {_MAPS}, {_REPLIES}, {restored('back', 'replies', 'maps')} SELECT 'run_' || doc_id AS run_id, text AS restored FROM back UNION ALL VALUES ('run_lost', 'to PSEUDO_fa11579224fb')",
    "residual_pseudonyms": f"{BASE}, {_MAPS}, {_REPLIES}, {left('residue', 'replies')} SELECT * FROM residue",
    "validate_anonymized": f"""{BASE}, {hidden('out', _MASK)}, {detection('out', 'again_')}
      SELECT doc_id, n = 0 AS passed, n AS pii_detected, CASE WHEN n = 0 THEN 'No PII detected ✅' ELSE n || ' PII instances still present ❌' END AS message
      FROM (SELECT o.doc_id, count(c.doc_id) AS n FROM out o LEFT JOIN again_clean c ON c.doc_id = o.doc_id GROUP BY ALL)""",
    "validate_denormalized": f"""{_ROUND}, mixed AS (SELECT b.doc_id, CASE WHEN b.doc_id % 2 = 0 THEN r.text ELSE b.text END AS text FROM back b JOIN replies r ON r.doc_id = b.doc_id), {left('residue', 'mixed')}
      SELECT m.doc_id, count(x.doc_id) = 0 AS passed, count(x.doc_id) AS remaining,
        CASE WHEN count(x.doc_id) = 0 THEN 'No pseudonyms remaining ✅' ELSE 'Residual pseudonyms found: [' || string_agg('''' || x.pseudonym || '''', ', ' ORDER BY x.pseudonym) || ']' END AS message
      FROM mixed m LEFT JOIN residue x ON x.doc_id = m.doc_id GROUP BY m.doc_id""",
    "validate_map": f"""{BASE}, {_MAPS}, every AS (SELECT * FROM maps UNION ALL VALUES (-100, '', 'PSEUDO_000000000001'), (-100, 'a', 'PSEUDO_000000000002'), (-101, 'b', 'PSEUDO_000000000003'), (-101, 'c', 'PSEUDO_000000000003')),
      each AS (SELECT doc_id, pseudonym, count(*) AS n, count(*) FILTER (WHERE original = '' OR pseudonym = '') AS bad FROM every GROUP BY ALL),
      whole AS (SELECT doc_id, CAST(sum(bad) AS BIGINT) AS invalid, coalesce(string_agg(pseudonym, ',' ORDER BY pseudonym) FILTER (WHERE n > 1), '') AS duplicates FROM each GROUP BY ALL)
      SELECT doc_id, invalid = 0 AND duplicates = '' AS passed, invalid, duplicates, CASE WHEN invalid = 0 AND duplicates = '' THEN 'Mapping integrity OK ✅' ELSE 'Mapping contains invalid or duplicate entries ❌' END AS message FROM whole""",
    "validation_report": f"""{_ROUND}, {detection('replies', 'again_')}, {left('residue', 'back')}, twice AS (SELECT doc_id FROM maps GROUP BY doc_id, pseudonym HAVING count(*) > 1)
      SELECT doc_id, clean, restored, map, CASE WHEN clean AND restored AND map THEN '{_PASSED}' ELSE 'FAIL ❌' END AS overall_status FROM (
        SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM again_clean) AS clean, doc_id NOT IN (SELECT doc_id FROM residue) AS restored, doc_id NOT IN (SELECT doc_id FROM twice) AS map FROM back)""",
    "mock_completion": f"{BASE}, {_REPLIES} SELECT doc_id, true AS ok, {_MOCK} AS text, '{_CONFIG.model}' AS model FROM replies r WHERE doc_id IN (SELECT doc_id FROM clean)",
    "analyze_batch": f"""{_ANALYZED} SELECT ok, doc_id, CASE WHEN ok AND n = 0 THEN 'No PII found in input text.' END AS message, n AS pii_found, CASE WHEN ok THEN anonymized END AS anonymized_text, reply AS llm_text, reply AS llm_denormalized, status FROM reports""",
    "report_listing": f"{_ANALYZED} SELECT doc_id, coalesce(status, 'UNKNOWN') AS status, n AS pii_found FROM reports WHERE ok",
    "status_summary": f"{_ANALYZED} SELECT contains(coalesce(status, 'UNKNOWN'), 'PASS') AS passed, count(*) AS runs, CAST(sum(n) AS BIGINT) AS pii_found FROM reports WHERE ok GROUP BY ALL",
    "log_redaction": f"""SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[EMAIL_REDACTED]', 'g'), '([\\p{{L}}\\p{{N}}_]+)', '{_W}\\1{_W}', 'g'), '{_W}\\d{{4,}}{_W}', '[NUM_REDACTED]', 'g'), '{_W}', '') AS line
      FROM (SELECT doc_id, CASE WHEN length(flat) > 200 THEN substr(flat, 1, 200) || '...(truncated)' ELSE flat END AS line FROM (SELECT doc_id, regexp_replace(replace(replace(text, chr(10), ' '), chr(13), ' '), '^\\s+|\\s+$', '', 'g') AS flat FROM ({DOCS})))""",
    "run_ids_from_events": "SELECT event_id, 'run_' || strftime(ts, '%Y%m%d_%H%M%S') AS run_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events",
    "pcap_payloads": f"SELECT '/in/' || i || '.pcap' AS path, CAST(1 AS INTEGER) AS packet_no, '10.0.0.1' AS src, '10.0.0.2' AS dst, {_FLAT} AS text FROM ({_SAMPLES}) WHERE {_FLAT} <> ''",
    "extract_dispatch": f"""SELECT '/in/' || i || '.pcap' AS path, {_FLAT} AS text FROM ({_SAMPLES})
      UNION ALL SELECT '/in/' || i || '.TXT', {_FLAT} FROM (SELECT i, text || chr(10) || chr(65533) AS text FROM ({_SAMPLES}))
      UNION ALL VALUES ('/in/a.json', 'a.b.[0]: 1 | a.b.[1]: True | a.b.[2]: None | d: x'), ('/in/b.json', ''), ('/in/c.bin', '')""",
}
