"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm.bpe import digest_texts
from textveil.llm.chat import format_conversations, read_back
from textveil.llm.common import importable, spread, table
from textveil.llm.jaccard_join import jaccard_components
from textveil.llm.packing import pack_documents
from textveil.llm.paragraph_dedup import repeated_passages
from textveil.llm.quality_mil import fit_bags, score_quality
from textveil.llm.quality_rules import RepetitionRules, score_repetition
from textveil.llm.topk import top_k
from textveil.llm.toxicity import fit_field, score_toxicity
from textveil.llm.url_filter import evaluate, host_of


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op2_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = documents(spark, sf_dir)
    return score_quality(docs, fit_bags(docs, table(spark, sf_dir, "labels")))


def op4_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return score_repetition(documents(spark, sf_dir))


def _covered(k: int) -> str:
    """SQL: whether a word lies in a k-gram that its text holds twice or more."""
    return f"""SELECT doc_id, i, w, max(CASE WHEN full_size AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) = 1 AS inside FROM (
      SELECT *, count(*) OVER (PARTITION BY doc_id, g, full_size) AS n FROM (
        SELECT doc_id, i, w, string_agg(w, ' ') OVER win AS g, count(*) OVER win = {k} AS full_size FROM words
        WINDOW win AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)))"""


_RULES = RepetitionRules()
OP4_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs)),
counted AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars FROM words GROUP BY doc_id),
lines AS (
  SELECT doc_id, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc_id, line) > 1 AS again
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup_lines AS (SELECT doc_id, count(*) FILTER (WHERE again) AS n_dup_lines, CAST(coalesce(sum(chars) FILTER (WHERE again), 0) AS BIGINT) AS dup_line_chars FROM lines GROUP BY doc_id),
repeats AS (SELECT doc_id, count(*) FILTER (WHERE inside) AS n_repeat_words FROM ({_covered(_RULES.repeat_window)}) GROUP BY doc_id),
shares AS (
  SELECT doc_id, max(part) AS ngram_share, bool_or(part > most) AS worst FROM (
    {" UNION ALL ".join(f"SELECT doc_id, CAST(coalesce(sum(length(w)) FILTER (WHERE inside), 0) AS DOUBLE) / sum(length(w)) AS part, CAST({m} AS DOUBLE) AS most FROM ({_covered(k)}) GROUP BY doc_id" for k, m in sorted(_RULES.ngram_limits.items()))}) GROUP BY doc_id),
joined AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(ngram_share, 0.0) AS ngram_share, coalesce(worst, false) AS worst
  FROM docs d LEFT JOIN counted c ON c.doc_id = d.doc_id LEFT JOIN dup_lines l ON l.doc_id = d.doc_id LEFT JOIN repeats r ON r.doc_id = d.doc_id LEFT JOIN shares s ON s.doc_id = d.doc_id),
judged AS (SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words AS base_failed FROM joined)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, ngram_share, base_failed,
  NOT base_failed AND NOT worst AND CAST(dup_line_chars AS DOUBLE) / greatest(word_chars, 1) <= CAST({_RULES.max_line_share} AS DOUBLE) AS kept FROM judged
"""


def op5_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return repeated_passages(documents(spark, sf_dir))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return jaccard_components(documents(spark, sf_dir), k=3, percent=90)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
ways AS (SELECT x AS one, y AS other FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, ways.other FROM reach JOIN ways ON ways.one = reach.r)
SELECT reach.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id
"""


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return digest_texts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def list_events(captures: DataFrame) -> DataFrame:
    """Dated events of a block and an allow list, drawn from digests of the captures' hosts and domains.

    The tables hold no such lists. One in three hosts is blocked from a day of 2024 on, half of these
    for 60 days, a quarter again after 120; one in two domains of two labels is blocked, one in seven
    hosts is on the allow list.
    """
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    hosts = captures.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    keys = hosts.select(F.explode(F.array(F.struct(F.col("host").alias("key"), F.lit(True).alias("exact")), F.struct(F.nullif(domain, F.lit("")).alias("key"), F.lit(False).alias("exact")))).alias("k"))
    keys = keys.select("k.*").where("key is not null").distinct().withColumn("number", F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("long"))
    first = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("number") % 200).cast("int"))

    def event(name: str, chosen: str, action: str, days: int):
        return F.when(F.expr(chosen), F.struct(F.lit(name).alias("list"), F.lit(action).alias("action"), F.date_add(first, days).alias("effective_at")))

    events = F.array(
        event("block", "exact and number % 3 = 0", "add", 0), event("block", "exact and number % 3 = 0 and number % 2 = 0", "remove", 60),
        event("block", "exact and number % 3 = 0 and number % 4 = 0", "add", 120), event("block", "not exact and number % 2 = 0", "add", 30), event("allow", "exact and number % 7 = 0", "add", 10),
    )
    return keys.select("key", "exact", F.explode(F.array_compact(events)).alias("e")).select("e.list", "key", "exact", "e.action", "e.effective_at")


def op8_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures; the table has no fetch time, so a day of 2024 follows from the page's number."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    pages = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 365).cast("int")))
    return evaluate(pages, list_events(pages))


OP8_SQL = r"""
WITH pages_at AS (
  SELECT page_id, url, (DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER)) AS fetched_at,
    nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host AS key FROM pages_at WHERE host IS NOT NULL),
domains AS (SELECT DISTINCT regexp_extract(key, '([^.]+\.[^.]+)$', 1) AS key FROM hosts WHERE regexp_matches(key, '([^.]+\.[^.]+)$')),
host_n AS (SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS n FROM hosts),
domain_n AS (SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS n FROM domains),
events AS (
  SELECT 'block' AS list, key, true AS exact, 'add' AS action, DATE '2024-01-01' + CAST(n % 200 AS INTEGER) AS day FROM host_n WHERE n % 3 = 0
  UNION ALL SELECT 'block', key, true, 'remove', DATE '2024-01-01' + CAST(n % 200 + 60 AS INTEGER) FROM host_n WHERE n % 3 = 0 AND n % 2 = 0
  UNION ALL SELECT 'block', key, true, 'add', DATE '2024-01-01' + CAST(n % 200 + 120 AS INTEGER) FROM host_n WHERE n % 3 = 0 AND n % 4 = 0
  UNION ALL SELECT 'block', key, false, 'add', DATE '2024-01-01' + CAST(n % 200 + 30 AS INTEGER) FROM domain_n WHERE n % 2 = 0
  UNION ALL SELECT 'allow', key, true, 'add', DATE '2024-01-01' + CAST(n % 200 + 10 AS INTEGER) FROM host_n WHERE n % 7 = 0),
latest AS (
  SELECT p.page_id, e.list, e.key, e.exact, max(e.day) AS day
  FROM pages_at p JOIN events e ON e.day <= p.fetched_at AND ((e.exact AND e.key = p.host) OR (NOT e.exact AND (p.host = e.key OR ends_with(p.host, '.' || e.key))))
  GROUP BY ALL),
active AS (SELECT a.* FROM latest a JOIN events e ON e.list = a.list AND e.key = a.key AND e.exact = a.exact AND e.day = a.day WHERE e.action = 'add'),
best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, exact DESC, (list = 'allow') DESC, day DESC) AS r FROM active)
SELECT p.page_id, p.url, p.fetched_at, p.host, coalesce(b.list <> 'allow', false) AS blocked, b.list AS matched_list, b.key AS matched_key, b.day AS matched_since
FROM pages_at p LEFT JOIN best b ON b.page_id = p.page_id AND b.r = 1
"""


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's own strings."""
    importable(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.union(more)))


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
written AS (
  SELECT *, 17 + length(role) + length(replace(replace(replace(replace(text, '', '\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?u(au)*a?') AS valid
FROM written GROUP BY conv_id
"""


def op10_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, fit_field(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_sequence_packing": op2_sequence_packing,
    "op3_quality_bags": op3_quality_bags,
    "op4_repetition_rules": op4_repetition_rules,
    "op5_paragraph_minhash": op5_paragraph_minhash,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_bpe_tree": op7_bpe_tree,
    "op8_temporal_lists": op8_temporal_lists,
    "op9_chat_format": op9_chat_format,
    "op10_toxic_spans": op10_toxic_spans,
}

ORACLES: dict[str, str] = {"op1_exact_topk": OP1_SQL, "op4_repetition_rules": OP4_SQL, "op6_ngram_jaccard": OP6_SQL, "op8_temporal_lists": OP8_SQL, "op9_chat_format": OP9_SQL}
