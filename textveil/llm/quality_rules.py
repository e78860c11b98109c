"""Quality rules by repetition coverage.

Rolling 64-bit hashes of several n-gram lengths, in numpy over a batch of whole texts, tell which
characters lie inside n-grams that the text holds twice or more, and inside lines that equal an
earlier line. A text is rejected when a share of its characters is over its limit.

Defined results: a null or empty text, or one of white space alone, has no words, all its counts are
0, and it fails the base rule for having fewer than ``min_words`` words. Rows are judged alone, so
ties and repeated rows get equal results, an empty table gives an empty table, and columns other than
the id and the text are never read (scoring) or pass through unchanged (filtering). Memory: some
twenty-five times a block of one megabyte or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textveil.llm.textblock import Block, blocks, mix, owners, repeated, totals, windows


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of the rules; shares are of the characters in words."""

    min_words: int = 20
    repeat_window: int = 8
    max_repeat_percent: int = 30
    #: n-gram length -> the largest share of characters inside duplicated n-grams.
    ngram_limits: dict[int, float] = field(default_factory=lambda: {5: 0.60, 7: 0.50, 10: 0.40})
    max_line_share: float = 0.40


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " dup_line_chars long, ngram_share double, base_failed boolean, kept boolean"
)
_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _covered(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Words that lie in a k-gram found twice or more in their text."""
    at, value = windows(hashes, first, k)
    owner = owners(first)
    at = at[repeated(mix(value + owner[at].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))]
    edge = np.zeros(len(hashes) + 1, dtype=np.int32)
    edge[at] += 1
    edge[at + k] -= 1
    return np.cumsum(edge[:-1]) > 0


def measure(block: Block, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """The rules' figures of each text of a block."""
    starts, ends, first = block.words()
    points = block.points()
    hashes = block.hashes(starts, ends)
    chars = points[ends] - points[starts]
    out = {"n_words": np.diff(first), "word_chars": totals(chars, first)}
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[block.data])])
    out["n_symbols"] = symbols[block.offsets[1:]] - symbols[block.offsets[:-1]]

    line_start, line_end, line_first = block.spans(block.data != 0x0A)
    n = np.searchsorted(starts, line_end) - np.searchsorted(starts, line_start)
    full = np.flatnonzero(n > 0)
    line_first = np.searchsorted(full, line_first)
    line_start, line_end = line_start[full], line_end[full]
    key = mix(block.hashes(line_start, line_end) + owners(line_first).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    again = np.ones(len(key), dtype=bool)
    again[np.unique(key, return_index=True)[1]] = False
    word_points = np.concatenate([[0], np.cumsum(chars)])
    in_line = word_points[np.searchsorted(starts, line_end)] - word_points[np.searchsorted(starts, line_start)]
    out["n_dup_lines"] = totals(again, line_first)
    out["dup_line_chars"] = totals(np.where(again, in_line, 0), line_first)

    out["n_repeat_words"] = totals(_covered(hashes, first, rules.repeat_window), first)
    total = np.maximum(out["word_chars"], 1)
    share = np.zeros(block.n)
    worst = out["dup_line_chars"] / total > rules.max_line_share
    for k, limit in sorted(rules.ngram_limits.items()):
        part = totals(np.where(_covered(hashes, first, k), chars, 0), first) / total
        share = np.maximum(share, part)
        worst |= part > limit
    out["ngram_share"] = share
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"])
    out["kept"] = ~out["base_failed"] & ~worst
    return out


def _measured(column, rules: RepetitionRules) -> dict[str, np.ndarray]:
    parts = [measure(b, rules) for b in blocks(column)]
    names = [x.split()[0] for x in SCHEMA.split(",")]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in names}


def score_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules | None = None) -> DataFrame:
    """The figures and verdict of every text: ``id_col`` and the columns of SCHEMA. One pass, no shuffle."""
    rules = rules or RepetitionRules()
    kinds = [x.split() for x in SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _measured(batch.column(1), rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k], _ARROW[t]) for k, t in kinds)], [id_col, *(k for k, _ in kinds)])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, {SCHEMA}")


def keep_unrepetitive(docs: DataFrame, text_col: str = "text", rules: RepetitionRules | None = None) -> DataFrame:
    """The rows that the rules keep, whole, in one pass without a shuffle."""
    rules = rules or RepetitionRules()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_measured(batch.column(at), rules)["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
