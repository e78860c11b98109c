"""Packing of token sequences by order-preserving dynamic programming.

The tokens of the documents of a task, in their order, form one line. A window of at most
``capacity`` tokens may end at a document's end (free), at a sentence's end inside a document (a
small penalty), or, so that long sentences can be cut at all, at every ``hard_step``-th token (a
larger one) of a sentence of more than twice that length. The windows minimise padding plus penalties: with positions p and best costs c, c(j) =
penalty(j) + capacity - p(j) + min over i of (c(i) + p(i)), where i runs through a window of
positions that only moves forward, so a monotone queue yields each minimum in constant time. A
window whose length is a power of two needs no padding; the larger of these lengths are tried beside
the queue.

A task solves runs of about ``run_tokens`` tokens and keeps all but the last window of each, so its
memory is bounded by that and the longest document. Tokenisers: ids equal those of the tokenizers
library; texts of Latin characters alone go through tiktoken with the same vocabulary, which is
faster, all others through the library itself.

Defined results: a null or empty text is the end token alone. Documents keep the order of their
partition; repeated rows are packed again; every token lies in exactly one piece. An empty table
gives an empty table. Other columns are not read. Rows come out in the order of the input, which a
lost executor's task repeats exactly when the table is read from files.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from textveil.llm.common import nulls_to_empty

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Characters on which both libraries are known to agree: Basic Latin to Latin Extended-B, general punctuation.
_ODD = re.compile("[^\\x00-\\x7f\\u00a1-\\u024f\\u2010-\\u2027\\u2030-\\u205e]|<\\|endoftext\\|>")


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    sentence_penalty: float = 2.0
    hard_penalty: float = 24.0
    hard_step: int = 32
    end_token: int = 1
    run_tokens: int = 1 << 18


class Encoder:
    """Ids of texts under a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=False)
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if all(c in alphabet for c in token)}
        ranks = {token: i for token, i in ranks.items() if i != self.library.token_to_id("<|endoftext|>")}
        # Fixed value: the split pattern of byte-level BPE.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = self.library.get_vocab_size()
        self.ends, self.begins = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        for token, i in ranks.items():
            text = token.rstrip(b"\"')]")
            self.ends[i] = text.endswith((b".", b"!", b"?", b"\n"))
            self.begins[i] = token[:1].isspace()

    def __call__(self, text: str) -> list[int]:
        if _ODD.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Positions inside ``ids`` that a sentence ends before."""
        after = self.ends[ids[:-1]] & (self.begins[ids[1:]] | (ids[:-1] == ids[1:]))
        return np.flatnonzero(after) + 1


def _byte_alphabet() -> dict[str, int]:
    """The character that byte-level BPE writes for each byte: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def windows_of(positions: np.ndarray, penalties: np.ndarray, capacity: int, least: int = 512) -> list[int]:
    """Indices of the cuts that end each window, at least padding plus penalties.

    ``positions`` ascend from 0, no two neighbours more than ``capacity`` apart; the last is the end.
    Windows shorter than ``least`` are padded even at a power of two, but for the last one, so that none falls to crumbs.
    """
    p, q = positions.tolist(), penalties.tolist()
    index = {x: i for i, x in enumerate(p)}
    best, back = [0.0] * len(p), [0] * len(p)
    powers = [1 << k for k in range(least.bit_length() - 1, capacity.bit_length() - 1)]
    queue: deque[int] = deque([0])
    low = 0.0
    for j in range(1, len(p)):
        at = p[j]
        while p[queue[0]] < at - capacity:
            queue.popleft()
        i = queue[0]
        cost = best[i] + p[i] + capacity - at
        for n in powers:
            h = index.get(at - n)
            if h is not None and best[h] + 1 < cost:
                cost, i = best[h] + 1, h
        best[j], back[j] = cost + q[j], i
        low = best[j] + at
        while queue and best[queue[-1]] + p[queue[-1]] >= low:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(p) - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


class Packer:
    """Packs a stream of documents, run by run."""

    def __init__(self, encoder: Encoder, rules: Packing, first_sequence: int):
        self.encoder, self.rules, self.sequence = encoder, rules, first_sequence
        self.held: list[tuple[int, int, int, np.ndarray]] = []  # doc_id, start, doc_tokens, ids
        self.tokens = 0

    def add(self, doc_id, text: str) -> list[tuple]:
        ids = np.array([*self.encoder(text), self.rules.end_token], dtype=np.uint32)
        self.held.append((doc_id, 0, len(ids), ids))
        self.tokens += len(ids)
        return self.pack(False) if self.tokens >= self.rules.run_tokens else []

    def pack(self, last: bool) -> list[tuple]:
        """Rows of the windows of what is held; all but the last window if more is to come."""
        if not self.held:
            return []
        positions, penalties, base = [np.zeros(1, np.int64)], [np.zeros(1)], 0
        for _, _, _, ids in self.held:
            n = len(ids)
            penalty = np.full(n + 1, np.inf)
            ends = np.concatenate([[0], self.encoder.sentence_ends(ids), [n]])
            for a in np.flatnonzero(np.diff(ends) > 2 * self.rules.hard_step):
                penalty[ends[a] + self.rules.hard_step : ends[a + 1] : self.rules.hard_step] = self.rules.hard_penalty
            penalty[ends] = self.rules.sentence_penalty
            penalty[n] = 0.0
            at = np.flatnonzero(np.isfinite(penalty[1:])) + 1
            positions.append(base + at)
            penalties.append(penalty[at])
            base += n
        at = np.concatenate(positions)
        cuts = at[windows_of(at, np.concatenate(penalties), self.rules.capacity)].tolist()
        if not last and len(cuts) > 1:
            cuts.pop()
        rows, d, used = [], 0, 0  # the piece under way: document, and its ids already placed
        place = 0
        for end in cuts:
            offset = 0
            while place < end:
                doc_id, start, total, ids = self.held[d]
                n = min(len(ids) - used, end - place)
                rows.append((doc_id, start + used, n, zlib.crc32(ids[used : used + n].astype("<u4").tobytes()), total, self.sequence, offset))
                place, offset, used = place + n, offset + n, used + n
                if used == len(ids):
                    d, used = d + 1, 0
            self.sequence += 1
        rest = self.held[d:]
        if rest and used:
            doc_id, start, total, ids = rest[0]
            rest[0] = (doc_id, start + used, total, ids[used:])
        self.held, self.tokens = rest, sum(len(x[3]) for x in rest)
        return rows


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rules: Packing | None = None) -> DataFrame:
    """One row for each piece of a document in a sequence: the columns of SCHEMA. One pass, no shuffle.

    ``path``: the vocabulary file, on every executor. A task numbers its sequences from its partition's
    number times 2**40.
    """
    rules = rules or Packing()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(_encoder(path), rules, TaskContext.get().partitionId() << 40)
        names = [x.split()[0] for x in SCHEMA.split(",")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), nulls_to_empty(batch.column(1)).to_pylist(), strict=True):
                rows += packer.add(doc_id, text)
            yield out(rows)
        yield out(packer.pack(True))

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
