"""BPE encoding and decoding of whole texts, as the tokenizers library does, with tree concatenation.

A long text is cut into halves again and again, wherever the middle falls; the leaves are encoded in
one batch, in parallel, and halves are joined bottom-up. Around each join a window of the text is
encoded anew and grown until a token of it agrees with the left half and a token with the right half
(same id, same place). Between these the window's tokens are taken. That is exact: a sequence of BPE
tokens is the encoding of its text if and only if each pair of neighbours is, and every pair of the
result comes from one encoding; the words that the tokeniser splits off are in step from the first
common token on.

Texts of up to ``long_chars`` characters, four leaves, are encoded whole; those of Latin characters alone by a table of words that
the library has encoded before (bounded by ``memo_words``, then begun anew), all others by the
library itself.

Defined results: a null or empty text has no tokens and decodes to an empty text. Rows are judged
alone, so ties and repeated rows get equal results; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textveil.llm.common import nulls_to_empty

#: What the table of words may hold: characters on which Python and the library agree in case, class and white space.
_PLAIN = "\t\n\r -~¡-įı-ſ‐-‧‰-⁞"
_ODD = re.compile(f"[^{_PLAIN}]|<\\|")


def _of_category(kind: str) -> str:
    plain = re.compile(f"[{_PLAIN}]")
    return "".join(re.escape(chr(c)) for c in range(0x2060) if unicodedata.category(chr(c))[0] == kind and plain.match(chr(c)))


# Fixed value: the word pattern of the lower-casing BPE with word ends, over plain characters.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_of_category('L')}]+|[{_of_category('N')}]|[^\\s{_of_category('L')}{_of_category('N')}]+")


class Encoding:
    """Ids of a text with the characters, counted in the whole text, that each covers."""

    def __init__(self, ids: list[int], spans: list[tuple[int, int]]):
        self.ids, self.spans = ids, spans

    def find(self, token: int, span: tuple[int, int]) -> int | None:
        """Where a token stands, if it does."""
        lo, hi = 0, len(self.spans)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.spans[mid] < span:
                lo = mid + 1
            else:
                hi = mid
        while lo < len(self.spans) and self.spans[lo] == span:
            if self.ids[lo] == token:
                return lo
            lo += 1
        return None


class Codec:
    def __init__(self, path: str, leaf_chars: int = 4096, long_chars: int = 16384, memo_words: int = 1 << 18):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.leaf_chars, self.long_chars, self.memo_words = leaf_chars, long_chars, memo_words
        self.memo: dict[str, tuple[str, str]] = {}
        self.worded = self._lower_cases_words()
        self.token = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        self.word_end = [t.endswith("</w>") for t in self.token]

    def _lower_cases_words(self) -> bool:
        """Whether the file's rules are those that the table of words stands for."""
        import json

        rules = json.loads(self.library.to_str())
        return '"Lowercase"' in json.dumps(rules["normalizer"]) and rules["model"]["end_of_word_suffix"] == "</w>" and "'s|'t|'re|'ve|'m|'ll|'d|" in json.dumps(rules["pre_tokenizer"]) and rules["decoder"] is None

    def _window(self, text: str, a: int, b: int) -> Encoding:
        found = self.library.encode(text[a:b], add_special_tokens=False)
        return Encoding(found.ids, [(s + a, e + a) for s, e in found.offsets])

    def join(self, text: str, left: Encoding, right: Encoding, begin: int, cut: int, end: int, reach: int = 64) -> Encoding:
        """The encoding of ``text[begin:end]`` from those of its parts before and after ``cut``."""
        while True:
            a, b = max(begin, cut - reach), min(end, cut + reach)
            window = self._window(text, a, b)
            n = len(window.ids)
            first = (0, 0) if a == begin else None  # index in the window, and in the left half
            for j in range(n if first is None else 0):
                if window.spans[j][1] > cut:
                    break
                i = left.find(window.ids[j], window.spans[j])
                if i is not None:
                    first = (j, i)
                    break
            last = (n, len(right.ids)) if b == end else None
            for j in range(n - 1, -1, -1) if last is None else ():
                if window.spans[j][0] < cut:
                    break
                i = right.find(window.ids[j], window.spans[j])
                if i is not None:
                    last = (j + 1, i + 1)
                    break
            if first is not None and last is not None and first[0] <= last[0]:
                keep = slice(first[0], last[0])
                return Encoding(left.ids[: first[1]] + window.ids[keep] + right.ids[last[1] :], left.spans[: first[1]] + window.spans[keep] + right.spans[last[1] :])
            reach *= 2

    def tree(self, text: str) -> Encoding:
        """The encoding of a long text, joined from its halves."""
        edges = [0, len(text)]
        while edges[1] > self.leaf_chars:
            edges = sorted({*edges, *((a + b) // 2 for a, b in zip(edges[:-1], edges[1:], strict=True))})
        leaves = self.library.encode_batch([text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], add_special_tokens=False)
        level = [(a, b, Encoding(x.ids, [(s + a, e + a) for s, e in x.offsets])) for a, b, x in zip(edges[:-1], edges[1:], leaves, strict=True)]
        while len(level) > 1:
            joined = [(l[0], r[1], self.join(text, l[2], r[2], l[0], l[1], r[1])) for l, r in zip(level[::2], level[1::2], strict=False)]
            level = joined + level[len(joined) * 2 :]
        return level[0][2]

    def encode(self, text: str) -> list[int]:
        if len(text) > self.long_chars:
            return self.tree(text).ids
        if self.worded and not _ODD.search(text):
            return [int(i) for entry in self._entries(text) for i in entry[0].split(" ")]
        return self.library.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids, skip_special_tokens=False)

    def _entries(self, text: str) -> list[tuple[str, str]]:
        """For each word of a plain text: its ids in decimal, and its decoded text."""
        words = _WORDS.findall(text.lower())
        memo = self.memo
        new = set(words).difference(memo)
        if new:
            if len(memo) + len(new) > self.memo_words:
                memo.clear()
                new = set(words)
            new = list(new)
            ids = self.library.encode(" ".join(new), add_special_tokens=False).ids
            begin, word = 0, iter(new)
            for end, i in enumerate(ids, 1):
                if self.word_end[i]:
                    memo[next(word)] = (" ".join(map(str, ids[begin:end])), " ".join([self.token[x] for x in ids[begin:end]]))
                    begin = end
        return [memo[w] for w in words]

    def digests(self, text: str) -> tuple[int, str, str]:
        """The number of ids, the digest of the ids in decimal, and that of the decoded text."""
        if len(text) <= self.long_chars and self.worded and not _ODD.search(text):
            entries = self._entries(text)
            decimal, decoded = " ".join([e[0] for e in entries]), " ".join([e[1] for e in entries])
        else:
            ids = self.encode(text)
            decimal, decoded = " ".join(map(str, ids)), self.decode(ids)
        return decimal.count(" ") + (decimal != ""), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of this worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids)`` of every text. ``path``: the vocabulary file, on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [codec(path).encode(t) for t in nulls_to_empty(batch.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, text)`` of every list of ids; a null list is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec(path).decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], [id_col, "text"])

    source = encoded.select(id_col, ids_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, text string")


def digest_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids_sha256, decoded_sha256)`` of every text, encoded and decoded in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [codec(path).digests(t) for t in nulls_to_empty(batch.column(1)).to_pylist()]
            n, ids, decoded = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(n, dtype=np.int64)), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
